"""Event sources and stateful views. Event-time windows are a capability of this engine; the states of evidence stay columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_events(spark: SparkSession, folder: str, schema: str, kind: str = "json", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def relevant(events: DataFrame, ignored: DataFrame, path: str) -> DataFrame:
    """Events whose path is not ignored; an unknown (null) path is kept. ignored: (entry), a folder if it ends in /."""
    entry = ignored.select("entry").distinct()
    parts = F.split(path, "/")
    folder = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folder = F.when(F.size(parts) > 1, folder).otherwise(F.array().cast("array<string>"))
    keys = F.coalesce(F.concat(F.array(F.col(path)), F.transform(folder, lambda p: F.concat(p, F.lit("/")))), F.array(F.lit(None).cast("string")))
    all_ignored = entry.agg(F.collect_set("entry").alias("_ignored"))
    return events.crossJoin(F.broadcast(all_ignored)).filter(F.col(path).isNull() | ~F.arrays_overlap(keys, "_ignored")).drop("_ignored")


def overlay(base: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """Dirty rows replace base rows of their key and are marked advisory; works with a static or a streaming dirty side
    (then only dirty rows come out, joined to what they replace)."""
    values = [c for c in base.columns if c != key]
    d = dirty.select(key, *[F.col(c).alias("d_" + c) for c in values], F.lit(True).alias("advisory"))
    how = "left" if dirty.isStreaming else "full_outer"
    left, right = (d, base) if dirty.isStreaming else (base, d)
    joined = left.join(right, key, how)
    mark = F.coalesce("advisory", F.lit(False))
    return joined.select(key, *[F.when(mark, F.col("d_" + c)).otherwise(F.col(c)).alias(c) for c in values], mark.alias("advisory"))


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Session windows per key: start, end, n."""
    w = F.session_window(F.col(at), gap)
    return events.withWatermark(at, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there now into a memory table and return it."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def latest_state(events: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """The newest value of each key over all events so far (complete or update mode)."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
