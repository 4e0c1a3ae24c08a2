"""Interval algebra by sorting and running sums; long intervals are never expanded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def union(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Merge intervals of a key that touch or overlap: keys, start, end, members."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.select(*keys, start, end).withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_island")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """What half-open intervals of a cover and those of b do not."""
    edges = lambda df, p, q: df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(p).alias("p"), F.lit(q).alias("q")), F.struct(F.col(end).alias("at"), F.lit(-p).alias("p"), F.lit(-q).alias("q")))).alias("e"))
    points = edges(a, 1, 0).unionByName(edges(b, 0, 1)).groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.p").alias("p"), F.sum("e.q").alias("q"))
    order = Window.partitionBy(*keys).orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.withColumn("_a", F.sum("p").over(run)).withColumn("_b", F.sum("q").over(run)).withColumn("_next", F.lead("at").over(order))
    pieces = swept.filter((F.col("_a") > 0) & (F.col("_b") == 0) & F.col("_next").isNotNull()).select(*keys, F.col("at").alias(start), F.col("_next").alias(end))
    return union(pieces, keys, start, end).drop("members")


def narrowest(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, order: str, point: Sequence[str]) -> DataFrame:
    """For each point the narrowest closed span over it; of equals the later in order."""
    inside = points.join(spans, list(keys)).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    best = Window.partitionBy(*point).orderBy(F.col(end) - F.col(start), F.desc(order))
    return inside.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def map_lines(lines: DataFrame, hunks: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Old lines to new by the shifts of earlier hunks (old_start, old_count, new_count); ok is false inside a hunk, where
    the hunk's own start is given. As-of by union and a running sum, without a join."""
    events = hunks.select(*keys, F.col("old_start").alias("at"), F.lit(0).alias("kind"), (F.col("new_count") - F.col("old_count")).alias("shift"), "old_start", F.col("old_count"), F.lit(None).cast("long").alias(line))
    asked = lines.select(*keys, F.col(line).alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("shift"), F.lit(None).cast("long").alias("old_start"), F.lit(None).cast("long").alias("old_count"), F.col(line).cast("long").alias(line))
    upto = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = events.unionByName(asked).withColumn("_sum", F.sum("shift").over(upto)).withColumn("_start", F.last("old_start", True).over(upto)).withColumn("_count", F.last("old_count", True).over(upto))
    both = both.withColumn("_own", F.last(F.when(F.col("kind") == 0, F.col("shift")), True).over(upto))
    inside = F.col("at") < F.col("_start") + F.col("_count")
    ok = ~F.coalesce(inside, F.lit(False))
    return both.filter("kind = 1").select(*keys, line, F.when(ok, F.col(line) + F.col("_sum")).otherwise(F.col("_start") + F.col("_sum") - F.col("_own")).cast("long").alias("mapped"), ok.alias("ok"))
