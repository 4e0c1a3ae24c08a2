"""Joins that keep abstentions: presence states, differences both ways, containment and overlap on an equality and a bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sweep


def change_status(base: DataFrame, head: DataFrame, key: str, mode: str, digest: str) -> DataFrame:
    """added, deleted, type-changed, modified, unchanged or unknown for every key of either side."""
    b = base.select(F.col(key), F.col(mode).alias("b_mode"), F.col(digest).alias("b_digest"), F.lit(1).alias("b_in"))
    h = head.select(F.col(key), F.col(mode).alias("h_mode"), F.col(digest).alias("h_digest"), F.lit(1).alias("h_in"))
    status = (
        F.when(F.col("b_in").isNull(), "added")
        .when(F.col("h_in").isNull(), "deleted")
        .when(F.col("b_digest").isNull() | F.col("h_digest").isNull(), "unknown")
        .when(~F.col("b_mode").eqNullSafe(F.col("h_mode")), "type-changed")
        .when(F.col("b_digest") != F.col("h_digest"), "modified")
        .otherwise("unchanged")
    )
    return b.join(h, key, "full_outer").select(key, status.alias("status"))


def set_difference(base: DataFrame, head: DataFrame, key: str, item: str) -> DataFrame:
    """Per key the items of one side only and of both; a key that one side lacks is UNKNOWN."""
    b = base.groupBy(key).agg(F.collect_set(item).alias("b"))
    h = head.groupBy(key).agg(F.collect_set(item).alias("h"))
    both = b.join(h, key, "full_outer")
    joined = lambda a, c: F.array_join(F.array_sort(F.array_except(a, c)), ",")
    return both.select(
        key,
        F.when(F.col("b").isNull() | F.col("h").isNull(), "UNKNOWN").when(F.array_sort("b") == F.array_sort("h"), "same").otherwise("changed").alias("state"),
        joined(F.col("b"), F.col("h")).alias("base_only"),
        joined(F.col("h"), F.col("b")).alias("head_only"),
        F.size(F.array_intersect("b", "h")).alias("shared"),
    )


def one_sided(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Keys of one side only, with the name of what they lack."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("reason", F.lit(names[0])).unionByName(b.join(a, key, "left_anti").withColumn("reason", F.lit(names[1])))


def match_state(matches: Column) -> Column:
    return F.when(matches == 0, "missing").when(matches == 1, "associated").otherwise("ambiguous")


def containing(points: DataFrame, spans: DataFrame, keys: Sequence[str], low: str, high: str, start: str, end: str) -> DataFrame:
    """Points (low to high, one column for both is a place) inside closed spans, once for each span around them."""
    ask = points.withColumn("_to", F.col(high))
    wide = spans.withColumn("open", F.col(start).cast("long") - 1).withColumn("close", F.col(end).cast("long") + 1)
    return sweep.meeting(ask, wide, keys, low, "_to").drop("_to", "open", "close")


def overlapping(a: DataFrame, b: DataFrame, width: int, start: str, end: str, prefix: str = "o_") -> DataFrame:
    """Pairs of closed integer intervals that meet, without a nested loop: both sides go to the bins that they touch,
    and a pair is kept in the bin where the later of the two starts."""
    binned = lambda df, s, e: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    right = b.select(*[F.col(c).alias(prefix + c) for c in b.columns])
    left, right = binned(a, start, end), binned(right, prefix + start, prefix + end)
    later = F.floor(F.greatest(F.col(start), F.col(prefix + start)) / width)
    hit = (F.col(start) <= F.col(prefix + end)) & (F.col(prefix + start) <= F.col(end)) & (F.col("_bin") == later)
    return left.join(right, "_bin").filter(hit).drop("_bin")


def ancestors(path: Column) -> Column:
    """All prefixes of a path that end at a segment, longest first: turns a prefix join into an equality."""
    parts = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Every path with the most specific root over it, or null."""
    steps = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("_up", root))
    best = steps.join(roots.select(root).distinct(), root).groupBy(path).agg(F.min_by(root, "_up").alias(root))
    return paths.join(best, path, "left")
