"""Sets of blocks by test: equality classes, containment, co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sweep
from .graph import _cut


def signatures(sets: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, items, signature): equal sets have equal signatures."""
    got = sets.groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return got.select(owner, "items", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256).alias("signature"))


def classes(sets: DataFrame, owner: str, item: str) -> DataFrame:
    """(signature, owners, first): groups of owners with the same set."""
    return signatures(sets, owner, item).groupBy("signature").agg(F.count(F.lit(1)).alias("owners"), F.min(owner).alias("first"), F.max(F.size("items")).alias("blocks"))


def contained(sets: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, within, size, within_size): every owner whose set is a strict subset of another's, with the tightest.

    An owner looks only at the holders of its rarest item, so the join follows the rarest item's count."""
    rows = sets.select(owner, item).distinct()
    sized = rows.groupBy(owner).agg(F.count(F.lit(1)).alias("size"))
    rare = rows.groupBy(item).agg(F.count(F.lit(1)).alias("df"))
    pick = rows.join(rare, item).groupBy(owner).agg(F.min_by(item, F.struct("df", item)).alias(item))
    near = pick.join(rows.withColumnRenamed(owner, "within"), item).filter(F.col(owner) != F.col("within")).select(owner, "within")
    near = near.join(sized, owner).join(sized.select(F.col(owner).alias("within"), F.col("size").alias("within_size")), "within").filter("within_size > size")
    shared = near.join(rows, owner).join(rows.withColumnRenamed(owner, "within"), ["within", item], "left_semi").groupBy(owner, "within", "size", "within_size").agg(F.count(F.lit(1)).alias("n"))
    full = shared.filter(F.col("n") == F.col("size"))
    best = full.groupBy(owner, "size").agg(F.min(F.struct("within_size", "within")).alias("x"))
    return best.select(owner, F.col("x.within").alias("within"), "size", F.col("x.within_size").alias("within_size"))


def cochange(changes: DataFrame, commit: str, path: str, most: int) -> DataFrame:
    """(a, b, n): pairs of paths of commits with at most ``most`` paths, by how many commits they share. Commits are counted
    before any is gathered."""
    rows = changes.select(commit, path).distinct()
    few = rows.groupBy(commit).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= most).select(commit)
    small = rows.join(few, commit, "left_semi").groupBy(commit).agg(F.array_sort(F.collect_list(path)).alias("p"))
    pairs = small.select(F.posexplode("p").alias("i", "a"), "p").select("a", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def common_blocks(observed: DataFrame, file: str, run: str, start: str, end: str, hit: str) -> DataFrame:
    """(file, start, end, runs): every file cut into the same blocks for all runs, at each point where the state of any run
    changes, with the sorted runs that executed a block. observed: half-open spans of a run, executed (hit) or not; a span that ran
    outweighs one that did not. What no run observed is in no block."""
    spans = observed.select(F.col(file).alias("file"), F.col(run).cast("string").alias("run"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.col(hit).alias("hit")).filter("start < end")
    spans = _cut(spans.distinct())  # read three times: its ends, its mean length and its places
    points = spans.select("file", F.explode(F.array("start", "end")).alias("at")).distinct()
    order = Window.partitionBy("file").orderBy("at")
    pieces = points.withColumn("next", F.lead("at").over(order)).filter("next is not null").withColumn("_at", F.col("at"))
    # a span is the body around each piece inside it
    bodies = spans.select("file", (F.col("start") - 1).alias("open"), F.col("end").alias("close"), "run", "hit")
    inside = sweep.meeting(pieces, bodies, ["file"], "at", "_at")
    # a file's rows are dealt once, for its pieces, for what changes between them and for the blocks
    told = inside.repartition("file").groupBy("file", "at", "next").agg(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("run")))).alias("runs"))
    same = (F.lag("next").over(order) == F.col("at")) & (F.lag("runs").over(order) == F.col("runs"))
    island = F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = told.withColumn("_island", island).groupBy("file", "_island").agg(F.min("at").alias("start"), F.max("next").alias("end"), F.first("runs").alias("runs"))
    return _cut(merged.select(F.col("file").alias(file), "start", "end", "runs"))


def profiles(blocks: DataFrame, observed: DataFrame, file: str, run: str) -> DataFrame:
    """(run, file, line, start, end, ran): a line of a cover profile for each run that observed a file and each of the file's common
    blocks, and what the line says."""
    own = observed.select(F.col(run).cast("string").alias("run"), F.col(file)).distinct()
    n = lambda c: F.col(c).cast("string")
    ran = F.array_contains("runs", F.col("run"))
    line = F.concat(n(file), F.lit(":"), n("start"), F.lit(".1,"), n("end"), F.lit(".1 1 "), ran.cast("int").cast("string"))
    return own.join(blocks, file).select("run", file, line.alias("line"), "start", "end", ran.alias("ran"))


def first_lines(blocks: DataFrame, observed: DataFrame, file: str, run: str) -> DataFrame:
    """(run, line): the least line of each run's profile, as text. Lines of a file differ first in where they start, so only the first
    block of each file is written out for its runs, and no text is sorted for the others."""
    head = F.concat(F.col("start").cast("string"), F.lit(".")).alias("_head")
    first = blocks.groupBy(file).agg(F.min(F.struct(head, "start", "end", "runs")).alias("b")).select(file, "b.start", "b.end", "b.runs")
    return profiles(first, observed, file, run).groupBy("run").agg(F.min("line").alias("line"))
