"""Ordered-sequence operators: one window each, on the sequence's own key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import _cut


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in total order, by a partial aggregate instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def representative(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def continuity(df: DataFrame, keys: Sequence[str], at: str, step: int = 1) -> DataFrame:
    """Per key whether each element follows the one before it, how many breaks there are, and where the first is."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    broken = before.isNotNull() & (F.col(at) != before + step)
    flagged = df.withColumn("_broken", broken)
    return flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_broken").cast("int")).cast("long").alias("breaks"), F.min(F.when(F.col("_broken"), F.col(at))).alias("first_break"))


def around(df: DataFrame, keys: Sequence[str], at: str, item: str) -> DataFrame:
    """Every element with what came before and what comes after it, joined in order."""
    w = Window.partitionBy(*keys).orderBy(at)
    prior = F.collect_list(item).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.collect_list(item).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("prior", F.array_join(prior, ">")).withColumn("later", F.array_join(later, ">"))


def disambiguate(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The k-th repeat of a name gets #k; all of its holders are marked."""
    w = Window.partitionBy(name)
    k = F.row_number().over(w.orderBy(*order))
    return df.withColumn("duplicate", F.count(F.lit(1)).over(w) > 1).withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), k.cast("string"))))


def first_n(df: DataFrame, keys: Sequence[str], item: str, n: int) -> DataFrame:
    """The first n distinct items of a key in order, and how many more there are."""
    items = F.array_sort(F.collect_set(item))
    got = df.groupBy(*keys).agg(items.alias("_i"))
    return got.select(*keys, F.array_join(F.slice("_i", 1, n), ",").alias("shown"), F.greatest(F.size("_i") - n, F.lit(0)).alias("more"))


def numbered(df: DataFrame, key: Column, then: Sequence[Column], name: str = "place") -> DataFrame:
    """df with its place, from 1, in the total order (key, then), null keys first: ranges of that order are sorted and numbered apart,
    and shifted by the sizes of those before them. Rows of one key, or of none, part by the further order."""
    dealt = df.repartitionByRange(key, *then).sortWithinPartitions(key, *then)
    # the upper bits are the range, the lower ones the row in it
    placed = _cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", before.alias("_before"))  # a row a range
    return placed.withColumn("_part", part).join(F.broadcast(shifts), "_part").withColumn(name, (row + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_before")


def new_minimum_stop(rounds: DataFrame, keys: Sequence[str], at: str, left: str) -> DataFrame:
    """keys, stop: the first round, in order, after which a loop stops: nothing is left, or neither this round nor the one
    before it came under all earlier ones. Null if it goes on."""
    order = Window.partitionBy(*keys).orderBy(at)
    least = F.min(left).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stale = rounds.withColumn("_stale", least.isNotNull() & (F.col(left) >= least))
    ends = (F.col(left) == 0) | (F.col("_stale") & F.coalesce(F.lag("_stale").over(order), F.lit(False)))
    return stale.withColumn("_ends", ends).groupBy(*keys).agg(F.min(F.when(F.col("_ends"), F.col(at))).alias("stop"))


def halved_page(df: DataFrame, order: Sequence[Column], size: Column, most: int, budget: int) -> DataFrame:
    """The first rows in order, as many as the first of most, most / 2, most / 4, ... whose sizes fit the budget together."""
    first = df.orderBy(*order).limit(most).withColumn("_r", F.row_number().over(Window.orderBy(*order))).withColumn("_sum", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    steps = []
    while most:
        steps.append(most)
        most //= 2
    fits = first.agg(*[F.max(F.when(F.col("_r") <= n, F.col("_sum"))).alias(f"s{n}") for n in steps])
    size_of = F.coalesce(*[F.when(F.coalesce(F.col(f"s{n}"), F.lit(0)) <= budget, F.lit(n)) for n in steps], F.lit(0))
    return first.crossJoin(F.broadcast(fits.select(size_of.alias("_page")))).filter(F.col("_r") <= F.col("_page")).drop("_r", "_sum", "_page")


def tail_budget(df: DataFrame, keys: Sequence[str], section: str, rank: str, size: str, budget: int) -> DataFrame:
    """Rows that stay when whole rows go from the tail, sections from the last backwards, until their sizes fit."""
    order = Window.partitionBy(*keys).orderBy(section, rank).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_upto", F.sum(size).over(order)).filter(F.col("_upto") <= budget).drop("_upto")


def cut_points(states: DataFrame, keys: Sequence[str], run: str, at: str, state: str) -> DataFrame:
    """keys, start, end, and run with its state: every place of a key is cut where the state of any run changes, and each run's
    state is constant between two cuts."""
    order = Window.partitionBy(*keys, run).orderBy(at)
    cuts = states.withColumn("_was", F.lag(state).over(order)).filter(~F.col("_was").eqNullSafe(F.col(state))).select(*keys, F.col(at).alias("start")).distinct()
    blocks = cuts.withColumn("end", F.lead("start").over(Window.partitionBy(*keys).orderBy("start")))
    return blocks.join(states.withColumnRenamed(at, "start"), [*keys, "start"]).select(*keys, "start", "end", run, state)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) of a total order, with the number of rows that follow."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    return rows.withColumn("omitted", F.greatest(F.lit(0), F.col("_total") - offset - limit).cast("long")).drop("_total")


def byte_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """The longest prefix of each key's rows, in order, whose sizes fit the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bytes_upto", F.sum(size).over(w)).filter(F.col("bytes_upto") <= budget)
