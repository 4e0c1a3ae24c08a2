"""Grouped counts, ratios and summaries in which what is unknown stays a named state and never becomes a zero."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import _cut as cut


def top_groups(df: DataFrame, keys: Sequence[str], example: str, order: Sequence[str], examples: int = 3, groups: int = 5) -> DataFrame:
    """Groups with most rows, each with its first examples in order, counted and ordered in total.

    The few groups are chosen from counts first; rows of other groups are not sorted at all."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(groups)
    near = Window.partitionBy(*keys).orderBy(*order)
    first = df.join(F.broadcast(counts), list(keys), "left_semi").withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= examples)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(example).alias("x")))).alias("e"))
    return counts.join(shown, list(keys)).select(*keys, "n", F.array_join(F.transform("e", lambda s: s["x"].cast("string")), ",").alias("examples"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 over nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, 6))


def worst_of(state: Column, ranks: dict[str, int]) -> Column:
    """An aggregate: the state of greatest rank, by name."""
    rank = F.coalesce(*[F.when(state == k, F.lit(v)) for k, v in ranks.items()])
    return F.max_by(state, rank)


def strict_median(value: Column, complete: Column) -> Column:
    """An aggregate: the mean of the middle two, null if any row is incomplete."""
    return F.when(F.bool_and(complete), F.percentile(value, F.lit(0.5)))


def poisoned_ratio(part: Column, whole: Column) -> Column:
    """An aggregate: sum of part over sum of whole, null if any value of either is missing or the whole is 0."""
    missing = F.bool_or(part.isNull() | whole.isNull())
    return F.when(~missing & (F.sum(whole) > 0), F.sum(part) / F.sum(whole))


def agreed(value: Column) -> Column:
    """An aggregate: the value all rows share, else 'conflict'."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.lit("conflict"))


def nearest_rank(value: str, p: float) -> Column:
    """An aggregate: the value at position ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def saturating(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit counts, clamped at their greatest."""
    return F.least(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"), F.lit("18446744073709551615").cast("decimal(21,0)")).cast("decimal(20,0)")


def selected(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]], accuracy: int = 10_000) -> DataFrame:
    """keys, n and, per name of ``ranks``, the value of a rank among the key's n values (nulls are none): a share that the rank lies
    near, and the rank (from 1) of n. Exact, and no key's values ever meet in one task. Keys are not null.

    A sketch gives two values around each rank, an accuracy's share apart. One more pass counts what lies below the lower, and keeps
    what lies between, equal values as one row: of a key of 1e8 values some 4e4. Ranks that a sketch missed are looked
    for between wider values, and at last among all."""
    rows = rows.select(*keys, F.col(value).alias("_v")).filter("_v is not null")
    names, out, todo, width = list(ranks), None, None, 2.0 / accuracy
    while True:
        own = rows if todo is None else rows.join(todo, list(keys), "left_semi")
        edges = [max(0.0, ranks[x][0] - width) for x in names] + [min(1.0, ranks[x][0] + width) for x in names]
        sketch = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, edges)), F.lit(accuracy)).alias("_e"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        low = lambda i: F.col("_least") if edges[i] <= 0 else F.get("_e", F.lit(i))  # noqa: E731, B023
        high = lambda i: F.col("_most") if edges[len(names) + i] >= 1 else F.get("_e", F.lit(len(names) + i))  # noqa: E731, B023
        asked = sketch.select(*keys, "n", F.array(*[F.struct(F.lit(i).alias("i"), low(i).alias("low"), high(i).alias("high"), ranks[x][1](F.col("n")).cast("long").alias("rank")) for i, x in enumerate(names)]).alias("_asked"))
        # of each value and rank: below the lower edge (no value is kept), or between the edges
        near = own.join(asked, list(keys)).select(*keys, "n", "_v", F.explode(F.filter("_asked", lambda a: F.col("_v") <= a["high"])).alias("a"))
        place = F.when(F.col("_v") >= F.col("a.low"), F.col("_v"))
        counted = near.groupBy(*keys, "n", F.col("a.i").alias("i"), F.col("a.rank").alias("rank"), place.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        hit = counted.withColumn("_u", F.sum("_c").over(upto)).filter("_v is not null and _u >= rank and _u - _c < rank")
        got = hit.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("_v"))).alias(x) for i, x in enumerate(names)])
        got = cut(got)
        whole = F.lit(True)
        for x in names:
            whole = whole & F.col(x).isNotNull()
        done = got.filter(whole)
        out = done if out is None else out.unionByName(done)
        missed = cut(asked.select(*keys).join(done, list(keys), "left_anti"))
        if missed.isEmpty() or width >= 1:
            return out
        todo, width = missed, 1.0 if width >= 0.05 else width * 10


def nearest_ranks(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and per name the value at position ceil(share * n)."""
    at = lambda p: lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(p)))
    return selected(rows, keys, value, {x: (p, at(p)) for x, p in shares.items()})


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """keys, n, name: the mean of the middle two values."""
    two = selected(rows, keys, value, {"_a": (0.5, lambda n: F.floor((n + 1) / 2)), "_b": (0.5, lambda n: F.floor(n / 2) + 1)})
    return two.select(*keys, "n", ((F.col("_a") + F.col("_b")) / 2).alias(name))
