"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas. DataFrame functions only.

Targets: sources by code point (null last) weigh 1, 2, 3, repeating, and share all words; a source's target stops at
``most`` times its size and the excess is reshared by weight until none is above. That is one level L with
target = min(most * size, L * weight), found with two running sums over the sources ordered by size / weight.

Blocks: rows of a source are dealt into ``blocks`` by a hash (512, or four for each output shard if that is more), so the
hot source is in as many pieces as any other. Rows that agree in every column are counted before they move and dealt by
their number among their like, so copies go to different blocks. A
pass over a source takes its blocks in a hashed order; a target above the size goes on with a further pass. The quota of
a source is the number of draws whose words reach its target; the last of them is taken row by row, in hashed order, as
far as the target allows, and one more row of the source, of the size nearest to what is missing, makes that up. Thus
every row is taken 0 to ``most`` times.

Splitting tree: the draws of all sources fill ``shards`` output shards of equal numbers of draws. From the root each node
halves its shards; how many of each source's draws go left is a hypergeometric variate given what the sources before it
took, drawn by inversion with a hashed uniform number, so the quotas of the leaves add up exactly and reruns agree.
A shard takes its share of each source's order as a run of draws; runs are disjoint. Inside a shard rows are ordered by
a hash. The tree is a table of sources x shards numbers.

Corners: null text has size 0 and is never taken (taken 0); an empty table gives an empty result; null sources are one
source; rows that agree in all columns are rows of their own, each with its own decision; if all sizes are 0 all targets are
0; other columns, whatever their names and types, are ignored by mix() and come through emit() as they are. The targets are
found with windows over the table of sources, one row a source, and a node of the tree holds one number a source: sources
are to be few beside the rows (sites by the million still fit a task, documents as their own sources would not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, keep, scan_parts


def _key(docs: DataFrame) -> Column:
    """The hash that orders rows; only rows that agree in all columns share it."""
    own = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in sorted(docs.dtypes)]
    there = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in sorted(docs.columns)])
    return F.xxhash64(*own, there)


def _block(mix: Column, copy: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(mix, F.lit(seed), copy), F.lit(blocks)).cast("int")


def _copies(rows: DataFrame) -> DataFrame:
    """Each row n times, numbered from 0 in ``copy``; a number is spelled in two digits, so no array grows with n."""
    digit = 1 << 16
    high = rows.withColumn("_high", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / digit))))
    low = high.withColumn("_low", F.explode(F.sequence(F.lit(0), F.least(F.lit(digit - 1), F.col("n") - 1 - F.col("_high") * digit))))
    return low.withColumn("copy", (F.col("_high") * digit + F.col("_low")).cast("long")).drop("_high", "_low")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, mix, n: n rows of docs agree in all columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(docs).alias("mix"))
    return own.groupBy("doc_id", "source", "size", "mix").agg(F.count(F.lit(1)).alias("n"))


def targets(by_source: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target from (source, source_size). One row a source: the windows run over that few."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = by_source.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    below = level.rowsBetween(Window.unboundedPreceding, -1)
    run = (
        weighed.withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
        .withColumn("own", F.col("left") / F.col("rest"))
    )
    # the level is that of the first source, in this order, that stays at or below its cap
    free = run.withColumn("level", F.min(F.when(F.col("own") * F.col("weight") <= F.col("cap"), F.struct(F.col("source_size") / F.col("weight"), F.col("own")))).over(every))
    share = F.col("level").getField("own") * F.col("weight")
    return free.select("source", "source_size", F.least(F.coalesce(share, F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact below 20, Stirling's series from there (better than 1e-13)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.log(F.factorial(F.greatest(n, F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def _choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` from good + bad are good, by inversion at u: sums over the support from its low end."""
    low, high = F.greatest(F.lit(0), draws - bad), F.least(good, draws)
    first = _choose(good, low) + _choose(bad, draws - low) - _choose(good + bad, draws)

    def step(state: Column, k: Column) -> Column:
        # log pmf at k, summed mass up to k, the first k whose mass reaches u
        mass = state["mass"] + F.exp(state["log"])
        k = k.cast("long")
        up = F.log(((good - k) * (draws - k)).cast("double") / ((k + 1) * (bad - draws + k + 1)).cast("double"))
        return F.struct(F.coalesce(state["log"] + up, F.lit(-1e300)).alias("log"), mass.alias("mass"), F.when(state["k"] >= 0, state["k"]).when(mass >= u, k).otherwise(F.lit(-1).cast("long")).alias("k"))

    start = F.struct(first.cast("double").alias("log"), F.lit(0.0).alias("mass"), F.lit(-1).cast("long").alias("k"))
    got = F.aggregate(F.sequence(low, high), start, step, lambda s: s["k"])
    return F.when(got >= 0, got).otherwise(high)


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """source, shard, first, last: the run of each source's draws (from 0, last excluded) that a shard takes.

    quotas: (source, quota). A node is a row: its shards and an array of (source, quota, offset)."""
    item = "struct<source:string,quota:bigint,first:bigint>"
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("quota"), F.lit(0).cast("long").alias("first")))).cast(f"array<{item}>").alias("items")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "items"
    )
    width = shards
    while width > 1:
        width = (width + 1) // 2
        half = F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")).otherwise(F.col("hi"))
        total = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["quota"])
        nodes = nodes.withColumn("mid", half).withColumn("total", total)
        nodes = nodes.withColumn("draws", F.floor(F.col("total") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long"))

        def take(state: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(x["source"], F.col("lo"), F.col("hi"), F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
            drawn = F.array(hypergeometric(x["quota"], state["rest"] - x["quota"], state["draws"], u))
            after = lambda n: F.struct((state["rest"] - x["quota"]).alias("rest"), (state["draws"] - n).alias("draws"), F.concat(state["left"], F.array(n)).alias("left"))
            return F.element_at(F.transform(drawn, after), 1)

        start = F.struct(F.col("total").alias("rest"), F.col("draws").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("left"))
        nodes = nodes.withColumn("left", F.aggregate("items", start, take, lambda s: s["left"]))
        left = F.zip_with("items", "left", lambda x, n: F.struct(x["source"].alias("source"), n.alias("quota"), x["first"].alias("first")))
        right = F.zip_with("items", "left", lambda x, n: F.struct(x["source"].alias("source"), (x["quota"] - n).alias("quota"), (x["first"] + n).alias("first")))
        child = F.array(F.struct("lo", F.col("mid").alias("hi"), left.alias("items")), F.struct(F.col("mid").alias("lo"), "hi", right.alias("items")))
        nodes = nodes.select(F.explode(child).alias("n")).select("n.lo", "n.hi", "n.items").filter("lo < hi")
    return nodes.select(F.col("lo").alias("shard"), F.explode("items").alias("x")).select("shard", "x.source", "x.first", (F.col("x.first") + F.col("x.quota")).alias("last")).filter("first < last")


def shards_for(docs: DataFrame) -> int:
    """Output shards: the partitions of the input as a power of two, 16 at least."""
    return max(16, 1 << (scan_parts(docs) - 1).bit_length())


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int | None = None, shards: int | None = None, seed: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the sizes of all rows (see sizes()); by block what is taken of it (source, block, source_size, target,
    times, room, shards); the rows that are taken once more than their block (e_id, e_mix, e_copy, e_shard)."""
    shards = shards or shards_for(docs)
    blocks = blocks or blocks_for(shards)
    sized = keep(sizes(docs), "mix-sizes")
    rows = _copies(sized).withColumn("block", _block(F.col("mix"), F.col("copy"), blocks, seed))
    by_block = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    by_source = keep(targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most), "mix-targets")
    aimed = by_block.join(by_source.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    order = Window.partitionBy("source").orderBy("pass", F.xxhash64("source", "block", "pass", F.lit(seed)), "block")
    draws = (
        aimed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("upto", F.sum("words").over(order))
        .filter((F.col("words") > 0) & (F.col("upto") - F.col("words") < F.col("target")))
        .withColumn("draw", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("room", F.when(F.col("upto") > F.col("target"), F.col("target") - F.col("upto") + F.col("words")))
    )
    draws = keep(draws.select("source", "block", "draw", "room"), "mix-draws")
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    runs = keep(split(quotas, shards, seed), "mix-runs").withColumnRenamed("source", "r_source")
    dealt = draws.join(runs, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("last")))
    taken = dealt.groupBy(F.col("source").alias("t_source"), F.col("block").alias("t_block")).agg(
        F.sort_array(F.collect_list(F.when(F.col("room").isNull(), F.col("shard")))).alias("shards"),
        F.max("room").alias("room"),
        F.max(F.when(F.col("room").isNotNull(), F.col("shard"))).alias("edge_shard"),
    )
    by_block = aimed.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block")), "left").select(
        "source", "block", "source_size", "target", F.coalesce(F.size("shards"), F.lit(0)).alias("times"), "room", F.coalesce("shards", F.expr("cast(array() as array<int>)")).alias("shards"), "edge_shard"
    )
    by_block = keep(by_block, "mix-blocks")
    partly = by_block.filter("room is not null").select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "room", "edge_shard")
    inside = Window.partitionBy("source", "block").orderBy("mix", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    edge = keep(
        rows.filter("size > 0")
        .join(partly, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
        .withColumn("upto", F.sum("size").over(inside))
        .filter(F.col("upto") <= F.col("room"))
        .select("source", F.col("doc_id").alias("e_id"), F.col("mix").alias("e_mix"), F.col("copy").alias("e_copy"), F.col("edge_shard").alias("e_shard"), "size"),
        "mix-edge",
    )
    # of the source's other rows, the one whose size comes nearest to what is still missing
    got = edge.groupBy(F.col("source").alias("g_source")).agg(F.sum("size").alias("got"))
    short = keep(partly.join(got, F.col("b_source").eqNullSafe(F.col("g_source")), "left").select("b_source", "edge_shard", (F.col("room") - F.coalesce("got", F.lit(0))).alias("short")), "mix-short")
    free = by_block.filter((F.col("times") < most) & F.col("room").isNull()).select(F.col("source").alias("f_source"), F.col("block").alias("f_block"))
    far = F.abs(F.col("size") - F.col("short"))
    last = (
        rows.filter("size > 0")
        .join(free, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("block") == F.col("f_block")))
        .join(short, F.col("source").eqNullSafe(F.col("b_source")))
        .filter(far < F.col("short"))
        .groupBy("source")
        .agg(F.min(F.struct(far.alias("far"), "mix", "doc_id", "copy", "edge_shard")).alias("x"))
        .select(F.col("x.doc_id").alias("e_id"), F.col("x.mix").alias("e_mix"), F.col("x.copy").alias("e_copy"), F.col("x.edge_shard").alias("e_shard"))
    )
    return sized, by_block, keep(edge.select("e_id", "e_mix", "e_copy", "e_shard").unionByName(last), "mix-more")


def blocks_for(shards: int) -> int:
    return max(512, 4 * shards)


def _decided(rows: DataFrame, by_block: DataFrame, edge: DataFrame) -> DataFrame:
    """rows (with _source, _block, _id, _mix, _copy) with the columns of their block and all shards that take them."""
    blocks = by_block.withColumnRenamed("source", "b_source").withColumnRenamed("block", "b_block")
    out = rows.join(blocks, F.col("_source").eqNullSafe(F.col("b_source")) & (F.col("_block") == F.col("b_block")))
    out = out.join(edge, F.col("_id").eqNullSafe(F.col("e_id")) & (F.col("_mix") == F.col("e_mix")) & (F.col("_copy") == F.col("e_copy")), "left")
    more = F.when(F.col("e_mix").isNotNull(), F.array("e_shard")).otherwise(F.expr("cast(array() as array<int>)"))
    return out.withColumn("_shards", F.concat("shards", more))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int | None = None, shards: int | None = None, seed: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and shards: the leaves of the tree that take it."""
    shards = shards or shards_for(docs)
    blocks = blocks or blocks_for(shards)
    sized, by_block, edge = plan(docs, weights, most, blocks, shards, seed)
    named = _copies(sized).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mix").alias("_mix"), F.col("copy").alias("_copy"), _block(F.col("mix"), F.col("copy"), blocks, seed).alias("_block"), "size")
    # rows without words stand in no shard
    took = F.when(F.col("size") > 0, F.col("_shards")).otherwise(F.expr("cast(array() as array<int>)"))
    return _decided(named, by_block, edge).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("_shards")).alias("taken"), took.alias("shards"))


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int | None = None, shards: int | None = None, seed: int = 20, numbered: bool = True) -> DataFrame:
    """The mix itself: all columns of docs, once for each time that a row is taken, then _shard (if ``numbered``); shards
    are dealt out whole and shuffled inside. Rows of size 0 and rows not taken are not there."""
    shards = shards or shards_for(docs)
    blocks = blocks or blocks_for(shards)
    sized, by_block, edge = plan(docs, weights, most, blocks, shards, seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the columns of docs travel as one, so that none of their names can meet one of ours
    own = docs.filter(text.rlike(WORD)).select(F.struct("*").alias("_own"), F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), _key(docs).alias("_mix"))
    again = keep(sized.filter("n > 1 and size > 0").groupBy(F.col("mix").alias("a_mix")).agg(F.max("n").alias("n")), "mix-again")
    once = own.join(again, F.col("_mix") == F.col("a_mix"), "left_anti").withColumn("copy", F.lit(0).cast("long"))
    # of rows that agree in all columns one moves, and stands for each of them in turn
    like = _copies(own.dropDuplicates(["_mix"]).join(again, F.col("_mix") == F.col("a_mix")).drop("a_mix")).drop("n")
    if again.isEmpty():
        every = once
    else:
        every = once.unionByName(like)
    every = every.withColumnRenamed("copy", "_copy").withColumn("_block", _block(F.col("_mix"), F.col("_copy"), blocks, seed))
    each = _decided(every, by_block.select("source", "block", "shards"), edge).select("_own", "_mix", "_copy", F.posexplode("_shards").alias("_pass", "_shard"))
    out = each.repartition("_shard").sortWithinPartitions("_shard", F.xxhash64("_mix", "_copy", "_pass", F.lit(seed)))
    return out.select("_own.*", "_shard") if numbered else out.select("_own.*")
