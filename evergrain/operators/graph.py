"""Bounded reachability over edge tables. A frontier moves by one join a hop; lineage is cut each hop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of names that one task takes.
_ROWS = 200_000


def _cut(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read back, so that a hop does not plan all hops before it again, and is planned
    by its true size. Only a local session without a shared folder gets a temporary one; a cluster must name its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evergrain-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes within depth hops of the seeds (node) along edges (src, dst), at their least distance."""
    found = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    frontier = found.select("node")
    for hop in range(1, depth + 1):
        step = edges.join(frontier, edges.src == frontier.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(found, "node", "left_anti"))
        found = found.unionByName(frontier.withColumn("hops", F.lit(hop)))
    return found


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int, sep: str = ">") -> DataFrame:
    """(node, hops, path): of the shortest paths from any seed, that which is least as text."""
    found = seeds.select("node").distinct().select("node", F.lit(0).alias("hops"), F.col("node").cast("string").alias("path"))
    frontier = found
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src"), "path"), "src")
        step = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.concat_ws(sep, "path", F.col("dst").cast("string"))).alias("path"))
        frontier = _cut(step.join(found, "node", "left_anti").select("node", F.lit(hop).alias("hops"), "path"))
        found = found.unionByName(frontier)
    return found


def identifier_graph(definers: DataFrame, mentions: DataFrame, most_definers: int = 5, most_mentions: int = 50) -> DataFrame:
    """(src, dst, weight), both ways: files joined by names (name, path) that one defines and the other mentions. Names
    are 4 to 128 ASCII characters, not all in lower case; common ones carry nothing, so each name's pairs are bounded."""
    fit = F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]{3,127}$") & F.col("name").rlike("[A-Z_]") & ~F.col("name").rlike("^[A-Z][a-z0-9]*$")
    # tasks are as many as the rows need: what one of them holds does not grow with the tables
    n = max(1, -(-(definers.count() + mentions.count()) // _ROWS))

    def few(df, most, at):
        rows = df.filter(fit).select("name", "path").repartition(n, "name").distinct()
        held = rows.withColumn("_n", F.count("path").over(Window.partitionBy("name")))
        return held.filter(F.col("_n") <= most).select("name", F.col("path").alias(at))

    pairs = few(definers, most_definers, "a").join(few(mentions, most_mentions, "b"), "name").filter("a <> b")
    # a name's rows stay together until its pairs are told apart
    named = pairs.select("name", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    one = named.select("src", "dst").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return one.select(F.explode(ways).alias("_e"), "weight").select("_e.src", "_e.dst", "weight")


def forward_push(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, least: float = 1e-5, most_nodes: int | None = 1 << 20, most_arcs: int | None = 1 << 21, most_pushes: int | None = 200_000) -> DataFrame | None:
    """(node, rank, residual): personalised PageRank over (src, dst, weight) by pushing: every node whose residual is ``least`` or
    more keeps the restart's share of it and hands the rest on by weight, all of them at once, until no residual is that
    great. Rank and residual sum to 1, but for what nodes without edges keep to themselves. None past a bound on nodes, arcs or
    pushes: an answer that was cut would not be one. A bound of None is none: a push keeps at least ``restart * least`` of a sum
    of 1, so their number has an end of its own."""
    sized = edges.groupBy("src").agg(F.sum("weight").alias("out"), F.count(F.lit(1)).alias("arcs"))
    step = _cut(edges.join(sized.select("src", "out"), "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    own = seeds.select("node").distinct()
    n = own.count()
    over = lambda value, most: most is not None and value > most
    if not n or over(step.count(), most_arcs) or (most_nodes is not None and over(step.agg(F.approx_count_distinct("src")).first()[0], most_nodes)):
        return None
    held = own.select("node", F.lit(0.0).alias("rank"), F.lit(1.0 / n).alias("residual"))
    pushes = 0
    while True:
        held = _cut(held)
        active = held.filter(F.col("residual") >= least)
        now = active.count()
        if not now:
            return held
        pushes += now
        if over(pushes, most_pushes):
            return None
        hot = F.col("residual") >= least
        kept = held.select("node", F.when(hot, F.col("rank") + F.col("residual") * restart).otherwise(F.col("rank")).alias("rank"), F.when(hot, 0.0).otherwise(F.col("residual")).alias("residual"))
        given = active.join(step, active.node == step.src).groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("residual") * F.col("p")) * (1 - restart)).alias("given"))
        held = kept.join(given, "node", "full_outer").select("node", F.coalesce("rank", F.lit(0.0)).alias("rank"), (F.coalesce("residual", F.lit(0.0)) + F.coalesce("given", F.lit(0.0))).alias("residual"))


def personal_rank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, hops: int = 3, top: int = 5, most_seeds: int = 16, **bounds) -> DataFrame:
    """(node, score): the best nodes by forward_push() that are no seeds and within ``hops`` of one; of more seeds than
    ``most_seeds`` the first are taken. No rows without a seed, or past a bound of forward_push()."""
    own = _cut(seeds.select("node").distinct().orderBy("node").limit(most_seeds))
    pushed = forward_push(edges, own, restart, **bounds)
    if pushed is None:
        return own.select("node", F.lit(0.0).alias("score")).limit(0)
    near = reach(edges, own, hops).select("node")
    ranked = pushed.filter("rank > 0").select("node", F.round("rank", 7).alias("score")).join(near, "node", "left_semi").join(own, "node", "left_anti")
    return ranked.orderBy(F.desc("score"), "node").limit(top)
