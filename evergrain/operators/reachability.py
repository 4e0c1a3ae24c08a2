"""Reachability over whole graphs without a row per (seed, node) and without a bound on depth.

Flags spread backwards as bit masks: a node's mask is the union of those of all it reaches, and an edge is followed again only when
its end has gained a bit. Chains (nodes with one successor) are closed first, inside ranges of nodes and then by pointer doubling, so a
path of n nodes takes some log n rounds; what is left takes as many rounds as its longest shortest path. Every loop runs until nothing
changes.

Histories are cut into chains of first parents, closed in the same way. What a commit reaches on a chain is all of it up to a place, so a set of
ancestors is one place a chain: distances are differences of places, ancestry is a comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import _cut

#: Open ways that are sent to all tasks.
_FEW = 1 << 20
#: Links that one task follows, about.
_ROWS = 1 << 18


def doubled(links: DataFrame, values: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """(node, to, *values, open): every node's link (node, to, *values) followed to its end, a node without a link, its values
    joined on the way by ``values[name](own, further)``. open: the way never ends, and the values cover its whole cycle.

    Each round joins the table with itself and doubles the steps behind every link. Ways that have ended are set aside: they
    are looked up, but not joined again, and once few ways are open only what those lead to is."""
    ways = lambda df: df.select(F.col("node").alias("to"), F.col("to").alias("_to"), *[F.col(v).alias("_" + v) for v in values], F.col("open").alias("_open"))
    further = F.col("_to").isNotNull()
    joined = [F.when(further, f(F.col(v), F.col("_" + v))).otherwise(F.col(v)).alias(v) for v, f in values.items()]
    cur = _cut(links.select("node", "to", *values).withColumn("open", F.lit(True)))
    ended, left, steps = cur.limit(0), cur.count(), 1
    while left:
        done = ways(ended)
        if left <= _FEW:  # what few open ways lead to is picked out where it lies: ended ways are not shuffled again
            done = done.join(F.broadcast(cur.select("to").distinct()), "to", "left_semi")
        moved = _cut(cur.join(ways(cur).unionByName(done), "to", "left").select("node", F.coalesce("_to", "to").alias("to"), *joined, F.coalesce("_open", F.lit(False)).alias("open")))
        ended, cur, steps = ended.unionByName(moved.filter(~F.col("open"))), moved.filter("open"), 2 * steps
        before, left = left, cur.count()
        # a way that ends loses its last open node in every round: if none is lost all are cycles, seen whole after as many steps
        if left == before and steps > left:
            break
    return ended.unionByName(cur)


def _within(links: DataFrame, value: str, n: int, both: np.ufunc) -> DataFrame:
    """(node, to, value, open): each of n links followed while its way stays in the node's range of about _ROWS of them. open: it never
    leaves; such a node leads to itself."""

    # it names nothing of this module: Python workers need no copy of the package
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        node, to = rows["node"].combine_chunks(), rows["to"].combine_chunks()
        then = pc.fill_null(pc.index_in(to, value_set=node, skip_nulls=True), -1).to_numpy(zero_copy_only=False).copy()
        sums, last, steps = rows[value].to_numpy().copy(), np.arange(len(to)), 1
        going = np.flatnonzero(then >= 0)
        while len(going) and steps <= len(to):
            on = then[going]
            sums[going], last[going], then[going] = both(sums[going], sums[on]), last[on], then[on]
            going, steps = going[then[going] >= 0], 2 * steps
        open_ = pa.array(then >= 0)
        out = pa.table({"node": node, "to": pc.if_else(open_, node, to.take(pa.array(last))), value: pa.array(sums), "open": open_})
        yield from out.to_batches(max_chunksize=1 << 16)

    kinds = {f.name: f.dataType.simpleString() for f in links.schema}
    dealt = links.select("node", "to", value).repartitionByRange(-(-n // _ROWS), "node")
    return dealt.mapInArrow(follow, f"node {kinds['node']}, to {kinds['to']}, {value} {kinds[value]}, open boolean")


def followed(links: DataFrame, value: str, add: Callable[[Column, Column], Column], both: np.ufunc) -> DataFrame:
    """doubled() for one value, a long, joined by ``add``, in numpy by ``both``. Ranges of nodes follow the links inside them; then only
    nodes that another range leads to have to be followed, which are few where keys go along the links. These are dealt to ranges
    again, and doubled as soon as a deal saves less than half."""
    cur, levels = _cut(links.select("node", "to", value)), []
    left = before = cur.count()
    while left and (not levels or 2 * left <= before):
        short = _cut(_within(cur, value, left, both))
        levels.append(short)
        entered = short.filter("not open").select(F.col("to").alias("node")).distinct()
        cur = _cut(short.join(entered, "node", "left_semi").select("node", "to", value))
        before, left = left, cur.count()
    out = doubled(cur, {value: add}) if left or not levels else levels.pop()
    for short in reversed(levels):
        on = out.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col(value).alias("_more"), F.col("open").alias("_open"))
        more = F.when(F.col("_to").isNotNull(), add(F.col(value), F.col("_more"))).otherwise(F.col(value))
        out = _cut(short.join(on, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), more.alias(value), (F.col("open") | F.coalesce("_open", F.lit(False))).alias("open")))
    return out


def spread(edges: DataFrame, own: DataFrame, written: bool = False) -> DataFrame:
    """(node, bits): of every node of ``edges`` (src, dst) and ``own`` (node, bits) the union of the bits of all that it
    reaches along edges, its own included. written: the edges are distinct and cheap to read again."""
    none, no = F.lit(None), F.lit(0).cast("long")
    edges = edges.select("src", "dst") if written else _cut(edges.select("src", "dst").distinct())
    # one pass counts a node's ways on, finds the least and joins its bits: nobody is looked up
    leave = F.col("src") != F.col("dst")
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.when(leave, F.col("dst")).alias("to")), F.struct(F.col("dst").alias("node"), none.cast(edges.schema["dst"].dataType).alias("to")))).alias("x")).select("x.node", "x.to", no.alias("bits"))
    nodes = ends.unionByName(own.select("node", none.cast(edges.schema["dst"].dataType).alias("to"), F.col("bits").cast("long").alias("bits")))
    nodes = _cut(nodes.groupBy("node").agg(F.bit_or("bits").alias("bits"), F.count("to").alias("n"), F.min("to").alias("to")))
    edges, links = edges.filter("src <> dst"), nodes.filter("n = 1").select("node", "to", "bits")
    if links.isEmpty():
        chains, core, held = None, edges, nodes.select("node", "bits")
    else:
        chains = _cut(followed(links, "bits", lambda a, b: a.bitwiseOR(b), np.bitwise_or))
        # edges of branching nodes lead to the ends of chains, and the bits on the way are the node's own
        ends = chains.select(F.col("node").alias("dst"), "to", F.col("bits").alias("more"), "open")
        branching = edges.join(nodes.filter("n > 1").select(F.col("node").alias("src")), "src", "left_semi").join(ends, "dst", "left")
        branching = _cut(branching.select("src", F.when(F.col("open"), F.lit(None)).otherwise(F.coalesce("to", "dst")).alias("dst"), F.coalesce("more", no).alias("more")))
        core = _cut(branching.filter("dst is not null and src <> dst").select("src", "dst").distinct())
        gained = branching.groupBy(F.col("src").alias("node")).agg(F.bit_or("more").alias("more"))
        held = nodes.filter("n <> 1").join(gained, "node", "left").select("node", F.col("bits").bitwiseOR(F.coalesce("more", no)).alias("bits"))
    held = _cut(held)
    front = held.filter("bits <> 0")
    while not front.isEmpty():
        news = core.join(front.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or("bits").alias("_new"))
        wider = _cut(held.join(news, "node", "left").select("node", F.coalesce(F.col("bits").bitwiseOR(F.col("_new")), "bits").alias("bits"), F.col("bits").alias("_old")))
        front, held = wider.filter("bits <> _old").select("node", "bits"), wider.select("node", "bits")
    if chains is None:
        return held
    far = held.select(F.col("node").alias("to"), F.col("bits").alias("_far"))
    return held.unionByName(chains.join(far, "to", "left").select("node", F.when(F.col("open"), F.col("bits")).otherwise(F.col("bits").bitwiseOR(F.coalesce("_far", F.lit(0).cast("long")))).alias("bits")))


def reached(edges: DataFrame, seeds: DataFrame, written: bool = False) -> DataFrame:
    """(node): the seeds (node) and all they reach along (src, dst); ``written`` as in spread()."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return spread(back, seeds.select("node", F.lit(1).alias("bits")), written).filter("bits <> 0").select("node")


def witnesses(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, hops, parent, kind): why a node is reached from the seeds (node) along edges (src, dst, kind): a shortest way, whose
    last step is of the least kind, then from the least parent. Seeds have no parent. The table is all chains, their shared
    beginnings stored once."""
    # edges are made once, the least of its kind for each pair; a node is left once its way in is known, and its edges go with it
    step = _cut(edges.filter("src <> dst").groupBy(F.col("src").alias("parent"), "dst").agg(F.min("kind").alias("kind")))
    seeds = _cut(seeds.select("node").distinct())
    front, held, parts, hops, kept, gone = seeds, seeds, [], 0, step.count(), seeds.count()
    while not front.isEmpty():
        hops += 1
        into = step.join(front.withColumnRenamed("node", "parent"), "parent").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("kind", "parent")).alias("w"))
        next_ = _cut(into.join(held, "node", "left_anti").select("node", F.lit(hops).alias("hops"), "w.parent", "w.kind"))
        parts.append(next_)
        front, held = next_.select("node"), held.unionByName(next_.select("node"))
        gone += next_.count()
        if 4 * gone > kept:  # edges into nodes that are held lead nowhere new
            step = _cut(step.join(held.withColumnRenamed("node", "dst"), "dst", "left_anti"))
            kept, gone, held = step.count(), 0, next_.select("node")
    out = seeds.select("node", F.lit(0).alias("hops"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(None).cast(edges.schema["kind"].dataType).alias("kind")).distinct()
    for part in parts:
        out = out.unionByName(part)
    return _cut(out)


def written_out(found: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, chain): chains of witnesses() from their seeds to the nodes (all, or those of ``nodes``), by pointer doubling."""
    links = found.filter("parent is not null").select("node", F.col("parent").alias("to"), F.array("node").alias("way"))
    walked = doubled(links, {"way": lambda a, b: F.concat(a, b)})
    all_ = found.select("node").join(walked, "node", "left").select("node", F.when(F.col("to").isNull(), F.array("node")).otherwise(F.reverse(F.concat("way", F.array("to")))).alias("chain"))
    return all_ if nodes is None else all_.join(nodes.select("node").distinct(), "node", "left_semi")


def chains(parents: DataFrame) -> DataFrame:
    """(commit, chain, place): every commit of (child, parent) on one chain. Of a commit's parents the first continues its chain
    (by the column nth if there is one, else the least), and of a commit's children the least does; a chain is named by its oldest
    commit, whose place is 1."""
    nth = F.col("nth") if "nth" in parents.columns else F.lit(0)
    edges = parents.filter("parent is not null")
    commits = parents.select(F.col("child").alias("commit")).union(edges.select("parent")).distinct()
    first = edges.groupBy("child").agg(F.min_by("parent", F.struct(nth, "parent")).alias("parent")).groupBy("parent").agg(F.min("child").alias("child"))
    walked = followed(first.select(F.col("child").alias("node"), F.col("parent").alias("to"), F.lit(1).cast("long").alias("n")), "n", lambda a, b: a + b, np.add)
    walked = walked.select(F.when(F.col("open"), F.raise_error(F.lit("a commit is its own ancestor"))).otherwise(F.col("node")).alias("commit"), "to", "n")
    return _cut(commits.join(walked, "commit", "left").select("commit", F.coalesce("to", "commit").alias("chain"), (F.coalesce("n", F.lit(0)) + 1).alias("place")))


def ancestor_places(parents: DataFrame, index: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, chain, place): how far each chain of ``index`` is reached from each commit of ``starts`` (start). An edge between
    chains is followed again only for places that it was not followed for."""
    at = lambda name, prefix: index.select(F.col("commit").alias(name), F.col("chain").alias(prefix + "chain"), F.col("place").alias(prefix + "place"))
    cross = parents.filter("parent is not null").select("child", "parent").join(at("child", "c_"), "child").join(at("parent", "p_"), "parent")
    cross = _cut(cross.filter(F.col("c_chain") != F.col("p_chain")).groupBy("c_chain", "c_place", "p_chain").agg(F.max("p_place").alias("p_place")))
    held = _cut(starts.select("start").distinct().join(at("start", ""), "start"))
    front = held.withColumn("before", F.lit(0).cast("long"))
    while not front.isEmpty():
        asked = front.select("start", F.col("chain").alias("c_chain"), "place", "before")
        news = asked.join(cross, "c_chain").filter("c_place > before and c_place <= place").groupBy("start", F.col("p_chain").alias("chain")).agg(F.max("p_place").alias("_new"))
        both = _cut(held.join(news, ["start", "chain"], "full_outer").withColumn("before", F.coalesce("place", F.lit(0).cast("long"))))
        wider = F.greatest(F.col("before"), F.coalesce("_new", F.lit(0).cast("long")))
        front = both.filter(F.col("_new") > F.col("before")).select("start", "chain", wider.alias("place"), "before")
        held = both.select("start", "chain", wider.alias("place"))
    return held


def ranges(pairs: DataFrame, newer: DataFrame, older: DataFrame) -> DataFrame:
    """(newer, older, chain, low, high): for each of the pairs (newer, older) the places (low, high] of every chain that newer
    reaches and older does not; newer and older are tables of ancestor_places()."""
    high = newer.select(F.col("start").alias("newer"), "chain", F.col("place").alias("high"))
    low = older.select(F.col("start").alias("older"), "chain", F.col("place").alias("low"))
    both = pairs.select("newer", "older").distinct().join(high, "newer").join(low, ["older", "chain"], "left")
    return both.select("newer", "older", "chain", F.coalesce("low", F.lit(0).cast("long")).alias("low"), "high").filter("high > low")
