"""Proofs and decisions of test selection: redundant tests, coverage gaps, closures, reuse of records, stability, links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import reachability, sweep
from .graph import _cut


def redundancy(sets: DataFrame, owner: str, item: str, owners: DataFrame | None = None, low_unique: int = 1) -> DataFrame:
    """(owner, kind, by, size, unique): why an owner adds little to the others. no-blocks: it has no items (owners that
    ``owners`` lists alone). equal: others have just its items; by is the first of them. subset: another has all of them and more; by
    is the tightest. union: others have each of them. low-unique: ``low_unique`` at most are its own. Others are not listed.

    Only the holders of an owner's rarest item can contain it, so candidates follow that item's count; a mask of 64 bits of each set
    leaves out most that lack an item before sets are compared by counts of shared items. Equal ones are known by a digest, so a large
    class of equal sets is no set of pairs."""
    rows = sets.select(owner, item).distinct()
    df = rows.groupBy(item).agg(F.count(F.lit(1)).alias("_df"))
    rated = rows.join(df, item)
    sized = rated.groupBy(owner).agg(
        F.count(F.lit(1)).alias("size"),
        F.count(F.when(F.col("_df") == 1, 1)).alias("unique"),
        F.min_by(item, F.struct("_df", item)).alias("_rare"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(item), F.lit(64)).cast("int"))).alias("_mask"),
        F.unhex(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), ","), 256)).alias("_set"),
    )
    sized = _cut(sized)
    alike = sized.groupBy("_set").agg(F.count(F.lit(1)).alias("_like"), F.min(owner).alias("_first"))
    second = sized.join(alike.filter("_like > 1").select("_set", "_first"), "_set").filter(F.col(owner) != F.col("_first")).groupBy("_set").agg(F.min(owner).alias("_second"))
    # one owner stands for each set; only those with no item of their own can be contained
    heads = alike.select(F.col("_first").alias(owner), "_set", "_like").join(sized.drop("_set"), owner)
    asked = heads.filter(F.col("unique") == 0).select(owner, "size", F.col("_rare").alias(item), "_mask")
    holders = rows.withColumnRenamed(owner, "_by").join(heads.select(F.col(owner).alias("_by"), F.col("size").alias("_by_size"), F.col("_mask").alias("_by_mask")), "_by")
    near = asked.join(holders, item).filter((F.col("_by_size") > F.col("size")) & (F.col("_by_mask").bitwiseAND(F.col("_mask")) == F.col("_mask"))).select(owner, "size", "_by", "_by_size")
    shared = near.join(rows, owner).join(rows.withColumnRenamed(owner, "_by"), ["_by", item]).groupBy(owner, "size", "_by", "_by_size").agg(F.count(F.lit(1)).alias("_n"))
    tight = shared.filter("_n = size").groupBy(owner).agg(F.min(F.struct("_by_size", "_by")).getField("_by").alias("_tight"))
    tight = tight.join(heads.select(owner, "_set"), owner).select("_set", "_tight")
    facts = sized.join(alike.select("_set", "_like", "_first"), "_set").join(second, "_set", "left").join(tight, "_set", "left")
    if owners is not None:
        facts = owners.select(owner).distinct().join(facts, owner, "left")
    kind = (
        F.when(F.col("size").isNull(), "no-blocks")
        .when(F.col("_like") > 1, "equal")
        .when(F.col("_tight").isNotNull(), "subset")
        .when(F.col("unique") == 0, "union")
        .when(F.col("unique") <= low_unique, "low-unique")
    )
    by = F.when(kind == "equal", F.when(F.col("_first") == F.col(owner), F.col("_second")).otherwise(F.col("_first"))).when(kind == "subset", F.col("_tight"))
    return facts.select(owner, kind.alias("kind"), by.alias("by"), F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.coalesce("unique", F.lit(0).cast("long")).alias("unique")).filter("kind is not null")


def unindexed(declared: DataFrame, indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared tests that have no record."""
    return declared.select(*keys).distinct().join(indexed.select(*keys).distinct(), list(keys), "left_anti")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): all that reaches back from each seed along (src, dst), users of src, seeds included. A row a pair is the
    answer here; where one set or one flag a node is asked for, ``reachability`` has it without pairs."""
    found = _cut(seeds.select(F.col("node").alias("seed"), "node").distinct())
    frontier = found
    while not frontier.isEmpty():
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(found, ["seed", "node"], "left_anti"))
        found = _cut(found.unionByName(frontier))
    return found


def closure_and_one(code: DataFrame, tests: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): the closure over code edges, then one level over test edges that is not followed on; seeds alone are not
    in it unless they are reached."""
    reached = closure(code, seeds)
    users = reached.join(tests.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node"))
    return reached.filter("seed <> node").unionByName(users).distinct()


def run_reach(code: DataFrame, tests: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): what the seeds together reach: users over code edges, however far, then one level over test edges. A seed is
    in it only if an edge leads to it."""
    code, seeds = _cut(code.select("src", "dst").distinct()), _cut(seeds.select("node").distinct())
    inside = _cut(reachability.reached(code, seeds, written=True))
    # what is inside and no seed was led to; only a seed is looked up
    back = code.join(seeds.withColumnRenamed("node", "dst"), "dst", "left_semi").join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    users = tests.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").select("dst")
    return inside.join(seeds, "node", "left_anti").union(back.select("dst")).union(users).distinct()


#: Bits of what a unit adds to those that reach it.
RUNS, SKIPPED, OPEN = 1, 2, 4


def coverage_gap(code: DataFrame, tests: DataFrame, seeds: DataFrame, units: DataFrame) -> DataFrame:
    """(seed, gap, uncertain): gap: no test that runs can observe the seed; uncertain: that is not proven.

    units: (node, runs, narrowed, frontier): runs is null for a unit without tests. A test that will not run, and was not
    narrowed out on purpose, proves neither coverage nor its absence. Three bits spread over the whole graph; no seed is followed
    by itself."""
    no = F.lit(False)
    bit = lambda flag, value: F.when(F.coalesce(flag, no), value).otherwise(0)
    own = units.select("node", (bit(F.col("runs"), RUNS) + bit(~F.col("runs") & ~F.coalesce("narrowed", no), SKIPPED) + bit(F.col("frontier"), OPEN)).cast("long").alias("bits"))
    own = _cut(own.groupBy("node").agg(F.bit_or("bits").alias("bits")))
    # one level of test users belongs to the unit that they use
    used = tests.join(own.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.bit_or("bits").alias("bits"))
    held = reachability.spread(code, own.unionByName(used))
    flags = seeds.select(F.col("node")).distinct().join(held, "node", "left").select(F.col("node").alias("seed"), F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    has = lambda value: F.col("bits").bitwiseAND(value) != 0
    blind = ~has(RUNS) & has(SKIPPED)
    return flags.select("seed", (~has(RUNS) & ~blind).alias("gap"), (blind | has(OPEN)).alias("uncertain"))


def same_prefix(a: Column, b: Column, n: Column) -> Column:
    """Whether two chains agree in their first n steps."""
    return (F.size(a) >= n) & (F.size(b) >= n) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))


def path_concern(plans: DataFrame, path: str, unit: str, open_reader: str) -> DataFrame:
    """(path, unit, place): what each changed path adds. Units that every path selects, and at least one as a reader of
    anything, are shared and stand once, under a null path."""
    total = plans.select(path).distinct().agg(F.count(F.lit(1)).alias("_paths"))
    units = plans.groupBy(unit).agg(F.count_distinct(path).alias("_n"), F.bool_or(open_reader).alias("_open"))
    shared = units.crossJoin(F.broadcast(total)).filter((F.col("_n") == F.col("_paths")) & F.col("_open")).select(unit)
    own = plans.select(path, unit).distinct().join(shared, unit, "left_anti").select(path, unit, F.lit("addition").alias("place"))
    return own.unionByName(shared.select(F.lit(None).cast(plans.schema[path].dataType).alias(path), unit, F.lit("shared").alias("place")))


def reuse(units: DataFrame, records: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """keys, decision, reason, witness: a unit whose digest an admitted record holds under equal identity is reused, by the
    first such record; else it runs, for the reason that says most."""
    admitted = records.filter("admitted").select(*keys, F.col(digest).alias("_recorded"), "record")
    same = F.col(digest) == F.col("_recorded")
    got = units.join(admitted, list(keys), "left").groupBy(*keys, digest).agg(F.min(F.when(same, F.col("record"))).alias("witness"), F.count("record").alias("_n"))
    reason = F.when(F.col("witness").isNotNull(), "match").when(F.col(digest).isNull(), "no digest").when(F.col("_n") > 0, "digest differs").otherwise("no record")
    return got.select(*keys, F.when(reason == "match", "REUSE").otherwise("RUN").alias("decision"), reason.alias("reason"), "witness")


def attempts(runs: DataFrame, keys: Sequence[str], ms: str, invalid: str, most: int = 24 * 3600 * 1000) -> DataFrame:
    """keys, ms, state: the sum of a test's attempts; one invalid attempt, or a sum over the bound, makes it invalid, one missing makes it
    not measured."""
    got = runs.groupBy(*keys).agg(F.bool_or(invalid).alias("_bad"), F.bool_or(F.col(ms).isNull()).alias("_gone"), F.sum(ms).alias("_sum"))
    state = F.when(F.col("_bad"), "INVALID").when(F.col("_gone"), "NOT_MEASURED").when(F.col("_sum") > most, "INVALID").otherwise("MEASURED")
    return got.select(*keys, F.when(state == "MEASURED", F.col("_sum")).alias("ms"), state.alias("state"))


def bijection(planned: DataFrame, started: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, planned, started: where a schedule and its starts differ; none means that they match one to one."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = count(planned, "planned").join(count(started, "started"), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("planned", F.lit(0).cast("long")).alias("planned"), F.coalesce("started", F.lit(0).cast("long")).alias("started")).filter("planned <> started")


def stability(wanted: DataFrame, aggregates: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """keys, state: of all aggregates of a flow the first failing state wins: missing, invalid, incomplete, stale (bound to
    another commit than ``at``), failed; else verified. aggregates: (keys, error, commit, verdict)."""
    error = F.col("error")
    rank = (
        F.when(F.col("_in").isNull(), 0)
        .when(error == "incomplete", 2)
        .when(error.isNotNull(), 1)
        .when(~F.col("commit").eqNullSafe(F.lit(at)), 3)
        .when(~F.col("verdict").eqNullSafe(F.lit("clean")), 4)
        .otherwise(5)
    )
    names = F.array(*map(F.lit, ("missing", "invalid", "incomplete", "stale", "failed", "verified")))
    got = wanted.join(aggregates.withColumn("_in", F.lit(1)), list(keys), "left").groupBy(*keys).agg(F.min(rank).alias("_r"))
    return got.select(*keys, F.get(names, F.col("_r")).alias("state"))


def link_states(links: DataFrame, variations: DataFrame, known: DataFrame, flow: str, test: str, at: str) -> DataFrame:
    """flow, test, state: a link to a flow that is not there dangles, one to a test that is not known is unknown, one whose
    digest is not the flow's own is stale; else it is current."""
    flows = variations.select(flow, F.col(at).alias("_now"), F.lit(1).alias("_flow")).distinct()
    tests = known.select(test).distinct().withColumn("_test", F.lit(1))
    joined = links.join(flows, flow, "left").join(tests, test, "left")
    state = F.when(F.col("_flow").isNull(), "dangling").when(F.col("_test").isNull(), "unknown").when(~F.col(at).eqNullSafe(F.col("_now")), "stale").otherwise("current")
    return joined.select(flow, test, state.alias("state"))


def shared_first(chains: DataFrame, key: str, edges: str, flagged: str) -> DataFrame:
    """key, first, others: flagged chains that begin with the same edge as others do, with how many and the least of them.
    Groups are counted, not paired."""
    own = chains.filter(F.col(flagged) & (F.size(edges) > 0)).select(key, F.get(edges, F.lit(0)).alias("first"))
    groups = own.groupBy("first").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_a"))
    next_ = own.join(groups.select("first", "_a"), "first").filter(F.col(key) != F.col("_a")).groupBy("first").agg(F.min(key).alias("_b"))
    least = F.when(F.col(key) == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))
    return own.join(groups.filter("_n > 1"), "first").join(next_, "first").select(key, "first", (F.col("_n") - 1).alias("others"), least.alias("least"))


def observed_bindings(changed: DataFrame, bindings: DataFrame, file: str, names: Sequence[str]) -> DataFrame:
    """A changed file with the sorted sets of what was seen to be bound to it; none is an empty set."""
    sets = bindings.groupBy(file).agg(*[F.array_sort(F.collect_set(n)).alias(n) for n in names])
    empty = F.array().cast("array<string>")
    return changed.select(file).distinct().join(sets, file, "left").select(file, *[F.coalesce(F.col(n).cast("array<string>"), empty).alias(n) for n in names])


def hunk_tests(hunks: DataFrame, methods: DataFrame, lines: DataFrame, file: str) -> DataFrame:
    """file, hunk, state, tests: the tests of the executable lines of the innermost method around each hunk (start, end);
    an insertion (end < start) may touch the method's edges; outside of every method the hunk falls back."""
    at = [file, "open", "close"]
    asked = hunks.select(file, "hunk", "start", "end")
    # written once: its bodies, the lines in them and the result are all read from it
    method = _cut(sweep.nearest(asked, methods.select(*at), [file], "start", "end", "left").select(file, "hunk", "open", "close"))
    # a line's tests go to every chosen method around it, however many hunks chose that
    ran = lines.select(file, "line", F.col("line").alias("_to"), "test")
    inside = sweep.meeting(ran, method.select(*at).filter("open is not null").distinct(), [file], "line", "_to").select(*at, "test").distinct()
    tests = inside.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list("test")), ",").alias("tests"))
    all_ = method.join(tests, at, "left")
    state = F.when(F.col("open").isNull(), "outside a method").when(F.col("tests").isNull(), "no executed line").otherwise("selected")
    return all_.select(file, "hunk", state.alias("state"), F.coalesce("tests", F.lit("")).alias("tests"))


def with_fallback(selected: DataFrame, state: str, good: str, tests: str, by: Sequence[str] = ()) -> DataFrame:
    """by, whole, reason, tests: one part of a change that can't be placed makes its whole selection fall back, by its first
    reason. by: columns that name a change; none: all rows are one."""
    bad = F.when(F.col(state) != good, F.col(state))
    # equal names of a change meet before they are gathered; the null beside them keeps rows without tests
    names = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.split(tests, ","), F.array().cast("array<string>")))
    told = selected.select(*by, bad.alias("_bad"), F.explode(names).alias("_test")).groupBy(*by, "_test").agg(F.min("_bad").alias("_bad"))
    bad, every = F.min("_bad"), F.array_sort(F.collect_list(F.when(F.col("_test") != "", F.col("_test"))))
    return told.groupBy(*by).agg(bad.isNotNull().alias("whole"), bad.alias("reason"), F.when(bad.isNull(), F.array_join(every, ",")).alias("tests"))


def tests_of_files(blocks: DataFrame, file: str, tests: str, order: DataFrame, test: str) -> DataFrame:
    """file, tests: distinct tests that reached any block of a file, in the order of the index (test, place)."""
    seen = blocks.select(file, F.explode(tests).alias(test)).distinct().join(order, test)
    return seen.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("place", F.col(test).cast("string").alias("t")))).alias("_t")).select(file, F.array_join(F.transform("_t", lambda x: x["t"]), ",").alias("tests"))
