"""Reachability without pairs, and histories by chains, against plain searches."""

import random

import numpy as np
import pytest
from pyspark.sql.functions import udf

from evergrain import registry
from evergrain.operators import reachability, selection


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        for y in edges.get(todo.pop(), ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def graph(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    return out


@pytest.mark.parametrize("seed", [0, 3])
def test_spread(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range([20, 45, 70, 120][seed])] + [(200 + k, 201 + k) for k in range(40)] + [(300, 301), (301, 302), (302, 300), (240, 301), (400, 400)]
    own = [(rng.randrange(n), 1 << rng.randrange(3)) for _ in range(6)] + [(302, 4), (240, 1), (500, 2), (500, 1)]
    got = {r.node: r.bits for r in reachability.spread(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame(own, "node long, bits long")).collect()}
    edges, bits = graph(pairs), {}
    for x, b in own:
        bits[x] = bits.get(x, 0) | b
    nodes = {x for p in pairs for x in p} | set(bits)
    want = {}
    for x in nodes:
        want[x] = 0
        for y in reach(edges, x):
            want[x] |= bits.get(y, 0)
    assert got == want
    seeds = rng.sample(range(n), 3)
    found = {r.node for r in reachability.reached(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(s,) for s in seeds], "node long")).collect()}
    assert found == set().union(*(reach(edges, s) for s in seeds))


def test_gap_and_reach_of_a_long_chain(spark):
    """5,000 users deep, and the only test that runs stands at its end."""
    n = 5000
    code = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(n, 0)] + [(9000, 9001), (9002, 9000)], "src long, dst long")
    tests = spark.createDataFrame([(n - 1, -1), (9001, -2)], "src long, dst long")
    units = spark.createDataFrame([(-1, True, False, None), (-2, False, False, None), (9002, None, None, True)], "node long, runs boolean, narrowed boolean, frontier boolean")
    seeds = spark.createDataFrame([(0,), (n,), (9000,), (9002,), (7777,)], "node long")
    got = {r.seed: (r.gap, r.uncertain) for r in selection.coverage_gap(code, tests, seeds, units).collect()}
    assert got == {0: (False, False), n: (False, False), 9000: (False, True), 9002: (False, True), 7777: (True, False)}
    reached = {r.node for r in selection.run_reach(code, tests, spark.createDataFrame([(9000,), (7777,)], "node long")).collect()}
    assert reached == {9001, -2}
    none = spark.createDataFrame([], "src long, dst long")
    assert selection.run_reach(none, none, seeds).count() == 0
    assert {(r.gap, r.uncertain) for r in selection.coverage_gap(none, none, seeds, units).collect()} == {(True, False), (True, True)}


def test_history_of_a_long_chain(spark):
    n = 5000
    rows = [(f"c{k:05}", f"c{k - 1:05}") for k in range(1, n)] + [("c00000", None), ("side", "c00010"), ("c02500", "side"), ("lone", None)]
    history = registry.History(spark.createDataFrame(rows, "child string, parent string"), spark.createDataFrame([("c00100", "a"), ("side", "b"), ("c04999", "c")], "commit string, path string"))
    pairs = spark.createDataFrame([("c00000", "c04999"), ("side", "c04999"), ("c04999", "side"), ("c00100", "c00102"), ("lone", "c04999"), ("c04999", "c04999"), ("none", "c04999"), ("c00001", "none")], "older string, newer string")
    got = {(r.older, r.newer): (r.ancestor, r.distance) for r in history.facts(pairs).collect()}
    assert got == {
        ("c00000", "c04999"): (True, n), ("side", "c04999"): (True, n - 11), ("c04999", "side"): (False, 0), ("c00100", "c00102"): (True, 2),
        ("lone", "c04999"): (False, n + 1), ("c04999", "c04999"): (True, 0), ("none", "c04999"): (None, None), ("c00001", "none"): (None, None),
    }
    assert sorted(r.path for r in history.changed("c00050", "c04999").collect()) == ["a", "b", "c"]
    assert [r.path for r in history.changed("side", "c00100").collect()] == ["a"]
    assert history.ancestors("c00003").count() == 4


@pytest.mark.parametrize("seed", range(2))
def test_history_of_merges(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = [(k, rng.randrange(max(0, k - 8), k)) for k in range(1, n) for _ in range(rng.choice([1, 1, 2, 3])) if rng.random() < 0.95]
    rows = [(f"{a:03}", f"{b:03}") for a, b in pairs] + [(f"{k:03}", None) for k in range(n)]
    edges = graph((a, b) for a, b in rows if b)
    changes = [(f"{k:03}", f"d{rng.randrange(4)}/f{rng.randrange(9)}") for k in range(n)]
    history = registry.History(spark.createDataFrame(rows, "child string, parent string"), spark.createDataFrame(changes, "commit string, path string"))
    asked = [(f"{rng.randrange(n):03}", f"{rng.randrange(n):03}") for _ in range(40)]
    table = spark.createDataFrame(asked, "older string, newer string")
    want = {(a, b): (a in reach(edges, b), len(reach(edges, b) - reach(edges, a))) for a, b in asked}
    assert {(r.older, r.newer): (r.ancestor, r.distance) for r in history.facts(table).collect()} == want
    touched = {(a, b, p) for a, b in asked for c, p in changes if c in reach(edges, b) - reach(edges, a)}
    assert {tuple(r) for r in history.changes_between(table).collect()} == touched


def test_states_of_records(spark):
    rows = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(9)] + [("x", None)]
    changes = [("c5", "src/a.py"), ("c7", "doc/b.md")]
    trees = [(f"c{k}", "src/a.py", "2" if 5 <= k < 8 else "1") for k in range(9)]
    parents, touched = spark.createDataFrame(rows, "child string, parent string"), spark.createDataFrame(changes, "commit string, path string")
    records = [("1", "c6", "doc"), ("2", "c6", "src/a.py"), ("3", "c4", "src/"), ("3", "c4", "doc/b.md"), ("4", "x", "src"), ("5", "gone", "src"), ("6", "c1", None), ("7", "c1", "@lib/a"), ("7", "c1", "src"), ("8", "c7", "do")]
    table = spark.createDataFrame(records, "id string, revision string, path string")
    from pyspark.sql import functions as F

    got = {r.id: (r.state, r.reason, r.distance, r.changed) for r in registry.History(parents, touched).states(table, F.lit("c8"), 3).collect()}
    assert got == {
        "1": ("stale", None, 2, ["doc"]), "2": ("current", None, 2, []), "3": ("retired", None, 4, ["doc/b.md", "src/"]), "4": ("UNKNOWN", "not-ancestor", None, []),
        "5": ("UNKNOWN", "revision-unresolved", None, []), "6": ("UNKNOWN", "no-linked-paths", None, []), "7": ("UNKNOWN", "linked-path-outside-root", None, []), "8": ("current", None, 1, []),
    }
    # by trees: changed and changed back is unchanged
    back = registry.History(parents, touched, spark.createDataFrame(trees, "commit string, path string, oid string"))
    assert [r.path for r in back.changed("c4", "c6").collect()] == ["src/a.py"] and back.changed("c4", "c8").count() == 0
    with pytest.raises(Exception, match="own ancestor"):
        reachability.chains(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")).collect()


def test_witness_chains(spark):
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(50), rng.randrange(50), rng.randrange(3)) for _ in range(110)})
    seeds = [3, 8, 400]
    found = reachability.witnesses(spark.createDataFrame(pairs, "src long, dst long, kind int"), spark.createDataFrame([(s,) for s in [*seeds, 3]], "node long"))
    hops, level = dict.fromkeys(seeds, 0), seeds
    want = {s: (0, None, None) for s in seeds}
    while level:
        new = {}
        for a, b, kind in pairs:
            if a in level and b not in hops:
                new[b] = min(new.get(b, (kind, a)), (kind, a))
        for b, (kind, a) in new.items():
            hops[b] = hops[a] + 1
            want[b] = (hops[b], a, kind)
        level = list(new)
    rows = found.collect()
    assert len(rows) == len(want) and {r.node: (r.hops, r.parent, r.kind) for r in rows} == want
    chains = {r.node: r.chain for r in reachability.written_out(found).collect()}

    def up(x):
        return [x] if want[x][1] is None else [*up(want[x][1]), x]

    assert chains == {x: up(x) for x in want}
    some = spark.createDataFrame([(3,), (999,)], "node long")
    assert [r.chain for r in reachability.written_out(found, some).collect()] == [[3]]


def test_graph_is_made_by_two_shuffles(spark, tmp_path):
    """Copies and the order's window share one shuffle, the month's window takes the other."""
    from evergrain.plans import graphs

    rows = [(o, n, 1 + (o * 7 + n) % 5, 1 + (o * 31 + n * 9) % 40) for o in range(60) for n in range(1, 5)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").selectExpr("*", "timestamp'2020-01-01' AS l_shipdate")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    _, code, _ = graphs._graph(spark, str(tmp_path))
    assert code.count() > 0 and code._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2


def test_doubling_looks_up_what_open_ways_lead_to(spark, monkeypatch):
    rows = [(k, k + 1, 1) for k in range(60)] + [(100, 101, 1), (101, 100, 1), (200, 60, 1)]
    links = spark.createDataFrame(rows, "node long, to long, n long")
    got = []
    for few in (0, 1 << 20):
        monkeypatch.setattr(reachability, "_FEW", few)
        got.append({r.node: (r.to, r.n) for r in reachability.doubled(links, {"n": lambda a, b: a + b}).collect() if not r.open})
    assert got[0] == got[1] == {k: (60, 60 - k) for k in range(60)} | {200: (60, 1)}


@pytest.mark.parametrize("seed", range(2))
def test_ways_inside_ranges_are_followed_by_one_task(spark, monkeypatch, seed):
    rng = random.Random(seed)
    # ways down, ways that cross, cycles inside a range and over several
    rows = [(k, rng.randrange(max(0, k - 4), k) if k % 3 else rng.randrange(200), 1 << rng.randrange(40)) for k in range(1, 200) if k % 29]
    to = {k: (p, b) for k, p, b in rows}
    want = {}
    for k in to:
        node, bits, seen = k, 0, set()
        while node in to and node not in seen:
            seen.add(node)
            bits |= to[node][1]
            node = to[node][0]
        want[f"{k:04}"] = (None if node in to else f"{node:04}", bits, node in to)
    assert {w[2] for w in want.values()} == {True, False}
    links = spark.createDataFrame([(f"{k:04}", f"{p:04}", b) for k, p, b in rows], "node string, to string, bits long")
    for most in (1 << 18, 20):
        monkeypatch.setattr(reachability, "_ROWS", most)
        got = reachability.followed(links, "bits", lambda a, b: a.bitwiseOR(b), np.bitwise_or).collect()
        assert len(got) == len(rows) and {r.node: (None if r.open else r.to, r.bits, r.open) for r in got} == want


def test_chains_along_their_keys_are_not_doubled(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows of the whole history are doubled")

    monkeypatch.setattr(reachability, "doubled", refuse)
    monkeypatch.setattr(reachability, "_ROWS", 100)
    n, acc = 3000, spark.sparkContext.accumulator(0)

    @udf("long")
    def counted(x):
        acc.add(1)
        return x

    rows = [(k, k - 3 if k >= 3 else None) for k in range(n)]
    parents = spark.createDataFrame(rows, "child long, parent long").select(counted("child").alias("child"), "parent")
    history = registry.History(parents, spark.createDataFrame([(n - 1, "a")], "commit long, path string"))
    assert {(r.commit, r.chain, r.place) for r in history.index.collect()} == {(k, k % 3, k // 3 + 1) for k in range(n)}
    pairs = spark.createDataFrame([(n - 31, n - 1), (0, n - 1)], "older long, newer long")
    assert {(r.older, r.ancestor, r.distance) for r in history.facts(pairs).collect()} == {(n - 31, True, 10), (0, False, n // 3)}
    assert acc.value == n  # parents are made once
