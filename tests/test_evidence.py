"""Folds, classifications and joins that abstain."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evergrain.functions import predicates as p
from evergrain.operators import evidence


def test_predicates(spark):
    df = spark.createDataFrame([("src/a.go", 3, "T"), ("src/FooTest.java", 1, "x"), ("lib/b.py", 2, "y")], "path string, line int, name string")
    got = df.select(
        p.selector_matches(F.lit("src/a.go:3"), F.col("path"), F.col("line"), F.col("name")).alias("sel"),
        p.test_class_path(F.col("path")).alias("test"),
        p.in_scope(F.col("path"), ["src/**"], ["**/*.java"]).alias("scope"),
        p.unit_parent(F.concat(F.lit("go:"), "path")).alias("parent"),
        p.granularity(F.concat("path", F.lit("::"), "name")).alias("gran"),
        p.relative(F.lit("src"), F.col("path")).alias("rel"),
        p.change_kind(F.lit("000000"), F.lit("100644")).alias("kind"),
    ).collect()
    assert [r.sel for r in got] == [True, False, False] and [r.test for r in got] == [False, True, False]
    assert [r.scope for r in got] == [True, False, False] and got[0].parent == "src" and got[0].gran == "test"
    assert [r.rel for r in got] == ["a.go", "FooTest.java", "lib/b.py"] and got[0].kind == "add"
    for bad in ("", "x" * 9000):
        with pytest.raises(ValueError):
            p.check_query(bad)
    with pytest.raises(ValueError):
        p.check_choices(["a", "a"], ["a", "b"], 3)


def test_folds(spark):
    s = spark.createDataFrame([("a", "killed", False), ("a", "survived", False), ("b", "killed", True), ("c", "killed", False), ("d", None, False)], "k string, o string, x boolean")
    assert dict(map(tuple, s.groupBy("k").agg(evidence.strength(F.col("o"), F.col("x")).alias("v")).collect())) == {"a": "survived", "b": "not measured", "c": "killed", "d": "incomplete"}
    f = spark.createDataFrame([("t", 1, "abstained", "r1", "x"), ("t", 2, "invalid", "r2", "y"), ("t", 3, "invalid", "r3", "x"), ("u", 1, "valid", None, "z")], "k string, o int, state string, reason string, anchor string")
    assert {r.k: (r.state, r.reason, r.anchors) for r in evidence.hygiene(f, "k", "o").collect()} == {"t": ("invalid", "r2", ["x", "y"]), "u": ("valid", None, ["z"])}


def test_joins(spark):
    bodies = spark.createDataFrame([("f", 1, 100), ("f", 10, 20)], "f string, open int, close int")
    points = spark.createDataFrame([("f", 12, 13), ("f", 10, 11), ("f", 20, 19)], "f string, lo int, hi int")
    got = evidence.innermost(points, bodies, ["f"], "lo", "hi").collect()
    assert {(r.lo, r.open) for r in got} == {(12, 10), (10, 1), (20, 10)}
    changed = spark.createDataFrame([("b", 1), ("c", 1), ("c", 2)], "body string, line int")
    lines = spark.createDataFrame([("b", 1, "t1"), ("c", 1, "t2")], "body string, line int, test string")
    whole = spark.createDataFrame([("b", "t9"), ("c", "t3")], "body string, test string")
    assert sorted(map(tuple, evidence.line_tests(changed, lines, whole, "body", "line").collect())) == [("b", "t1"), ("c", "t2"), ("c", "t3")]
    rows = spark.createDataFrame([("s1",), ("s2",)], "s string")
    sel = spark.createDataFrame([("s1", "R-2"), ("s1", "R-1")], "s string, id string")
    assert {r.s: r.ids for r in evidence.require_all(sel, rows, "s").collect()} == {"s1": ["R-1", "R-2"], "s2": None}
    with pytest.raises(Exception, match="no row for selector"):
        evidence.require_all(spark.createDataFrame([("zz", "R-1")], "s string, id string"), rows, "s").collect()
    listing = spark.createDataFrame([("a::x",), ("b::y",), ("b::y",)], "id string")
    asked = spark.createDataFrame([("a::x",), ("b::y",), ("c::z",), ("",)], "id string")
    assert {r.id: (r.selection, r.target) for r in evidence.resolve(asked, listing).collect()} == {"a::x": ("test", "a::x"), "b::y": ("file", "b"), "c::z": ("dangling", "c"), "": ("all", None)}
    env = evidence.environment_changes(spark.createDataFrame([("A", "1"), ("B", "2")], "name string, value string"), spark.createDataFrame([("A", "1"), ("B", "3"), ("C", None)], "name string, value string"), spark.createDataFrame([("B", "u")], "name string, user string"))
    assert {r.name: r.dependents for r in env.collect()} == {"B": ["u"]}
    paths = spark.createDataFrame([("a.py",), ("b.go",), ("c",)], "p string")
    pats = spark.createDataFrame([(1, r"\.py$"), (2, r"^[ab]")], "place int, regex string")
    assert {r.p: r.pattern for r in evidence.first_pattern(paths, pats, "p").collect()} == {"a.py": r"\.py$", "b.go": "^[ab]", "c": None}
    near = evidence.nearest_package(spark.createDataFrame([("a/b/c",), ("z",)], "path string"), spark.createDataFrame([("a",), ("a/b",)], "package string"), "path")
    assert dict(map(tuple, near.collect())) == {"a/b/c": "a/b", "z": None}
    assert {r.k: r.id for r in evidence.dictionary(spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), "k").collect()} == {"a": 0, "b": 1}
    spread = evidence.attribute(spark.createDataFrame([(1, ["t", "u"], None), (2, ["t"], "m")], "id int, tests array<string>, mark string"), "tests", "mark")
    assert sorted(map(tuple, spread.collect())) == [(1, "t"), (1, "u"), (2, "m")]


def test_lineage_and_anchors(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "n string, up string")
    got = {r.n: (r.chain, r.state) for r in evidence.lineage(tree, "n", "up", 4).collect()}
    assert got["c"] == (["c", "b", "a"], "root") and got["a"] == (["a"], "root") and got["x"][1] == "cycle"
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    anchors = spark.createDataFrame([(1, "f", 2, 1, h("b")), (2, "f", 1, 1, h("c")), (3, "f", 1, 1, h("q")), (4, "g", 1, 1, h("a"))], "id int, path string, line int, width int, digest string")
    files = spark.createDataFrame([("f", "a\nb\nc")], "path string, text string")
    assert {r.id: (r.state, r.moved_to) for r in evidence.relocate(anchors, files).collect()} == {1: ("live", None), 2: ("moved", 3), 3: ("changed", None), 4: ("gone", None)}


def test_ways_up_of_any_shape(spark):
    from evergrain.operators import evidence

    up = {k: k + 1 for k in range(40)} | {50: None, 51: 50, 60: 61, 61: 62, 62: 60, 63: 60, 70: 70, 80: 999}
    df = spark.createDataFrame(list(up.items()), "n long, p long")
    for depth in (0, 1, 5, 16, 17):
        want = {}
        for k in up:
            chain, at, state = [k], up[k], "root" if up[k] is None else "open"
            for _ in range(depth):
                if state == "open" and at in chain:
                    state = "cycle"
                elif state == "open":
                    chain, at = [*chain, at], up.get(at)
                    state = "root" if at is None else "open"
            want[k] = (chain, "too deep" if state == "open" else state)
        ways = evidence.lineage(df, "n", "p", depth)
        assert {r.n: (r.chain, r.state) for r in ways.collect()} == want, depth
        # ended ways have no part in a join, where they would meet in one task
        assert ways._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1


def test_names_are_dealt_by_their_number(spark, monkeypatch):
    from evergrain.operators import graph

    monkeypatch.setattr(graph, "_ROWS", 10, raising=False)
    definers = [(f"nameOf_{k}", f"p{k}") for k in range(40)] + [("nameOf_1", "p1"), ("nameOf_2", "s3"), ("lower", "p1")]
    mentions = [(f"nameOf_{k % 40}", f"s{k % 9}") for k in range(200)] + [("nameOf_2", "p2"), ("nameOf_7", "p7"), (None, "s1")] + [("nameOf_0", f"t{k}") for k in range(60)]
    got = graph.identifier_graph(spark.createDataFrame(definers, "name string, path string"), spark.createDataFrame(mentions, "name string, path string"))
    pairs: dict = {}
    for name in {n for n, _ in definers if n != "lower"}:
        a, b = ({p for n, p in rows if n == name} for rows in (definers, mentions))
        if len(a) <= 5 and len(b) <= 50:
            for x, y in {(min(x, y), max(x, y)) for x in a for y in b if x != y}:
                pairs[x, y] = pairs.get((x, y), 0) + 1
    assert sorted(map(tuple, got.collect())) == sorted([(x, y, n) for (x, y), n in pairs.items()] + [(y, x, n) for (x, y), n in pairs.items()])
    assert got.rdd.getNumPartitions() == -(-(len(definers) + len(mentions)) // 10)


def test_patches_of_repeated_lines_agree_with_sql(spark, tmp_path):
    """A first line that stands again, alone or with a question mark, lines that the patch puts itself, ids that are null or stand twice."""
    import duckdb

    import __spark_entry__
    from evergrain.functions import diff

    texts = ["a", "", "a\nb", "a\na", "a\na\nb", "a\na\na\nb\nb", "a\nb\na", "\n\nb", "a\nend\nend", "a\na\nb\nend", "end\nend", "a\nb\na?", "a\na?", "a\nnew 3\nb", "new 3\nb", "new 3\nnew 3\nb", "end\nnew 3\nend\nnew 3", "a\nend\na\nend\na"]
    rows = [(k, x) for k in (0, 1, 2, 3, 4) for x in texts] + [(None, "a\na"), (-3, "b\nb\nc"), (5, None), (6, "a\na\nb"), (6, "a\na\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["patch_and_relocate"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(map(repr, got)) == sorted(map(repr, c.execute(__spark_entry__.oracle_sql()["patch_and_relocate"]).fetchall()))
    want = []
    for k, x in rows:
        if x is not None:
            old, kind, put = x.split("\n"), 3 if k in (None, -3) else k % 4, k is not None and k % 3 == 0
            new = [f"new {k}" if put else old[0], *old[1:], "end"]
            moved = {0: 1 if old[1:2] != old[:1] else None, 1: old.index(old[0] + "?") + 1 if old[0] + "?" in old else None}.get(kind)
            state = "moved" if moved else ("live", "changed", "gone", "live")[kind]
            want.append((k, state, moved, "\n".join(new), len(diff.hunks(old if x else [], new))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
