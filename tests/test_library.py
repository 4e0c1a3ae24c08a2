"""Operators, functions, sources and streams on vectors and corners, and every query against its SQL."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from evergrain.functions import diff, digest, exact, text
from evergrain.operators import coverage, graph, intervals, joins, report, search, sequence
from evergrain.plans import evidence as _evidence  # noqa: F401 registers its queries
from evergrain.plans import graphs as _graphs  # noqa: F401 as well
from evergrain.plans import texts as _texts  # noqa: F401 as well
from evergrain.plans import queries as plans
from evergrain.sources import formats
from evergrain.streaming import events

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("source", "want"), [("LogoutRedirectURL", ["logout", "redirect", "url"]), ("HTTPServer2Ready", ["http", "server2", "ready"]), ("  ", []), ("claim:2004 on-deck_Controller", ["claim", "2004", "on", "deck", "controller"])])
def test_identifier_words(spark, source, want):
    assert one(spark, text.identifier_words(F.lit(source))) == want


def test_inflections(spark):
    assert set(one(spark, text.inflections(F.lit("set")))) == {"sets", "setes", "seted", "seting", "setted", "setting"}
    assert {"revoked", "revoking"} <= set(one(spark, text.inflections(F.lit("revoke"))))
    assert one(spark, text.inflections(F.lit("ab"))) == one(spark, text.inflections(F.lit("sync2"))) == []


def test_natural_order(spark):
    want = ["claim:", "claim:20", "claim:0209", "claim:209", "claim:211", "claim:2004", "claim:2088", "claim:a"]
    df = spark.createDataFrame([(x,) for x in reversed(want)], "s string")
    assert [r.s for r in df.orderBy(text.natural_key(F.col("s")), "s").collect()] == want


def test_text_functions(spark):
    assert one(spark, text.camel_split(F.lit("parseHTTPReply"))) == "parse-HTTP-Reply"
    assert one(spark, text.slug(F.lit("Big Cities2 classes"))) == "big-cities2-classe"
    assert one(spark, text.slug(F.lit("--"))) == "unnamed"
    assert one(spark, text.path_references(F.lit("see a/b.c and x//y or d/e/f."))) == ["a/b.c", "d/e/f."]
    assert one(spark, text.requirement_ids(F.lit("REQ-A-12, not req-1, X9-3"))) == ["REQ-A-12", "X9-3"]
    assert one(spark, text.holds_phrase(F.array(F.lit("a"), F.lit("bc"), F.lit("d")), F.array(F.lit("bc"), F.lit("d"))))
    assert not one(spark, text.holds_phrase(F.array(F.lit("abc")), F.array(F.lit("bc"))))
    assert one(spark, text.percent_escape(F.lit("a%b:c\n"))) == "a%25b%3Ac%0A"
    import re

    assert re.match(text.glob("src/**/x*.go"), "src/a/b/xy.go") and re.match(text.glob("src/**/x.go"), "src/x.go") and not re.match(text.glob("src/*.go"), "src/a/b.go")


def test_digests(spark):
    import hashlib

    assert one(spark, digest.blob_id(F.lit("hi\n"))) == hashlib.sha1(b"blob 3\0hi\n").hexdigest()
    assert one(spark, digest.domain_hash("d", F.lit("x"))) == hashlib.sha256(b"d\0x").hexdigest()
    assert one(spark, digest.identity("p", F.lit("ab"), F.lit("c"))) != one(spark, digest.identity("p", F.lit("a"), F.lit("bc")))
    for value, scale, want in ((2.6, 1.0, (3, False)), (0.004, 1000.0, (4, False)), (-1.0, 1.0, (None, True)), (float("nan"), 1.0, (None, True)), (1e9, 1.0, (None, True)), (None, 1.0, (None, False))):
        ms, bad = digest.milliseconds(F.lit(value).cast("double"), scale)
        assert (one(spark, ms), one(spark, bad)) == want


def test_exact_functions(spark):
    got = lambda f, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(f("v").alias("x")).first().x
    assert got(exact.canonical_json, '{"b": 1, "a": "é"}') == '{"a":"\\u00e9","b":1}'
    assert got(exact.canonical_json, '{"a": 1.5}') is None and got(exact.canonical_json, '{"a": 1, "a": 2}') is None
    assert got(exact.repair_utf8, bytearray(b"a\xff\xc3b"), "binary") == "a��b"
    assert got(exact.decode_vlq, "AAgBC") == [0, 0, 16, 1] and got(exact.decode_vlq, "!") is None
    h = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd")], "o string, n string").select(diff.line_diff(F.col("o"), F.col("n")).alias("x")).first().x
    assert [tuple(r) for r in h] == [(2, 1, 2, 1, False), (4, 0, 4, 1, False)]
    with pytest.raises(ValueError):
        exact.environment_digest(b"short")


def test_interval_operators(spark):
    a = spark.createDataFrame([("k", 0, 10), ("k", 10, 12), ("k", 20, 30), ("j", 1, 2)], "k string, s int, e int")
    b = spark.createDataFrame([("k", 3, 5), ("k", 8, 22)], "k string, s int, e int")
    assert sorted(map(tuple, intervals.union(a, ["k"], "s", "e").collect())) == [("j", 1, 2, 1), ("k", 0, 12, 2), ("k", 20, 30, 1)]
    assert sorted(map(tuple, intervals.subtract(a, b, ["k"], "s", "e").collect())) == [("j", 1, 2), ("k", 0, 3), ("k", 5, 8), ("k", 22, 30)]
    lines = spark.createDataFrame([("f", n) for n in (1, 5, 6, 9, 20)], "f string, line long")
    hunks = spark.createDataFrame([("f", 5, 2, 5), ("f", 10, 3, 0)], "f string, old_start long, old_count long, new_count long")
    assert sorted(map(tuple, intervals.map_lines(lines, hunks, ["f"], "line").collect())) == [("f", 1, 1, True), ("f", 5, 5, False), ("f", 6, 5, False), ("f", 9, 12, True), ("f", 20, 20, True)]


def test_join_operators(spark):
    base = spark.createDataFrame([("a", "f", "1"), ("b", "f", "1"), ("c", "f", None), ("d", "f", "1"), ("g", "f", "1")], "p string, m string, h string")
    head = spark.createDataFrame([("a", "f", "1"), ("b", "x", "2"), ("c", "f", "1"), ("e", "f", "1"), ("g", "f", "2")], "p string, m string, h string")
    assert dict(map(tuple, joins.change_status(base, head, "p", "m", "h").collect())) == {"a": "unchanged", "b": "type-changed", "c": "unknown", "d": "deleted", "e": "added", "g": "modified"}
    paths = spark.createDataFrame([("r/a/x",), ("r/b",), ("q",)], "p string")
    roots = spark.createDataFrame([("r",), ("r/a",)], "root string")
    assert dict(map(tuple, joins.longest_prefix(paths, roots, "p", "root").collect())) == {"r/a/x": "r/a", "r/b": "r", "q": None}
    x = spark.createDataFrame([(1, 0, 100), (2, 100, 101), (3, 102, 102)], "k int, s long, e long")
    pairs = joins.overlapping(x, x, 8, "s", "e").filter("k < o_k").select("k", "o_k").collect()
    assert [tuple(r) for r in pairs] == [(1, 2)]


def test_range_joins_have_no_nested_loop(spark):
    x = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("s"), (F.col("id") + 5).alias("e"))
    plan = joins.overlapping(x, x, 8, "s", "e")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sequence_and_report(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 4, "z"), ("b", 7, "x")], "k string, t int, v string")
    assert sorted(map(tuple, sequence.continuity(df, ["k"], "t").collect())) == [("a", 3, 1, 4), ("b", 1, 0, None)]
    assert sorted(map(tuple, sequence.latest(df, ["k"], ["t"]).select("k", "v").collect())) == [("a", "z"), ("b", "x")]
    assert {r.unique_name for r in sequence.disambiguate(df, "k", ["t"]).collect()} == {"a", "a#2", "a#3", "b"}
    r = spark.createDataFrame([("g", 100, 100), ("g", 50, 50), ("g", 0, 450), ("h", None, 3)], "g string, p int, w int")
    assert dict(map(tuple, r.groupBy("g").agg(report.poisoned_ratio(F.col("p"), F.col("w")).alias("x")).collect())) == {"g": 0.25, "h": None}
    assert one(spark, report.saturating(F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(5))) == 18446744073709551615
    assert [r.omitted for r in sequence.page(df, [F.col("t")], 1, 2).collect()] == [1, 1]


def test_graph_and_coverage(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert dict(map(tuple, graph.reach(e, seeds, 5).collect())) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert {r.node: r.path for r in graph.shortest_paths(e, seeds, 5).collect()} == {"a": "a", "b": "a>b", "d": "a>d", "c": "a>b>c"}
    s = spark.createDataFrame([("t", 1), ("u", 1), ("u", 2), ("v", 1), ("v", 2), ("v", 3), ("w", 9)], "o string, i int")
    assert sorted(map(tuple, coverage.contained(s, "o", "i").collect())) == [("t", "u", 1, 2), ("u", "v", 2, 3)]


def test_weak_search(spark):
    df = spark.createDataFrame([("a", 5)], "term string, df long")
    r = search.weak_share(df, 10, ["a", "b"]).first()
    assert r.weak and 0.5 < r.unmatched < 1


def lines(spark, rows, path="p"):
    return spark.createDataFrame([(path, k + 1, v) for k, v in enumerate(rows)], "path string, line int, value string")


def test_sources(spark, tmp_path):
    good = formats.coverprofile(lines(spark, ["mode: set", "a/b.go:1.2,3.4 5 18446744073709551615", ""])).collect()
    assert [(r.file, r.start, r.end_col, int(r["count"]), r.mode) for r in good] == [("a/b.go", 1, 4, 18446744073709551615, "set")]
    for bad in (["mode: set", "nonsense"], ["a.go:1.2,3.4 5 1"], ["mode: set", "mode: count", "a.go:1.2,3.4 5 1"]):
        with pytest.raises(Exception, match="cover profile"):
            formats.coverprofile(lines(spark, bad)).collect()
    assert [tuple(r) for r in formats.lcov(lines(spark, ["TN:", "SF:x.js", "DA:3,0", "DA:4,2", "end_of_record"])).collect()] == [("x.js", 3, 0), ("x.js", 4, 2)]
    with pytest.raises(Exception, match="lcov"):
        formats.lcov(lines(spark, ["DA:3,0"])).collect()
    d = formats.raw_diff(lines(spark, ["diff --git a/x b/y", "@@ -1,2 +3 @@ f", "-a", "@@ -9 +9,0 @@"])).collect()
    assert [tuple(r) for r in d] == [("x", "y", 1, 2, 3, 1), ("x", "y", 9, 1, 9, 0)]
    m = formats.requirement_map(lines(spark, ["# c", "", "a/b=R-1, R-2"])).collect()
    assert [tuple(r) for r in m] == [("a/b", "R-1"), ("a/b", "R-2")]
    e = formats.test_events(lines(spark, ['{"Action":"pass","Package":"p"}', '{"Action":"fail","Package":"p","Test":"t"}', '{"Action":"pass","Package":"q"}', "junk"])).collect()
    assert sorted(map(tuple, e)) == [("p", "fail"), ("q", "pass")]
    t = formats.tap(lines(spark, ["1..3", "ok 1 - one", "not ok 2 two # TODO later", "ok three # SKIP"])).collect()
    assert [(r.number, r.verdict) for r in t] == [(1, "pass"), (2, "todo"), (3, "skip")]
    (tmp_path / "i.tsv").write_text("id\tfile\ttitle\tacceptance\tacceptedBy\nR-1\ta\tt\tx\ty\nbad\nR-1\tb\tt\tx\ty\n")
    assert [(r.id, r.file) for r in formats.requirement_index(spark, str(tmp_path / "i.tsv")).collect()] == [("R-1", "b")]
    (tmp_path / "l.json").write_text('{"commits":["c0","c1"],"evidence":["e"],"paths":{"f":[{"commit":1,"evidence":0}]}}')
    assert [tuple(r) for r in formats.link_tables(spark, str(tmp_path / "l.json")).collect()] == [("f", "c1", "e")]
    (tmp_path / "h.txt").write_text("\x1ec1\x1ft1\x1fone\x1f\0a.go\0b.go\0\x1ec2\x1ft2\x1ftwo\x1fgrafted\0z\0")
    assert [(r.commit, r.subject, r.paths) for r in formats.history(spark, str(tmp_path / "h.txt")).collect()] == [("c1", "one", ["a.go", "b.go"])]
    formats.write_bounded(spark.range(3), str(tmp_path / "o"), 1000)
    with pytest.raises(ValueError):
        formats.write_bounded(spark.range(3), str(tmp_path / "o2"), 10)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"u":"a","ts":"2024-01-01T00:00:00Z","p":"src/x.go"}\n{"u":"a","ts":"2024-01-01T00:04:00Z","p":"tmp/y"}\n{"u":"b","ts":"2024-01-01T02:00:00Z","p":null}\n')
    stream = events.file_events(spark, str(tmp_path / "in"), "u string, ts timestamp, p string")
    ignored = spark.createDataFrame([("tmp/",), ("z",)], "entry string")
    kept = events.run_once(events.relevant(stream, ignored, "p"), "kept", str(tmp_path / "c1"))
    assert sorted(str(r.p) for r in kept.collect()) == ["None", "src/x.go"]
    got = events.run_once(events.sessions(stream, "u", "ts", "5 minutes", "1 minute"), "sessions", str(tmp_path / "c2"))
    assert [(r.u, r.n) for r in got.collect()] == [("a", 2)]
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    over = events.overlay(base, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), "k").collect()
    assert sorted(map(tuple, over)) == [("a", 1, False), ("b", 9, True), ("c", 3, True)]


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        return float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no data")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = plans.QUERIES[name](spark, DATA)
    cur = con.execute(plans.ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(df.collect(), df.columns) == norm(cur.fetchall(), columns)
