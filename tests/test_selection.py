"""Selection operators, whole queries and new formats against brute force on small fixtures."""

import io
import json
import random
import re
import zipfile
from collections import Counter
from itertools import combinations

import pytest

import __spark_entry__
from evergrain import registry
from evergrain.functions import exact, lexers, text
from evergrain.operators import selection, sequence
from evergrain.plans.queries import most_paths
from evergrain.sources import archives, formats


def test_whole_queries(spark, tmp_path):
    rng, d = random.Random(2), str(tmp_path)
    li = [(o, rng.randint(1, 6), rng.randint(1, 4), float(rng.randint(1, 50))) for o in range(60) for _ in range(rng.randint(1, 9))]
    orders = [(o, o % 7) for o in range(62)]
    letters = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs = [(k, letters(12)) for k in range(40)] + [(1, "A, b a"), (2, None), (3, "b-a b"), (3, "b-a b")]
    asked = [(0, "b"), (1, "a a"), (2, "b a b"), (3, "a B a. b"), (4, letters(7)), (5, ""), (6, "a b a c"), (7, None), (8, docs[0][1])]
    for name, rows, schema in (("lineitem", li, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"), ("orders", orders, "o_orderkey long, o_custkey long"), ("documents", docs, "doc_id long, text string"), ("benchmark", asked, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    names = ("shortest_path", "reach_frontier", "redundancy_kinds", "cochange", "phrase_match")
    got = {name: [tuple(r) for r in __spark_entry__.queries()[name](spark, d).collect()] for name in names}

    edges = {(f"s{s}", f"p{p}") for _, p, s, _ in li} | {(f"p{p}", f"o{o}") for o, p, _, _ in li} | {(f"o{o}", f"c{c}") for o, c in orders}

    def paths(seeds):
        found = {s: (0, s) for s in seeds}
        for hop in (1, 2, 3):
            step: dict = {}
            for a, b in edges:
                if b not in found and a in found and found[a][0] == hop - 1:
                    step[b] = min(step.get(b, (hop, "~")), (hop, f"{found[a][1]}>{b}"))
            found |= step
        return found

    assert sorted(got["shortest_path"]) == sorted((n, h, p) for n, (h, p) in paths(["s1", "s2"]).items())
    assert sorted(got["reach_frontier"]) == sorted((k, h, n) for (k, h), n in Counter((n[0], h) for n, (h, _) in paths(["s1", "s2", "s3"]).items()).items())

    sets: dict = {o: set() for o, _ in orders}
    for o, p, _, _ in li:
        sets[o].add(p)
    df = Counter(p for s in sets.values() for p in s)
    want = []
    for o, s in sets.items():
        own = sum(df[p] == 1 for p in s)
        equal = [x for x, u in sets.items() if u == s and x != o]
        over = [(len(u), x) for x, u in sets.items() if u > s]
        kind = "no-blocks" if not s else "equal" if equal else "subset" if over else "union" if not own else "low-unique" if own <= 1 else None
        if kind:
            want.append((o, kind, min(equal) if kind == "equal" else min(over)[1] if kind == "subset" else None, len(s), own))
    assert sorted(got["redundancy_kinds"], key=str) == sorted(want, key=str)

    cap = most_paths(len(sets))
    assert [most_paths(n) for n in (0, 50, 125, 200, 999)] == [50, 50, 29, 8, 8]
    pairs = Counter(x for s in sets.values() if len(s) <= cap for x in combinations(sorted(s), 2))
    assert sorted(got["cochange"]) == sorted((a, b, n) for (a, b), n in pairs.items())

    plain = lambda t: " ".join(re.findall("[a-z]+", (t or "").lower()))
    hold = {i: sum(f" {plain(q)} " in f" {plain(t)} " for t in {t for _, t in docs}) for i, q in asked if plain(q)}
    assert sorted(got["phrase_match"]) == sorted((i, n) for i, n in hold.items() if n) and hold[8]


def test_redundancy_of_random_sets(spark):
    rng = random.Random(5)
    sets = {o: set(rng.sample(range(12), rng.randint(1, 5))) for o in range(80)} | {100: {50, 51}, 101: {60, 1}}
    rows = [(o, i) for o, s in sets.items() for i in s]
    got = {r.o: (r.kind, r.by) for r in selection.redundancy(spark.createDataFrame(rows, "o long, i long"), "o", "i").collect()}
    df = Counter(i for _, i in rows)
    for o, s in sets.items():
        equal, over = [x for x, u in sets.items() if u == s and x != o], [(len(u), x) for x, u in sets.items() if u > s]
        own = sum(df[i] == 1 for i in s)
        want = ("equal", min(equal)) if equal else ("subset", min(over)[1]) if over else ("union", None) if not own else ("low-unique", None) if own <= 1 else None
        assert got.get(o) == want


def test_text_rules(spark):
    from pyspark.sql import functions as F

    rows = [("work",), ("set",), ("revoke",), ("toy",), ("ab",), ("HTTPServer",), ("getURLs",), ("file10",), ("99",), ("9" * 30,), ("1" + "0" * 30,), ("a%3A",), ("a%3a",), ("%41",)]
    got = {r.s: r for r in spark.createDataFrame(rows, "s string").select("s", text.inflections(F.col("s")).alias("f"), text.slug(F.col("s")).alias("slug"), text.natural_key(F.col("s")).alias("k"), text.percent_unescape(F.col("s")).alias("u")).collect()}
    assert got["work"].f == ["works", "workes", "worked", "working"]
    assert got["set"].f[4:] == ["setted", "setting"] and got["revoke"].f[4:] == ["revoked", "revoking"] and len(got["toy"].f) == 4 and got["ab"].f == []
    assert got["HTTPServer"].slug == "httpserver" and got["getURLs"].slug == "get-urls" and got["99"].slug == "unnamed"
    assert got["99"].k < got["9" * 30].k < got["1" + "0" * 30].k
    assert got["a%3A"].u == "a:" and got["a%3a"].u is None and got["%41"].u is None
    long = "word-" * 19 + "wxyz"
    (r,) = spark.createDataFrame([(long,)], "s string").select(text.slug(F.col("s")).alias("x"), text.bounded_line(F.lit("é" * 150)).alias("l")).collect()
    assert r.x == ("word-" * 19 + "w")[:96].strip("-") and len(r.l.encode()) in range(197, 201) and r.l.endswith("...")


def test_places_are_exact(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(k, rng.randint(0, 40)) for k in range(500)] + [(500, None)]
    got = {r.k: r.place for r in sequence.numbered(spark.createDataFrame(rows, "k long, v long"), F.col("v"), [F.col("k")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {k: n for n, (k, _) in enumerate(want, 1)}


def test_yaml_and_structured(spark):
    source = 'openapi: "3.0" # v\ninfo:\n  title: A \'quoted\' b\n  tags: [1, "x"]\npaths:\n  /a:\n    - get: true\n      id: 7\n    - plain\nnote: |\n  one\n   two\nempty:\n'
    assert lexers.parse_yaml(source) == {"openapi": "3.0", "info": {"title": "A 'quoted' b", "tags": [1, "x"]}, "paths": {"/a": [{"get": True, "id": 7}, "plain"]}, "note": "one\n two\n", "empty": None}
    for bad in ("a: 1\na: 2", "a:\n  b: 1\n c: 2", "a: &x 1", "\ta: 1"):
        with pytest.raises(ValueError):
            lexers.parse_yaml(bad)
    good = {"json": '{"a":1}', "jsonl": '{"a":1}\n\n[2]', "toml": "a = 1", "yaml": "a: 1", "properties": "a=1\n# c\nb: 2", "hcl": 'r "x" {\n a = [1] # }\n}', "xml": "<a/>", "svg": "<svg/>", "plist": '<plist version="1.0"><dict/></plist>', "webmanifest": "{}"}
    wrong = {"json": '{"a":1,"a":2}', "jsonl": "{", "toml": "a = ", "yaml": "a: 1\na: 2", "properties": "a=1\na=2", "hcl": "a {", "xml": "<a>", "svg": "<a/>", "plist": "<plist", "webmanifest": "[]"}
    for kind in good:
        rows = spark.createDataFrame([(good[kind],), (wrong[kind],)], "s string")
        a, b = [r.p for r in rows.select(lexers.structured_problem(kind)("s").alias("p")).collect()]
        assert a is None and b, kind
    assert spark.createDataFrame([('["\\ud800"]',)], "s string").select(lexers.structured_problem("json")("s").alias("p")).first().p


def test_masks_and_maps(spark):
    code = 'const a = `x ${b + "s"} y`; /* c */ let d = <p class="k">text {e} more</p>; // end'
    (r,) = spark.createDataFrame([(code,)], "s string").select(lexers.web_code_mask("s").alias("m"), exact.source_positions("s").alias("p")).collect()
    assert len(r.m) == len(code) and r.p is None
    assert all(w not in r.m for w in ("text", "more", "end", " c ", "x $")) and all(w in r.m for w in ("const a", "b +", "let d", "{e}"))
    (r,) = spark.createDataFrame([("AAAA,CAAC;;EAEEA",)], "s string").select(exact.source_positions("s").alias("p")).collect()
    assert [(x.line, x.column, x.source_line, x.source_column, x.name) for x in r.p] == [(1, 0, 0, 0, None), (1, 1, 0, 1, None), (3, 2, 2, 3, 0)]


def test_archives(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, url in (("10-trace.trace", "c"), ("2-trace.trace", "b"), ("trace.trace", "a"), ("other.txt", "z")):
            z.writestr(name, json.dumps({"method": "goto", "params": {"url": url}, "startTime": 1}) + "\n" + json.dumps({"method": "click"}) + "\n")
    got = archives.trace_events(spark.createDataFrame([("t", bytearray(raw.getvalue()))], "path string, content binary")).collect()
    assert [(r.context, r.url) for r in sorted(got, key=lambda r: r.place)] == [(-1, "a"), (2, "b"), (10, "c")]


def test_databases_are_of_bounded_size(spark, monkeypatch):
    """Ranges follow the rows, and a key of half the rows goes on in further databases of its part."""
    monkeypatch.setattr(archives, "_ROWS", 500, raising=False)
    monkeypatch.setattr(archives, "_MB", 1, raising=False)
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, 7, id) AS k", "id + (1L << 60) AS v", "if(id % 3 = 0, null, repeat('x', 400)) AS t")
    dbs = archives.to_sqlite(df, "x", "k").selectExpr("part", "content", "length(content) AS size").cache()
    sizes = dbs.select("part", "size").collect()
    assert len({r.part for r in sizes}) == 40 and len(sizes) > 40 and max(r.size for r in sizes) < 5 << 20
    rows = lambda got: Counter(map(tuple, got.collect()))
    assert rows(archives.from_sqlite(dbs, "x", "k long, v long, t string")) == rows(df)
    assert rows(archives.from_sqlite(dbs, "x", "k long, v long, t string", "k = ?", (7,))) == rows(df.filter("k = 7"))
    dbs.unpersist()
    assert archives.to_sqlite(df.limit(0), "x", "k").count() == 0


def test_revisions_are_pruned(spark, tmp_path):
    from evergrain.sources.tables import pin, snapshot

    spark.createDataFrame([("r1", "a", "x"), ("r2", "b", "y")], "rev string, path string, body string").write.partitionBy("rev").parquet(str(tmp_path / "files"))
    df = snapshot(spark, str(tmp_path / "files"), "r2")
    assert [tuple(r) for r in df.collect()] == [("b", "y")]
    plan = pin(df, ["path"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rev" in plan and "body" not in plan.split("ReadSchema")[1]


def test_registries(spark):
    from pyspark.sql import functions as F

    spark.dataSource.register(registry.CommandSource)
    one = spark.read.format("evidence_command").option("argv", json.dumps(["echo", '{"entities":[],"relations":[]}'])).load()
    entities, _ = formats.external_records(one, "record")
    assert entities.count() == 0
    dialects = registry.Dialects(registry.Dialect("js", [".js", ".test.js"], imports=text.import_specifiers))
    with pytest.raises(ValueError):
        dialects.add(registry.Dialect("other", [".js"]))
    row = spark.createDataFrame([("a.js", "import 'x'"), ("b.go", "import 'y'")], "path string, t string").select(dialects.apply("imports", F.col("path"), F.col("t"), F.array().cast("array<string>")).alias("i")).collect()
    assert [r.i for r in row] == [["x"], []]
    base = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, value string")
    over = registry.Overlays()
    over.add("first", lambda s: s.createDataFrame([("k2", "c"), ("k3", "d")], "key string, value string"))
    assert {tuple(r) for r in over.over(base, "key", "value").collect()} == {("k1", "a", None), ("k2", "c", "first"), ("k3", "d", "first")}
    trees = spark.createDataFrame([("r", "p", "100644", "o1")], "revision string, path string, mode string, oid string")
    repo = registry.Repository(trees, spark.createDataFrame([("o1", "text")], "oid string, body string"))
    assert repo.blob("r", "p").first().body == "text"
    assert {tuple(r) for r in repo.base_blobs(spark.createDataFrame([("p",), ("q",)], "path string"), "r").collect()} == {("p", "o1", "text"), ("q", None, None)}
    history = registry.History(spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("c1", None)], "child string, parent string"), spark.createDataFrame([("c3", "f"), ("c1", "g")], "commit string, path string"))
    assert history.resolve("c3").first().state == "resolved" and history.resolve("c").first().state == "ambiguous" and history.resolve("x").first().state == "unknown"
    assert history.is_ancestor("c1", "c3") and not history.is_ancestor("c3", "c1") and [r.path for r in history.changed("c1", "c3").collect()] == ["f"]
    runners = registry.Runners()
    runners.add(registry.Runner("tap", lambda t: ["prove", *t], formats.tap))
    assert runners.invocation("tap", ["a.t"]) == ["prove", "a.t"]
    report = spark.createDataFrame([("r", 1, "ok 1 - fine")], "path string, line long, value string")
    assert runners.observe("tap", report).first().verdict == "pass"
    with pytest.raises(ValueError):
        runners.invocation("tap", ["--evil"])


def test_patches_that_do_not_stand(spark):
    rows = [("a\nb\nc", [(2, ["b"], ["x", "y"])]), ("a\nb", [(2, ["z"], [])]), ("a\nb", [(1, ["a"], []), (1, ["a"], [])]), (None, [])]
    df = spark.createDataFrame(rows, f"old string, hunks {exact.HUNKS}")
    assert [r.n for r in df.select(exact.apply_hunks("old", "hunks").alias("n")).collect()] == ["a\nx\ny\nc", None, None, None]


def test_candidates_are_masked_before_they_are_compared(spark):
    """Sets past 64 items fill their mask, and items that share a bit pass it: the counts decide."""
    rng = random.Random(6)
    sets = {o: set(rng.sample(range(100), rng.choice([1, 2, 3, 70, 90]))) for o in range(120)} | {200: set(range(100)), 201: set(range(100))}
    got = selection.redundancy(spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "o long, i long"), "o", "i")
    for r in got.collect():
        equal, over = [x for x, u in sets.items() if u == sets[r.o] and x != r.o], [(len(u), x) for x, u in sets.items() if u > sets[r.o]]
        assert (r.kind, r.by) == (("equal", min(equal)) if equal else ("subset", min(over)[1]))
    assert got.count() == len(sets)
    assert "_by_mask" in got._jdf.queryExecution().optimizedPlan().toString()
