"""XML reports, lexers, identifier graph, personalised rank, paired bootstrap."""

from pyspark.sql import functions as F

from evergrain.functions import lexers
from evergrain.operators import graph, search
from evergrain.sources import xmlcov


def test_xml_reports(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<report name="r"><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="0" ci="2"/><line nr="4" mi="1" ci="0"/></sourcefile></package></report>')
    assert sorted(map(tuple, xmlcov.jacoco(spark, str(tmp_path / "j.xml")).collect())) == [("p/q/A.java", 3, 2), ("p/q/A.java", 4, 0)]
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="0"/><line number="2" hits="1"/></lines></class><class filename="a.py"><lines><line number="1" hits="5"/></lines></class></classes></package></packages></coverage>')
    assert sorted(map(tuple, xmlcov.cobertura(spark, str(tmp_path / "c.xml")).collect())) == [("a.py", 1, 5), ("a.py", 2, 1)]


def test_lexers(spark):
    df = spark.createDataFrame([('x = "//no" // yes\n/* a\nb */ y',), (None,)], "s string")
    got = [r.m for r in df.select(lexers.comment_mask("//", ("/*", "*/"))("s").alias("m")).collect()]
    assert got == [" " * 11 + "// yes\n/* a\nb */  ", None]
    md = spark.createDataFrame([("a\n```py\nb\n~~~\nc\n```\nd",)], "s string")
    assert md.select(lexers.fenced_lines("s").alias("x")).first().x == [3, 4, 5]
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("x",)], "s string")
    assert [r.x is None for r in rows.select(lexers.structured_problem("json")("s").alias("x")).collect()] == [True, False, False]
    assert spark.createDataFrame([("a = 1\n[b]\nc = 'x'",)], "s string").select(lexers.structured_problem("toml")("s").alias("x")).first().x is None


def test_identifier_graph_and_rank(spark):
    d = spark.createDataFrame([("retry_loop", "a"), ("seed", "a"), ("httpRetry", "c"), ("Foo", "a")], "name string, path string")
    m = spark.createDataFrame([("retry_loop", "b"), ("retry_loop", "c"), ("seed", "z"), ("httpRetry", "b"), ("Foo", "z")], "name string, path string")
    e = graph.identifier_graph(d, m)
    assert sorted(map(tuple, e.filter("src < dst").collect())) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]
    r = graph.personal_rank(e, spark.createDataFrame([("a",)], "node string"), least=0.02).collect()
    assert [x.node for x in r] == ["b", "c"] and r[0].score == r[1].score > 0


def test_paired_bootstrap(spark):
    df = spark.range(60).select("id", (F.col("id") % 7 + 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b"))
    r = search.paired_bootstrap(df, "id", "a", "b", rounds=400).first()
    assert r.low < r.mean < r.high and r.high - r.low < 3


def test_forward_push_leaves_small_residuals(spark):
    import random

    rng = random.Random(5)
    pairs = {(a, b): rng.randint(1, 4) for a in range(40) for b in rng.sample(range(40), 3) if a != b}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", w) for (a, b), w in pairs.items()], "src string, dst string, weight long")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n1",)], "node string")
    got = {r.node: (r.rank, r.residual) for r in graph.forward_push(edges, seeds, least=2e-3).collect()}
    assert all(0 <= r < 2e-3 for _, r in got.values()) and abs(sum(p + r for p, r in got.values()) - 1) < 1e-9
    out = {a: sum(w for (x, _), w in pairs.items() if x == a) for a in range(40)}
    mass, rank = {1: 0.5, 2: 0.5}, dict.fromkeys(range(40), 0.0)
    for _ in range(300):
        new = dict.fromkeys(range(40), 0.0)
        for a, m in mass.items():
            rank[a] += 0.15 * m
            for (x, b), w in pairs.items():
                if x == a:
                    new[b] += 0.85 * m * w / out[a]
        mass = new
    total = sum(r for _, r in got.values())
    assert all(-1e-9 <= rank[a] - got.get(f"n{a}", (0, 0))[0] <= total for a in range(40))
    assert graph.forward_push(edges, seeds, most_pushes=3) is None and graph.forward_push(edges, seeds, most_arcs=5) is None and graph.forward_push(edges, seeds.limit(0)) is None
    assert graph.personal_rank(edges, seeds.limit(0)).count() == 0 and graph.personal_rank(edges, seeds, most_nodes=3).count() == 0


def test_ranks_without_bounds_are_whole(spark, monkeypatch):
    """The query ranks tables of any size: no bound of the operator applies to it."""
    from evergrain.plans import evidence

    rows = [(s, p) for s in range(1, 30) for p in range(s, s + 6)]
    li = spark.createDataFrame(rows, "l_suppkey long, l_partkey long")
    monkeypatch.setattr(evidence, "table", lambda *_: li)
    small = graph.forward_push
    monkeypatch.setattr(graph, "forward_push", lambda *a, **k: small(*a, **{"most_nodes": 3, "most_arcs": 3, "most_pushes": 3, **k}))
    got = evidence.personal_ranks(spark, "")
    assert got.count() == 5


def test_spans_of_one_place_fit_together(spark):
    """Keys beyond 100,000 make lines of an order share a place; the budget counts them at once, as the SQL's frame does."""
    import duckdb

    from evergrain.plans import evidence

    rows = [(1, 1, 1, 100_001, 30.0), (1, 2, 2, 1, 29.0), (1, 3, 1, 100_002, 25.0), (1, 1, 3, 300_002, 24.0), (2, 1, 1, 200_005, 40.0), (2, 2, 2, 100_005, 20.0), (2, 3, 3, 5, 60.0), (2, 5, 4, 7, 90.0)]
    li = spark.createDataFrame([(o, n, p, s, q) for o, n, s, p, q in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INTEGER, l_suppkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", rows)
    old, evidence.table = evidence.table, lambda *_: li
    try:
        got = sorted(map(tuple, evidence.span_budget(spark, "").collect()))
    finally:
        evidence.table = old
    from evergrain.plans import queries as plans

    assert got == sorted(con.execute(plans.ORACLE["span_budget"]).fetchall())


def test_bootstrap_is_dealt_over_tasks(spark):
    """One file of few bytes is no one task: the resamples' weights are drawn by many."""
    df = spark.range(0, 500, 1, 1).select("id", (F.col("id") % 7 + 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b"))
    got = search.paired_bootstrap(df, "id", "a", "b", rounds=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" in plan and "REPARTITION_BY_NUM" in plan
    import hashlib

    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    means = []
    for r in range(50):
        drawn = [(sum(int(hashlib.md5(f"{k}:{r}".encode()).hexdigest()[:8], 16) / 2**32 >= c for c in cuts), k % 7 + 1 - k % 5) for k in range(500)]
        means.append(sum(w * d for w, d in drawn) / sum(w for w, _ in drawn))
    means.sort()
    at = lambda p: means[int(49 * p)] + (49 * p - int(49 * p)) * (means[int(49 * p) + 1] - means[int(49 * p)])
    row = got.first()
    assert abs(row.low - at(0.025)) < 1e-8 and abs(row.high - at(0.975)) < 1e-8


def test_cover_profile_sends_the_modes(spark):
    """A long profile is not joined in the one task of its path."""
    from evergrain.sources import formats

    lines = spark.range(5000).select(F.concat(F.lit("p"), (F.col("id") % 1).cast("string")).alias("path"), F.col("id").alias("line"), F.when(F.col("id") == 0, "mode: set").otherwise(F.concat(F.lit("a.go:1.2,"), F.col("id").cast("string"), F.lit(".9 1 2"))).alias("value"))
    got = formats.coverprofile(lines)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 4999 and "BroadcastHashJoin" in plan and "hashpartitioning(path" not in plan
