"""Containment by blocks against all pairs."""

import random

import pytest

from evergrain.operators import joins, selection, sweep


def inside(q, b):
    low, high = q
    return b[0] < low and high < b[1] if low <= high else b[0] <= high and low <= b[1]


@pytest.mark.parametrize("nested", [True, False])
def test_around_against_all_pairs(spark, nested):
    rng = random.Random(nested)

    def nest(lo, hi):
        """Bodies in bodies, some of equal edges."""
        out, at = [(lo, hi)], lo + 1
        while at < hi - 2:
            end = rng.randint(at + 1, min(hi, at + max(2, (hi - lo) // 2)))
            out += nest(at, end) if rng.random() < 0.8 and end - at > 3 else [(at, end)]
            at = end + rng.randint(0, 9)
        return out

    spans = nest(-50, 900) if nested else [(a, a + rng.choice([0, 1, 3, 40, 2000])) for a in (rng.randint(-300, 900) for _ in range(250))]
    bodies = [("hot", 1, o, c, f"{o}-{c}") for o, c in spans] + [("a", 1, 5, 9, "x"), ("a", 2, 5, 9, "y"), ("b", 1, 9, 5, "torn"), ("b", 1, None, 4, "none")]
    asked = [("hot", 1, p, p + rng.randint(0, 20)) for p in (rng.randint(-320, 950) for _ in range(300))] + [("hot", 1, p + 1, p) for p in range(-60, 950, 7)]
    asked += [("a", 1, 6, 8), ("a", 2, 6, 6), ("a", 3, 6, 6), ("a", 1, 5, 5), ("a", 1, 6, 5), ("a", 1, 9, 8), ("a", 1, 10, 9), ("a", 1, None, 3), ("b", 1, 6, 6)] + [("hot", 1, 400, 400)] * 50
    q = spark.createDataFrame(asked, "f string, g int, lo int, hi int").repartition(3)
    b = spark.createDataFrame(bodies, "f string, g int, open int, close int, name string").repartition(3)
    every = {tuple(r) for r in sweep.around(q, b, ["f", "g"], "lo", "hi", every=True).collect()}
    fits = {(*a, *body[2:]) for a in asked for body in bodies if a[2] is not None and body[2] is not None and body[2] <= body[3] and a[:2] == body[:2] and inside(a[2:], body[2:4])}
    assert every == fits and len(every) > 500
    got = sweep.around(q, b, ["f", "g"], "lo", "hi").collect()
    best = {}
    for r in fits:
        best[r[:4]] = min(best.get(r[:4], r), r, key=lambda r: (r[5] - r[4], -r[4]))
    assert len(got) == len(best) and {tuple(r)[:6] for r in got} == {r[:6] for r in best.values()}
    assert sweep.around(q, b.limit(0), ["f", "g"], "lo", "hi").count() == 0 and sweep.around(q.limit(0), b, ["f", "g"], "lo", "hi").count() == 0


def test_one_file_of_many_bodies(spark):
    """A hot file spreads over blocks; a body that spans it all is copied to them, once each."""
    n = 200_000
    b = spark.range(n).selectExpr("'f' AS f", "id * 10 AS open", "id * 10 + 8 AS close").unionByName(spark.createDataFrame([("f", -1, 10 * n)], "f string, open long, close long"))
    q = spark.range(n).selectExpr("'f' AS f", "id * 10 + id % 10 AS lo", "id * 10 + id % 10 AS hi")
    got = sweep.around(q, b, ["f"], "lo", "hi")
    assert got.groupBy().agg({"open": "sum", "*": "count"}).first()["count(1)"] == n
    assert got.filter("close - open > 8").count() == sum(k % 10 in (0, 8, 9) for k in range(n))


def test_containing(spark):
    points = spark.createDataFrame([("k", 1, "p"), ("k", 5, "q"), ("k", 5, "r"), ("m", 5, "s")], "k string, at int, name string")
    spans = spark.createDataFrame([("k", 1, 5, "A"), ("k", 5, 5, "B"), ("k", 6, 9, "C"), ("m", 0, 4, "D")], "k string, s int, e int, span string")
    got = {(r.name, r.span) for r in joins.containing(points, spans, ["k"], "at", "at", "s", "e").collect()}
    assert got == {("p", "A"), ("q", "A"), ("r", "A"), ("q", "B"), ("r", "B")}


def test_nearest_keeps_the_columns_of_its_questions(spark):
    """Packed lengths, lengths past them, and bodies with columns of their own give one answer; it is made without Python."""
    rng = random.Random(3)
    spans = [(o, o + rng.choice([0, 2, 5, 60])) for o in (rng.randint(-40, 300) for _ in range(400))]
    asked = [(k, p, p + rng.randint(-1, 6)) for k, p in enumerate(rng.randint(-50, 320) for _ in range(300))]
    q = spark.createDataFrame([("f", *a) for a in asked] * 2 + [("f", 900, None, 1), (None, 901, 5, 5), ("g", 902, 5, 5)], "f string, k int, lo int, hi int")
    for extra in ([], [(-(1 << 33), 1 << 33)]):
        bodies = spans + extra
        want = {}
        for k, lo, hi in asked:
            around = [b for b in bodies if inside((lo, hi), b)]
            want[k] = min(around, key=lambda b: (b[1] - b[0], -b[0])) if around else (None, None)
        b = spark.createDataFrame([("f", *b) for b in bodies], "f string, open long, close long")
        for body in (b, b.selectExpr("f", "open", "close", "open || '' AS name")):
            found = sweep.nearest(q, body, ["f"], "lo", "hi", "left")
            got = found.collect()
            assert len(got) == 303 and {r.k: (r.open, r.close) for r in got} == want | {900: (None, None), 901: (None, None), 902: (None, None)}
            assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
            assert sweep.nearest(q, body, ["f"], "lo", "hi").count() == sum(x[0] is not None for x in want.values())


def test_hunks_that_are_alike_and_lines_of_one_body(spark):
    rng = random.Random(4)
    methods = [(f, o, o + rng.choice([3, 9, 30])) for f in "ab" for o in rng.choices(range(100), k=60)]
    hunks = [(f, p, p, p + p % 3 - 1) for f in "ab" for p in rng.choices(range(-5, 120), k=80)]
    lines = [(f, p, f"t{rng.randint(0, 4)}") for f in "ab" for p in rng.choices(range(0, 60), k=90)]
    frame = spark.createDataFrame
    got = selection.hunk_tests(frame(hunks, "f string, hunk int, start int, end int"), frame(methods, "f string, open int, close int"), frame(lines, "f string, line int, test string"), "f").collect()
    want = {}
    for f, hunk, lo, hi in hunks:
        around = [m[1:] for m in methods if m[0] == f and inside((lo, hi), m[1:])]
        body = min(around, key=lambda b: (b[1] - b[0], -b[0])) if around else None
        tests = sorted({t for g, p, t in lines if body and g == f and body[0] < p < body[1]})
        want[f, hunk] = ("selected" if tests else "no executed line" if body else "outside a method", ",".join(tests))
    assert len(got) == len(want) and {(r.f, r.hunk): (r.state, r.tests) for r in got} == want


def test_fallback_meets_equal_names_first(spark):
    rows = [(1, "good", "a,b"), (1, "good", "b,c"), (1, "good", None), (2, "lost", "a"), (2, "bad", ""), (None, "good", ""), (None, "good", "z,z")]
    df = spark.createDataFrame(rows, "k int, state string, tests string")
    got = selection.with_fallback(df, "state", "good", "tests", ["k"])
    assert {tuple(r) for r in got.collect()} == {(1, False, None, "a,b,c"), (2, True, "bad", None), (None, False, None, "z")}
    assert [tuple(r) for r in selection.with_fallback(df.filter("k = 1"), "state", "good", "tests").collect()] == [(False, None, "a,b,c")]
    assert [tuple(r) for r in selection.with_fallback(df.limit(0), "state", "good", "tests").collect()] == [(False, None, "")]
    # a change's lists of tests are not gathered whole
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()
