"""Exact ranks against sorting."""

import math
import random

import pytest

from evergrain.operators import report


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_ranks_of_every_shape(spark, accuracy):
    """Ties, one value, few values, wide ranges, nulls; with a coarse sketch brackets miss and are widened."""
    rng = random.Random(2)
    values = {"ties": [float(rng.randrange(3)) for _ in range(3000)], "one": [4.0], "two": [1.0, 9.0], "wide": [rng.random() * 10 ** rng.randint(-9, 9) for _ in range(4000)], "same": [7.0] * 500, "none": [None], "some": [None, 3.0, 1.0, 2.0], "tail": [0.0] * 2000 + [float(k) for k in range(60)]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    ranks = {x: (p, lambda n, p=p: report.F.greatest(report.F.lit(1), report.F.ceil(n * report.F.lit(p)))) for x, p in shares.items()}
    got = {r.k: r for r in report.selected(df, ["k"], "v", ranks, accuracy).collect()}
    for k, vs in values.items():
        own = sorted(v for v in vs if v is not None)
        if not own:
            assert k not in got
            continue
        assert got[k].n == len(own)
        for x, p in shares.items():
            assert got[k][x] == own[max(1, math.ceil(p * len(own))) - 1], (k, x)
    mid = {r.k: r.m for r in report.medians(df, ["k"], "v", "m").collect()}
    for k, vs in values.items():
        own = sorted(v for v in vs if v is not None)
        if own:
            assert mid[k] == (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2


def test_ranks_of_one_hot_key_and_empty(spark):
    n = 300_000
    df = spark.range(n).selectExpr("'k' AS k", "(id * 7919) % 300007 AS v")
    (r,) = report.nearest_ranks(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    own = sorted(k * 7919 % 300007 for k in range(n))
    assert (r.p50, r.p95, r.n) == (own[n // 2 - 1], own[math.ceil(0.95 * n) - 1], n)
    assert report.nearest_ranks(df.limit(0), ["k"], "v", {"p50": 0.5}).count() == 0


def test_places_of_ties_and_nulls(spark):
    from evergrain.operators import sequence

    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "a", "b", f"k{rng.randrange(40)}"]), k, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, _part string").withColumnRenamed("_part", "more").repartition(7)
    got = sequence.numbered(df, report.F.col("k"), [report.F.col("i").desc()]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.place)] == [r[:2] for r in want] and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(1, 3001))
    assert sequence.numbered(df.limit(0), report.F.col("k"), []).count() == 0
