"""Common blocks of coverage records, and a sink that leaves all or nothing."""

import os
import random

import pytest

from evergrain.operators import coverage
from evergrain.sources import sinks


def test_common_blocks(spark):
    rng = random.Random(3)
    rows = [("f", f"r{rng.randrange(4)}", s, s + rng.randint(0, 9), rng.random() < 0.6) for s in (rng.randrange(60) for _ in range(40))] + [("g", "r0", 5, 9, True), ("g", "r0", 9, 12, True), ("g", "r1", 5, 12, False)]
    df = spark.createDataFrame(rows, "file string, run string, s int, e int, hit boolean")
    blocks = coverage.common_blocks(df, "file", "run", "s", "e", "hit")
    got = {(r.file, r.start, r.end): tuple(r.runs) for r in blocks.collect()}
    want = {}
    for f in "fg":
        at = None
        for unit in range(80):
            seen = [r for r in rows if r[0] == f and r[2] <= unit < r[3]]
            state = tuple(sorted({r[1] for r in seen if r[4]})) if seen else None
            if state is not None and at is not None and want[at][0] == state:
                want[at][1] = unit + 1
            elif state is not None:
                at = (f, unit)
                want[at] = [state, unit + 1]
            if state is None:
                at = None
    assert got == {(f, s, e): state for (f, s), (state, e) in want.items()}
    lines = {(r.run, r.line) for r in coverage.profiles(blocks, df, "file", "run").collect() if r.file == "g"}
    assert lines == {("r0", "g:5.1,12.1 1 1"), ("r1", "g:5.1,12.1 1 0")}


def test_sink_leaves_all_or_nothing(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "concat('é ', id) AS text", "CASE WHEN id % 3 > 0 THEN array(id, null) END AS a").repartition(4)
    at = str(tmp_path / "index")
    sinks.write_index(df, at, 100_000)
    back = sinks.read_index(spark, at, "id long, text string, a array<long>")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    for most, name in ((20_000, "sum"), (300, "task")):  # the sum is over the bound, or a task alone
        with pytest.raises(Exception, match="over the bound"):
            sinks.write_index(df, str(tmp_path / name), most)
    with pytest.raises(Exception, match="index"):
        sinks.write_index(df, at, 100_000)
    from pyspark.sql import functions as F

    torn = df.withColumn("id", F.when(F.col("id") == 777, F.raise_error(F.lit("torn"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="torn"):
        sinks.write_index(torn, str(tmp_path / "torn"), 100_000)
    assert os.listdir(tmp_path) == ["index"]
    sinks.write_index(df.limit(0), str(tmp_path / "none"), 10)
    assert sinks.read_index(spark, str(tmp_path / "none"), "id long").count() == 0
    os.remove(f"{at}/{sorted(n for n in os.listdir(at) if n.endswith('.jsonl'))[0]}")
    with pytest.raises(ValueError, match="parts"):
        sinks.read_index(spark, at, "id long")


def test_blocks_are_joined_without_python_and_profiles_tell_their_numbers(spark):
    rows = [("f", "r1", 0, 4, True), ("f", "r2", 2, 6, True), ("f", "r2", 2, 6, True), ("f", "r3", 6, 8, False)]
    df = spark.createDataFrame(rows, "file string, run string, s int, e int, hit boolean")
    blocks = coverage.common_blocks(df, "file", "run", "s", "e", "hit")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    assert {(r.start, r.end, tuple(r.runs)) for r in blocks.collect()} == {(0, 2, ("r1",)), (2, 4, ("r1", "r2")), (4, 6, ("r2",)), (6, 8, ())}
    lines = coverage.profiles(blocks, df, "file", "run").collect()
    assert len(lines) == 12 and all(r.line == f"{r.file}:{r.start}.1,{r.end}.1 1 {int(r.ran)}" for r in lines)
