"""Event and fact sources, and keyed state, across restarts and in more than one order."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evergrain.streaming import freshness, sources

DAY = dt.datetime(2024, 1, 1)


def drain(df, table, checkpoint, fmt="parquet"):
    q = df.writeStream.format(fmt).option("path", str(table)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    except Exception:
        return sources.stop_reason(q)
    return sources.stop_reason(q)


def test_lines_once_each_across_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(1)
    want, out = [], tmp_path / "out"

    def grow(name, n, tail=b""):
        path = folder / name
        with open(path, "ab") as f:
            for _ in range(n):
                at = f.tell()
                text = "é" * rng.randint(0, 40) + str(rng.random())
                f.write(text.encode() + b"\n")
                want.append((name, at, text))
            f.write(tail)

    for k in range(3):  # a restart each: the stream is built anew over its checkpoint
        grow("a.txt", 200)
        grow(f"b{k}.txt", 30)
        assert drain(sources.lines(spark, str(folder), most_bytes="4000", chunk_bytes="700"), out, tmp_path / "cp") is None
    grow("a.txt", 0, b"half a li")
    drain(sources.lines(spark, str(folder), most_bytes="4000", chunk_bytes="700"), out, tmp_path / "cp")
    for _ in range(9):  # a file gives at most most_bytes a batch
        drain(sources.lines(spark, str(folder), most_bytes="4000", chunk_bytes="700"), out, tmp_path / "cp")
    got = [tuple(r) for r in spark.read.parquet(str(out)).select("file", "at", "value").collect()]
    assert sorted(got) == sorted(want)
    (folder / "b0.txt").write_bytes(b"x\n")
    assert "cut or replaced" in drain(sources.lines(spark, str(folder)), out, tmp_path / "cp")
    assert spark.read.parquet(str(out)).count() == len(want)


def test_facts_read_only_their_bucket(spark, tmp_path):
    rows = [(f"screen:{k}", "run", "note", None, f"text {k}") for k in range(400)] + [("flow:x", "other", "run-verified", "r1", None), (None, "n", "n", None, None)]
    folder = str(tmp_path / "facts")
    sources.write_facts(spark.createDataFrame(rows, "element string, source string, kind string, revision string, text string"), folder, 16)
    assert sources.overlay_facts(spark, folder).count() == 401
    asked = ["screen:7", "flow:x", "screen:none"]
    got = sources.overlay_facts(spark, folder, asked)
    assert {tuple(r) for r in got.collect()} == {("screen:7", "run", "note", None, "text 7", "learned"), ("flow:x", "other", "run-verified", "r1", None, "learned")}
    assert got.rdd.getNumPartitions() == len({sources.bucket(e, 16) for e in asked})
    # the other buckets are not read at all
    for n in set(range(16)) - {sources.bucket(e, 16) for e in asked}:
        for name in os.listdir(f"{folder}/bucket={n}"):
            if name.endswith(".json"):
                with open(f"{folder}/bucket={n}/{name}", "w") as f:
                    f.write("no json")
    assert got.count() == 2
    with pytest.raises(Exception, match="JSON|json|Expecting"):
        sources.overlay_facts(spark, folder).collect()
    assert sources.overlay_facts(spark, folder, ["screen:7"]).filter(F.col("element") == "screen:8").count() == 0


def observations(spark, folder, batches):
    """A folder of one file a batch, and its stream of a file a trigger."""
    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches):
        path = f"{folder}/{k:03}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps({"key": a, "digest": d, "at": (DAY + dt.timedelta(hours=h)).isoformat()}) + "\n" for a, d, h in rows)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema("key string, digest string, at timestamp").option("maxFilesPerTrigger", 1).json(folder)


def states(spark, folder, out, batches, late="2 days"):
    freshness.configure(spark)
    rows = []
    df = freshness.freshness(observations(spark, folder, batches), late, 24 * 3600 * 1000)
    q = df.writeStream.outputMode("update").option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(lambda d, n: rows.extend((n, *r) for r in d.collect())).start()
    q.awaitTermination()
    return rows


def last(rows):
    """What is known of each key at the end."""
    out = {}
    for _, key, state, digest, at, _ in sorted(rows, key=lambda r: r[0]):
        out[key] = None if state == "expired" else (digest, at)
    return out


def test_freshness_in_any_order_and_across_restarts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(6)}", rng.choice("abc"), rng.randrange(20)) for _ in range(60)]
    rows += rows[:5]
    want = {}
    for key, digest, h in rows:
        want[key] = max(want.get(key, (-1, "")), (h, digest))
    want = {k: (d, DAY + dt.timedelta(hours=h)) for k, (h, d) in want.items()}
    for n, order in enumerate((rows, rows[::-1], sorted(rows))):
        got = states(spark, str(tmp_path / f"in{n}"), str(tmp_path / f"cp{n}"), [order[k : k + 22] for k in range(0, 66, 22)])
        assert last(got) == want
    # half of the batches, then a restart from the checkpoint with all of them: as without one
    parts = [rows[:30], rows[30:]]
    first = states(spark, str(tmp_path / "in9"), str(tmp_path / "cp9"), parts[:1])
    rest = states(spark, str(tmp_path / "in9"), str(tmp_path / "cp9"), parts)
    assert last(first + rest) == want and {r[0] for r in first}.isdisjoint({r[0] for r in rest})


def test_freshness_states_and_expiry(spark, tmp_path):
    batches = [[("a", "x", 1), ("b", "x", 1)], [("a", "x", 2)], [("a", "y", 3)], [("a", "z", 0)], [("c", "x", 60)], [("c", "x", 61)]]
    got = [(r[1], r[2], r[3], r[5]) for r in states(spark, str(tmp_path / "in"), str(tmp_path / "cp"), batches, "6 hours")]
    by = lambda key: [r[1:] for r in got if r[0] == key]
    assert by("a")[:4] == [("new", "x", None), ("unchanged", "x", "x"), ("changed", "y", "x"), ("late", "y", "y")]
    assert by("a")[4:] == [("expired", None, "y")] and by("b") == [("new", "x", None), ("expired", None, "x")]
    assert by("c")[0] == ("new", "x", None)
