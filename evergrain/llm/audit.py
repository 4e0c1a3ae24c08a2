"""How filters overlap: what each removes, alone and behind the others, in every order, per part of the table.

Each row gets a mask of the filters it fails, whatever other filters do to it. Four filters read the row alone; the fifth,
copies of an earlier text, is found by sorting: rows are range-partitioned by a fingerprint of the text and doc_id, so that a
text with any number of copies spreads over tasks, and sorted by fingerprint, whole text and doc_id. A row is a copy if
the row before it has its text and their run began with a smaller doc_id. At the border of two ranges a run may go on: every
task notes the runs of its first and last fingerprint (text as SHA-256, smallest doc_id), and the rows that begin such a run
are decided by the smallest doc_id noted for that text anywhere.

Masks are counted per (part, mask, labels): at most 128 numbers a part, which add up over any split of the rows. Every figure
of every order is a sum over those.

Corners: a null text is empty; empty texts are equal; rows without doc_id are no copies and make none; rows of one doc_id are no
copies of each other, and each row counts; a null or empty lang is the part ``''``; several labels of one document count
once, a null label is no label; an empty table has no parts; bytes that continue no character count as none; other columns
are ignored. A task holds a batch of rows, the texts of one fingerprint and no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, keep, utf8

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_UPPER, _SIGNS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def mask_of(raw: bytes) -> int:
    """Bits of the filters that look at one text: short, repetitive, shouting, signs."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(raw.translate(None, _INNER)), len(raw.translate(None, _SIGNS)) < len(raw))
    return sum(bad << k for k, bad in enumerate(fails))


#: head: a run at a border, with its smallest doc_id. Else a row: its mask, and its run if that is still to be decided.
MASKS = "head boolean, doc_id long, part string, mask int, run binary"


def _masks(batches: Iterator[pa.RecordBatch], mask: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fingerprint, text and doc_id (null last) in, their masks out; then the runs at the borders."""
    names = [f.split()[0] for f in MASKS.split(", ")]
    first = at = text = least = run = None
    bits = 0
    here: dict[bytes, int] = {}  # smallest doc_id of the texts of the fingerprint that is being read
    borders: list[dict[bytes, int]] = []
    for batch in batches:
        ids, bad, runs = batch.column("doc_id").to_pylist(), [], []
        for doc, fp, cell in zip(ids, batch.column("fp").to_pylist(), batch.column("text"), strict=True):
            raw = cell.as_py()
            if fp != at or raw != text:
                if fp != at:
                    if not borders:
                        borders, first = [here], fp  # filled until the next fingerprint begins
                    else:
                        here = {}
                at, text, least, bits = fp, raw, doc, mask(raw)
                run = hashlib.sha256(raw).digest() if fp == first else None
                if doc is not None:
                    here[raw] = doc
            later = doc is not None and doc > least
            bad.append(bits | COPY if later else bits)
            runs.append(run if doc is not None and not later else None)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.repeat(False, n), batch.column("doc_id"), batch.column("part"), pa.array(bad, pa.int32()), pa.array(runs, pa.binary())], names=names)
    heads = [(hashlib.sha256(raw).digest(), doc) for group in ([*borders, here] if borders and here is not borders[0] else borders) for raw, doc in group.items()]
    if heads:
        n = len(heads)
        yield pa.RecordBatch.from_arrays([pa.repeat(True, n), pa.array([d for _, d in heads], pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array([r for r, _ in heads], pa.binary())], names=names)


def masks(docs: DataFrame, mask: Callable[[bytes], int] = mask_of) -> DataFrame:
    """doc_id, part, mask and n: the filters that rows fail, n rows alike. ``mask`` gives the bits of filters on one text."""
    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), utf8("text").alias("text"))
    # the last key only spreads rows that are equal in all others
    own = own.withColumn("fp", F.xxhash64("text")).withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("fp"), F.col("doc_id").asc_nulls_last()]
    dealt = own.repartitionByRange(*order, F.col("spread")).sortWithinPartitions("fp", "text", order[1]).drop("spread")
    found = keep(dealt.mapInArrow(lambda batches: _masks(batches, mask), MASKS), "filter-masks")
    rows = found.filter(~F.col("head"))
    sure = rows.filter("run IS NULL").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # few: the rows that begin a run at a border, and the runs at borders
    open_ = rows.filter("run IS NOT NULL").groupBy("run", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    heads = found.filter("head").groupBy("run").agg(F.min("doc_id").alias("least"))
    told = open_.join(heads, "run", "left").withColumn("mask", F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")))
    return sure.unionByName(told.select(*sure.columns))


def counters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: additive counts."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    is_so = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return masks(docs).join(known, "doc_id", "left").groupBy("part", "mask", is_so("good"), is_so("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = counters(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    orders = parts.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    steps = steps.withColumn("own", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)"))
    steps = steps.withColumn("prior", F.expr(f"aggregate(slice(split(filter_order, ''), 1, step - 1), 0, (x, l) -> x | shiftleft(1, instr('{FILTERS}', l) - 1))"))

    def count(where: str, weight: str = "c.n"):
        return F.expr(f"aggregate(cells, 0L, (x, c) -> x + if({where}, {weight}, 0L))")

    fails, before = "(c.mask & own) <> 0", "(c.mask & prior) <> 0"
    return steps.select(
        "part", "filter_order", "step",
        count(f"NOT {fails} AND NOT {before}").alias("kept"),
        count(f"{fails} AND NOT {before}").alias("removed"),
        count(f"{fails} AND {before}").alias("redundant"),
        count("c.mask = own").alias("unique_fails"),
        count(f"{fails} AND NOT {before} AND c.good").alias("good_lost"),
        count(f"{fails} AND NOT {before} AND c.toxic").alias("toxic_lost"),
        # of k failed filters each comes first in one of k orders
        count(fails, f"c.n * ({len(ORDERS)} div bit_count(c.mask))").alias("shapley"),
    )
