"""Containment by blocks: which bodies lie around a place, without pairing the rows of a file.

The places of a file are cut into blocks, so that a hot file spreads over tasks. A question goes to the block of its low end;
a body goes to every block that it touches. Blocks are four times as wide as an average body, so bodies are copied
1.25 times on average beyond the first, whatever their lengths. A question meets the bodies of its block by a join on
file and block, in compiled code. Questions that are asked more than once are looked up once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Lengths below this fit one number with a place inside them.
_PACKED = 1 << 31


def _place(name: str):
    return F.col(name).cast("long")


def _met(questions: DataFrame, bodies: DataFrame, keys: Sequence[str], low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """Each question, with its columns and _block, and each body around it, with all but its keys."""
    block = lambda c: F.floor(c / width)
    own = bodies.filter(F.col("open").isNotNull() & (_place("open") <= _place("close")))
    own = own.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in bodies.columns if c not in keys], F.explode(F.sequence(block(_place("open")), block(_place("close")))).alias("_body_block"))
    asked = questions.withColumn("_block", block(_place(low)))
    from_, to, open_, close = (_place(c) for c in (low, high, "open", "close"))
    # a range lies strictly inside; the lines beside an insertion may be the edges
    inside = ((from_ <= to) & (open_ < from_) & (to < close)) | ((from_ > to) & (open_ <= to) & (from_ <= close))
    same = inside & (F.col("_block") == F.col("_body_block"))
    for i, c in enumerate(keys):
        same &= F.col(c) == F.col(f"_k{i}")
    return asked.join(own, same, how).drop("_body_block", *[f"_k{i}" for i in range(len(keys))])


def _measured(bodies: DataFrame) -> tuple[int, int]:
    """The width of blocks, four times an average body's, and the greatest length: one pass, one row."""
    length = _place("close") - _place("open")
    mean, most = bodies.agg(F.avg(length + 1), F.max(length)).first()
    return max(1, math.ceil(4 * (mean or 1.0))), most or 0


def meeting(questions: DataFrame, bodies: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """keys, the other columns of both: every question (low to high) with every body (open, close) around it, as in around(); equal
    questions and equal bodies each count."""
    return _met(questions, bodies, keys, low, high, _measured(bodies)[0]).drop("_block")


def nearest(questions: DataFrame, bodies: DataFrame, keys: Sequence[str], low: str, high: str, how: str = "inner") -> DataFrame:
    """The distinct questions, all their columns, each with the columns of the narrowest body around it, as in around(); ``how`` left keeps
    those without one."""
    width, most = _measured(bodies)
    rest = [c for c in bodies.columns if c not in keys]
    asked = questions.withColumn("_block", F.floor(_place(low) / width)).repartition(*keys, "_block").distinct()
    met = _met(asked, bodies, keys, low, high, width, how)
    # a question is in one block: the block is named so that its rows stay where the join has them
    group = met.groupBy(*questions.columns, "_block")
    length, back = _place("close") - _place("open"), _place(low) - _place("open")
    if set(rest) == {"open", "close"} and most < _PACKED - 1:
        # a body of places alone is told by one number: its length, then how far back it opens
        found = group.agg(F.min(length * _PACKED + back).alias("_b"))
        open_ = _place(low) - F.col("_b") % _PACKED
        ends = {"open": open_, "close": open_ + F.floor(F.col("_b") / _PACKED)}
        return found.select(*questions.columns, *[ends[c].cast(bodies.schema[c].dataType).alias(c) for c in rest])
    found = group.agg(F.min(F.when(F.col("open").isNotNull(), F.struct(length.alias("_n"), back.alias("_o"), *rest))).alias("_b"))
    return found.select(*questions.columns, *[F.col(f"_b.{c}").alias(c) for c in rest])


def around(questions: DataFrame, bodies: DataFrame, keys: Sequence[str], low: str, high: str, every: bool = False) -> DataFrame:
    """keys, low, high and the other columns of ``bodies`` (keys, open, close, ...) for each distinct question: the narrowest body
    strictly around [low, high], the latest opened of equals, or with ``every`` all of them. An insertion, between the lines high and
    low = high + 1, lies in a body whose edges are on or outside those lines. A null key is around nothing."""
    asked = questions.select(*keys, _place(low).alias(low), _place(high).alias(high))
    rest = [c for c in bodies.columns if c not in keys]
    found = meeting(asked.distinct(), bodies, keys, low, high) if every else nearest(asked, bodies, keys, low, high)
    return found.select(*keys, low, high, *rest)
