"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Rows are dealt into shards of bounded size. In a shard every dimension has a posting list for either sign of a query's
weight: how far each row's component lies above the shard's least (or below its greatest), an impact that is never
negative, quantised to ``levels``; postings stand in order of descending quantised impact. A query takes them in
segments: in every dimension the next run of postings whose quantised impact times the query's weight reaches the
segment's bound, bounds descending, each posting added to its row's score. After a segment a row's score is known from below
(what was added) and from above (plus, for each dimension not met, the most that the next posting there can hold, plus
the quantisation's remainder). Rows whose upper bound is under the k-th lower bound can't be in the answer; processing
stops once the rows that still can are few (``open_rows``), or when no posting is left. These rows are rescored
exactly. A shard's answer is exact for its rows, so the k best over shards are the answer.

Corners: vectors that are null or empty or hold null or non-finite components take no part, neither as query nor
as candidate; vectors of another dimension are no candidates; rows with the query's vec_id are its own; ties go to
the smaller vec_id; repeated ids are candidates each, and as queries each has an answer of its own; a null vec_id is
neither; sums must fit a long, and with doubles inside, 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import keep
from .vectors import clean, matrix


class Shard:
    """Posting lists of some rows, by sign and dimension: rows in order of descending level, and where each level ends."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int):
        self.ids, self.x, self.levels = ids, x, levels
        self.low, self.high = x.min(0), x.max(0)
        self.step = np.maximum(1, np.ceil((self.high - self.low + 1) / levels))
        self.rows, self.level, self.upto = [], [], []
        for impact in (x - self.low, self.high - x):
            level = (impact // self.step).astype(np.int32).T
            order = np.argsort(-level, axis=1, kind="stable").astype(np.int32)
            self.rows.append(order)
            self.level.append(np.take_along_axis(level, order, 1))
            # by dimension and level: how many postings are of that level or a greater one; the level beyond all has none
            self.upto.append(np.stack([np.append(np.cumsum(np.bincount(row, minlength=levels)[::-1])[::-1], 0) for row in level]))

    def search(self, query: np.ndarray, own: int, k: int, segments: int, open_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for the query, its own rows left out."""
        n, k = len(self.ids), min(k, len(self.ids))
        side, unit = (query < 0).astype(int), np.abs(query) * self.step  # what a level is worth to the query
        used = np.flatnonzero(unit > 0)
        slack = float((np.abs(query) * (self.step - 1)).sum())
        total, met = np.zeros(n), np.zeros(n)
        total[self.ids == own] = -np.inf
        done = np.zeros(len(query), dtype=np.int64)
        top = max((unit[d] * self.level[side[d]][d, 0] for d in used), default=0.0)
        can = np.flatnonzero(np.isfinite(total))
        for s in range(segments):
            bound = top * (segments - 1 - s) / segments
            least = np.clip(np.ceil(bound / unit[used]), 1, self.levels).astype(int)
            rows, worth = [], []
            for d, lev in zip(used.tolist(), least.tolist(), strict=True):
                end = self.upto[side[d]][d, lev]
                if end > done[d]:
                    rows.append(self.rows[side[d]][d, done[d] : end])
                    worth.append(self.level[side[d]][d, done[d] : end] * unit[d])
                    done[d] = end
            if rows:
                at = np.concatenate(rows)
                total += np.bincount(at, np.concatenate(worth), n)
                met += np.bincount(at, minlength=n)
            next_worth = (least - 1) * unit[used]
            most = total + np.minimum(next_worth.sum(), np.maximum(len(used) - met, 0) * next_worth.max(initial=0)) + slack
            can = np.flatnonzero((most >= np.partition(total, n - k)[n - k]) & np.isfinite(total))
            if len(can) <= open_rows:
                break
        score = self.x[can] @ query
        best = np.lexsort((self.ids[can], -score))[:k]
        return self.ids[can][best], score[best]


def _search(k: int, levels: int, segments: int, open_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        numbers = lambda raw, dim: np.floor(256 * matrix(raw, dim))
        for batch in batches:
            found: dict[str, list] = {"query": [], "query_id": [], "copies": [], "vec_id": [], "score": []}
            cols = (batch.column(c).to_pylist() for c in ("dim", "shard", "kind", "vec_id", "raw", "query", "copies"))
            for dim, part, kind, vec, raw, query, copies in zip(*cols, strict=True):
                if (dim, part) != at:
                    at, held, shard = (dim, part), [], None
                if kind == 0:
                    held.append((vec, raw))
                    continue
                if shard is None:
                    if not held:
                        continue
                    shard, held = Shard(np.array([a for a, _ in held]), numbers([b for _, b in held], dim), levels), []
                ids, scores = shard.search(numbers([raw], dim)[0], vec, k, segments, open_rows)
                for name, x in (("query", query), ("query_id", vec), ("copies", copies)):
                    found[name] += [x] * len(ids)
                found["vec_id"] += ids.tolist()
                found["score"] += scores.astype(np.int64).tolist()
            if found["score"]:
                yield pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in found.items()})

    return run


def top_k(rows: DataFrame, k: int = 5, modulo: int = 50, shard_numbers: int = 1 << 19, levels: int = 64, segments: int = 6, open_rows: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by modulo. A shard holds
    ``shard_numbers`` components at most, or one row. Rows of equal id and vector ask once and are answered each."""
    own = keep(clean(rows, zero=True).filter("raw is not null and vec_id is not null").select("vec_id", "dim", "raw"), "top-rows")
    cut = keep(own.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") / shard_numbers).cast("int").alias("shards")), "top-dims")
    dealt = own.join(cut, "dim")
    # rows of equal id and vector are dealt apart by their place in the kept table; any deal gives the same answer
    apart = F.pmod(F.xxhash64("vec_id", "raw", F.monotonically_increasing_id()), F.col("shards")).cast("int")
    members = dealt.withColumn("shard", apart)
    members = members.withColumn("kind", F.lit(0)).withColumn("query", F.lit(None).cast("long")).withColumn("copies", F.lit(None).cast("long"))
    asked = dealt.filter(F.col("vec_id") % modulo == 0).groupBy("vec_id", "dim", "raw", "shards").agg(F.count(F.lit(1)).alias("copies"))
    queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("kind", F.lit(1)).withColumn("query", F.xxhash64("vec_id", "raw"))
    both = members.unionByName(queries).drop("shards").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")
    found = both.mapInArrow(_search(k, levels, segments, open_rows), "query long, query_id long, copies long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    first = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return first.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")
