"""Embedding near-duplicates by product quantisation, without a miss.

Unit vectors lie in coarse inverted lists (of one label and dimension: nothing else is compared); what is left beside
the list's centre is coded by subspace codebooks, with the exact error of each code. Cosine >= c between unit vectors is a
distance of at most reach = sqrt(2 - 2c). A query probes every list that a partner could be in: those whose half-space
against the query's own centre begins within reach. There asymmetric table-lookup distances to the codes, less each
code's error, rule out members beyond reach; the rest get the exact cosine in double precision. Both bounds are proofs,
so recall is 1 for any centres and codebooks; these are fitted on a bounded sample (``sample`` vectors of least hash, or four a list if that is more; the lists grow
with the root of a label's vectors).

Equal vectors of one label are one from the start, with a multiplicity that counts in n_links; components need one link for
each two parts that meet in a task, never all pairs. Lists longer than ``CHUNK`` are cut, and so are their queries.

Corners: null, zero, non-finite or empty vectors and null labels link with nothing (n_links 0, component their own
id); rows that repeat a vec_id are vectors of their own; a null vec_id names a component only if all its ids are null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import keep
from .vectors import clean, matrix

#: Members of a list that a task holds; queries that are looked up at once; floating-point slack of the bounds.
CHUNK, BATCH, SLACK = 1024, 128, 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(c))
            count = np.bincount(near, minlength=len(c))
            c[:, d] = np.where(count > 0, total / np.maximum(count, 1), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


class Quantiser:
    """Centres and subspace codebooks of one dimension. Without a sample: one centre at the origin."""

    def __init__(self, x: np.ndarray | None, dim: int, lists: int, parts: int = 8, codes: int = 256):
        if x is None or not len(x):
            x = np.zeros((1, dim))
        self.centres = kmeans(x, lists)
        self.cuts = np.linspace(0, dim, min(parts, dim) + 1).astype(int)
        rest = x - self.centres[nearest(x, self.centres)]
        self.books = [kmeans(rest[:, a:b], min(codes, len(x)), 4) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of unit vectors."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.zeros((len(x), len(self.books)), dtype=np.uint8)
        wrong = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = nearest(part, book)
            wrong += ((part - book[codes[:, m]]) ** 2).sum(1)
        return cell, codes, np.sqrt(wrong)

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector the lists after its own that could hold something within reach."""
        c = self.centres
        far = ((x[:, None, :] - c[None]) ** 2).sum(2) if len(x) * c.size < 1 << 22 else (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        gap = np.sqrt(np.maximum(((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)), 0))
        own = far[np.arange(len(x)), cell]
        near = far - own[:, None] <= 2 * gap[cell] * (reach + SLACK) + SLACK
        return [np.flatnonzero(row & (np.arange(len(c)) > i)) for row, i in zip(near, cell, strict=True)]

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to coded members of one list, by table lookup."""
        rest = x - self.centres[cell]
        total = np.zeros((len(x), len(codes)))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def fit(unique: DataFrame, lists: int | None, sample: int, dims: int = 8) -> dict[int, Quantiser]:
    """A quantiser for each of the most frequent dimensions."""
    n = unique.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).orderBy(F.desc("n"), "dim").limit(dims).collect()
    out = {}
    for r in n:
        k = lists or max(1, round(math.sqrt(r.n / max(1, r.labels))))
        # the lists follow the vectors, and the sample the lists: four vectors a list at least
        few = max(sample, 4 * k)
        # a hashed share of the rows first, so that what tasks send to the driver does not grow with their number
        share = int(min(1.0, 2 * few / r.n) * (1 << 30))
        some = unique.filter((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("name", F.lit(1)), F.lit(1 << 30)) < share))
        rows = some.select("raw", F.xxhash64("name").alias("h")).orderBy("h").limit(few).collect()
        x = matrix([bytes(q.raw) for q in sorted(rows, key=lambda q: q.h)], r.dim)
        out[r.dim] = Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), r.dim, k)
    return out


def _tasks(models: dict[int, Quantiser], reach: float):
    """Unique vectors to their list, with codes (kind 0), and to every later list that they probe (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                part = batch.take(pa.array(at))
                model = models.get(int(d)) or Quantiser(None, int(d), 1)
                x = matrix(part.column("raw").to_pylist(), int(d))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                cell, codes, wrong = model.encode(x)
                for lo in range(0, len(x), 256):
                    s = slice(lo, lo + 256)
                    more = model.probes(x[s], cell[s], reach)
                    who = np.concatenate([np.arange(len(more)), np.repeat(np.arange(len(more)), [len(m) for m in more])]) + lo
                    kind = np.concatenate([np.zeros(len(more), np.int32), np.ones(len(who) - len(more), np.int32)])
                    lists = np.concatenate([cell[s], *more]).astype(np.int32)
                    rows = part.take(pa.array(who))
                    code = pa.array([codes[i].tobytes() if k == 0 else None for i, k in zip(who, kind, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_pydict({c: rows.column(c) for c in ("label", "dim", "name", "raw", "copies")} | {"list": lists, "kind": kind, "codes": code, "error": wrong[who]})

    return run


_TASK = "label string, dim int, name long, raw binary, copies long, list int, kind int, codes binary, error double"


def _compare(models: dict[int, Quantiser], least: float, reach: float):
    """A chunk of a list: its members, then queries. Rows (name, n): linked vectors; rows (a, b): links that join parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        at, held, lot, asked = None, [], None, []

        def rows(name, n, a, b):
            k = len(name)
            return pa.RecordBatch.from_pydict({"name": pa.array([*name, *[None] * len(a)], pa.int64()), "n": pa.array([*n, *[None] * len(a)], pa.int64()), "a": pa.array([*[None] * k, *a], pa.int64()), "b": pa.array([*[None] * k, *b], pa.int64())}, schema=schema)

        def load():
            nonlocal lot
            x = matrix([h[1] for h in held], at[1])
            lot = {
                "name": np.array([h[0] for h in held]),
                "copies": np.array([h[2] for h in held]),
                "x": x,
                "norm": np.linalg.norm(x, axis=1),
                "codes": np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8).reshape(len(held), -1),
                "error": np.array([h[4] for h in held]),
                "part": np.arange(len(held)),
                "model": models.get(at[1]) or Quantiser(None, at[1], 1),
            }
            held.clear()
            for lo in range(0, len(lot["name"]), BATCH):
                yield from ask(lot["name"][lo : lo + BATCH], lot["x"][lo : lo + BATCH], lot["copies"][lo : lo + BATCH], lo)

        def ask(name, x, copies, own=None):
            """Counts and links of queries against the lot; own: they are its members from that number on."""
            norm = np.linalg.norm(x, axis=1)
            near = lot["model"].distances(x / norm[:, None], at[2], lot["codes"]) <= reach + lot["error"] + SLACK
            if own is not None:
                near &= np.arange(len(lot["name"])) < (own + np.arange(len(name)))[:, None]
            q, m = np.nonzero(near)
            if not len(q):
                return
            ok = np.zeros(len(q), dtype=bool)
            for lo in range(0, len(q), 1 << 14):
                s = slice(lo, lo + (1 << 14))
                ok[s] = (x[q[s]] * lot["x"][m[s]]).sum(1) / (norm[q[s]] * lot["norm"][m[s]]) >= least
            q, m = q[ok], m[ok]
            if not len(q):
                return
            mine = np.bincount(q, lot["copies"][m], len(name)).astype(np.int64)
            theirs = np.bincount(m, copies[q], len(lot["name"])).astype(np.int64)
            a, b, part = [], [], lot["part"]
            for k in np.unique(q):
                hit = m[q == k]
                parts, one = np.unique(part[hit], return_index=True)
                if own is not None:
                    one = one[parts != part[own + k]]
                    parts = np.append(parts, part[own + k])
                a += [name[k]] * len(one)
                b += lot["name"][hit[one]].tolist()
                part[np.isin(part, parts)] = parts.min()
            i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
            yield rows([*name[i].tolist(), *lot["name"][j].tolist()], [*mine[i].tolist(), *theirs[j].tolist()], a, b)

        def finish():
            if held:
                yield from load()
            if asked:
                name, raw, copies = zip(*asked, strict=True)
                asked.clear()
                yield from ask(np.array(name), matrix(list(raw), at[1]), np.array(copies))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("label", "dim", "list", "chunk", "kind", "name", "raw", "copies", "codes", "error")]
            for label, dim, cell, chunk, kind, name, raw, copies, codes, error in zip(*cols, strict=True):
                if (label, dim, cell, chunk) != at:
                    yield from finish()
                    at, lot = (label, dim, cell, chunk), None
                if kind == 0:
                    held.append((name, raw, copies, codes, error))
                    continue
                if held:
                    yield from load()
                if lot is not None:
                    asked.append((name, raw, copies))
                    if len(asked) == BATCH:
                        yield from finish()
        yield from finish()

    return run


def near_duplicates(rows: DataFrame, least: float = 0.98, lists: int | None = None, sample: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    reach = math.sqrt(max(0.0, 2 - 2 * least))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("label").to_pylist(), batch.column("raw").to_pylist(), strict=True)
            names = [None if x is None or y is None else int.from_bytes(hashlib.blake2b(x.encode() + b"\0" + y, digest_size=8).digest(), "big", signed=True) for x, y in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=[*batch.schema.names, "name"])

    named = keep(clean(rows, zero=False).mapInArrow(name, "vec_id long, label string, dim int, raw binary, name long"), "pq-rows")
    unique = keep(
        named.filter("name is not null").groupBy("name", "label", "dim", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "pq-unique"
    )
    models = fit(unique, lists, sample)
    tasks = keep(unique.select("label", "dim", "raw", "name", "copies").mapInArrow(_tasks(models, reach), _TASK), "pq-tasks")
    key = ["label", "dim", "list"]
    cut = tasks.filter("kind = 0").groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    dealt = tasks.join(cut, key)
    members = dealt.filter("kind = 0").withColumn("chunk", mine)
    # a member asks the later chunks of its own list; a probe asks all chunks of the list
    later = members.filter("chunk + 1 < chunks").withColumn("chunk", F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))).withColumn("kind", F.lit(1))
    others = dealt.filter("kind = 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = members.unionByName(later).unionByName(others).drop("chunks")
    found = asked.repartition(*key, "chunk").sortWithinPartitions(*key, "chunk", "kind").mapInArrow(_compare(models, least, reach), "name long, n long, a long, b long")
    found = keep(found, "pq-found")
    counts = found.filter("name is not null").groupBy("name").agg(F.sum("n").alias("n"))
    roots = components(found.filter("a is not null").select("a", "b")).withColumnRenamed("node", "name")
    sets = unique.select("name", "copies", "least").join(counts, "name", "left").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    first = sets.groupBy("root").agg(F.min("least").alias("first"))
    facts = sets.join(first, "root").select("name", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first")
    out = named.select("vec_id", "name").join(facts, "name", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
