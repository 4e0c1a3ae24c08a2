"""N-gram Jaccard join by a token-group matrix: groups of similar documents, the union of each group's tokens, a bound on
the overlap of a query with a group, and only groups that reach it are opened.

Tokens are word shingles of a whole text, as 64-bit hashes over BLAKE2b hashes of the words: two shingles meet by chance
alone, with 2^-64 a pair (a set of 20,000 is off by one with 1e-11). Documents with the same token set are one from the
start, by 64 bits of BLAKE2b of the set (n different sets hold n^2 / 2^65 pairs that meet: 3e-4 at 1e8, 3 at 1e10).
One exchange brings the occurrences of each token together, as compressed blocks by token range; a token
found in one set only can be in no overlap and is dropped, so a document in which too few tokens are left for the
threshold is out, exactly. Of those that remain, tokens stand rarest first and a document's prefix is what it must
share a token of with any partner. Documents are put into groups by their least hashed token (large groups are cut by
a hash); the matrix (prefix token, group) gives the pairs of groups that share prefix tokens, and each member the groups
that hold one of its own prefix, of a size that allows a partner. Before a group is opened the query's tokens are counted in the union of its tokens: the overlap with any
member can be no more. Opened groups are compared exactly, in integers. Inside a group, and for each query, only
links that join two parts are passed on, so copies never become all their pairs; components are the least doc_id.

Ranges of tokens and buckets of sets follow the size of the input. A block is dealt into at most 2^FAN of them at a time;
where there are more, a further exchange deals each range out again, so rows per block stay bounded and the number of
rows is that of blocks times the exchanges (one up to 64 partitions, two up to 16,384, three beyond).

Corners: null or empty texts and texts of white space alone have no set and link with nothing (component: their own
doc_id); fewer words than ``width`` are one token; repeated rows are copies; a null doc_id never names a component that
has others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded, keep, scan_parts, trim, utf8
from .shingles import Hasher

#: Tokens that a task holds before it passes them on; members of a group; queries that one task asks of a group; bits of
#: a key that one exchange deals out.
BLOCK, GROUP, QUERIES, FAN = 1_000_000, 256, 512, 8


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers, ascending or small, as byte planes of their steps, compressed."""
    a = a.astype(np.uint64)
    step = np.diff(a, prepend=np.uint64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T.copy()
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    with np.errstate(over="ignore"):
        return np.cumsum(planes.reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def needed(n, percent: int):
    """The least overlap that a document of n tokens needs with any partner."""
    return -(-percent * n // 100)


_POSTED = "key int, n int, m int, tokens binary, local binary, names binary, sizes binary"
_SHARED = "doc_id long, name long, size long, bucket int, n int, tokens binary, counts binary, names binary, sizes binary"
_BINARY = [("tokens", pa.binary()), ("local", pa.binary()), ("names", pa.binary()), ("sizes", pa.binary())]
_POSTING = pa.schema([("key", pa.int32()), ("n", pa.int32()), ("m", pa.int32()), *_BINARY])
_BUCKET = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *((x, pa.binary()) for x in ("tokens", "counts", "names", "sizes"))])


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(raw: bytes, n: int, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


def _cuts(key: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Runs of ascending 64-bit keys that agree in their first ``bits``: those bits, from, to. There are no empty runs."""
    top = (key >> np.uint64(64 - bits)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)] if len(top) else []
    for lo, hi in zip(at, at[1:], strict=False):
        yield int(top[lo]), lo, hi


def _deal(tok: np.ndarray, own: np.ndarray, name: np.ndarray, size: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Tokens and the numbers of their sets (name, size), by range of tokens."""
    order = np.argsort(tok, kind="stable")
    tok, own = tok[order], own[order]
    for r, a, b in _cuts(tok, bits):
        seen, local = np.unique(own[a:b], return_inverse=True)
        planes = local.astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        row = {"key": [r], "n": [b - a], "m": [len(seen)], "tokens": [pack(tok[a:b])], "local": [_zip(planes)], "names": [name[seen].tobytes()], "sizes": [size[seen].astype(np.uint32).tobytes()]}
        yield pa.RecordBatch.from_pydict(row, schema=_POSTING)


def _dealt(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a row with the names and sizes of their sets."""
    n = row["n"]
    local = _unzip(row["local"], 4 * n, np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
    return unpack(row["tokens"], n), np.frombuffer(row["names"], dtype=np.uint64)[local], np.frombuffer(row["sizes"], dtype=np.uint32)[local]


def _spread(names: bytes, bits: int) -> int:
    """The range that a row of documents goes to: any will do, the same at each exchange up to its first bits."""
    return int.from_bytes(hashlib.blake2b(names, digest_size=4).digest()) >> (32 - bits)


def _postings(width: int, bits: int):
    """Rows (doc_id, text) to rows by token range (key, n, tokens, documents) and, apart, the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        tokens, owners, sets, docs, size = [], [], {}, [], 0

        def flush():
            name = np.array(list(sets), dtype=np.uint64)
            count = np.array([n for _, n in sets.values()], dtype=np.uint64)
            yield from _deal(np.concatenate(tokens), np.concatenate(owners), name, count, bits)

        def known():
            ids, names, counts = zip(*docs, strict=True)
            ids = pa.array(ids, pa.int64())
            raw = np.array(names, dtype=np.uint64).tobytes()
            raw = ids.fill_null(0).to_numpy().tobytes() + raw
            row = {"key": [_spread(raw, bits)], "n": [-len(ids)], "m": [0], "tokens": [b""], "local": [ids.is_null().to_numpy(zero_copy_only=False).tobytes()], "names": [raw], "sizes": [np.array(counts, dtype=np.uint32).tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=_POSTING)

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, hasher.texts([x.as_py() for x in batch.column("text")], width), strict=True):
                if len(found):
                    name = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest())
                    if name not in sets:
                        owners.append(np.full(len(found), len(sets), dtype=np.uint32))
                        sets[name] = (len(sets), len(found))
                        tokens.append(found)
                        size += len(found)
                    docs.append((doc, name, len(found)))
                else:
                    docs.append((doc, 0, 0))
                if size >= BLOCK:
                    yield from flush()
                    yield known()
                    tokens, owners, sets, docs, size = [], [], {}, [], 0
        if tokens:
            yield from flush()
        if docs:
            yield known()
        tokens, owners, sets, docs = [], [], {}, []
        hasher.memo.clear()
        trim()

    return run


def _finer(bits: int):
    """Rows of _postings, by range, dealt out again by more bits of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "key"):
            tokens, names, sizes, size = [], [], [], 0

            def flush():
                name, first, own = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
                yield from _deal(np.concatenate(tokens), own, name, np.concatenate(sizes)[first], bits)

            for row in (row for batch in held for row in batch.to_pylist()):
                if row["n"] < 0:
                    yield pa.RecordBatch.from_pylist([row | {"key": _spread(row["names"], bits)}], schema=_POSTING)
                    continue
                for kept, x in zip((tokens, names, sizes), _dealt(row), strict=True):
                    kept.append(x)
                size += row["n"]
                if size >= BLOCK:
                    yield from flush()
                    tokens, names, sizes, size = [], [], [], 0
            if tokens:
                yield from flush()
            trim()

    return run


def _bucketed(tok: np.ndarray, count: np.ndarray, name: np.ndarray, size: np.ndarray, bits: int) -> Iterator[dict]:
    """Tokens of sets, with the number of sets that hold them, by bucket: the first bits of the set's name."""
    order = np.lexsort((tok, name))
    tok, count, name, size = tok[order], count[order], name[order], size[order]
    for b, lo, hi in _cuts(name, bits):
        s = slice(lo, hi)
        yield {"bucket": [b], "n": [hi - lo], "tokens": [_zip(tok[s])], "counts": [pack(count[s])], "names": [pack(name[s])], "sizes": [pack(size[s])]}


def _unbucketed(row: dict) -> tuple[np.ndarray, ...]:
    return _unzip(row["tokens"], row["n"]), *(unpack(row[k], row["n"]) for k in ("counts", "names", "sizes"))


def _finer_buckets(bits: int):
    """Rows by bucket, dealt out again by more bits of their sets' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "bucket"):
            cols: list[tuple] = []
            size = 0
            for row in (row for batch in held for row in batch.to_pylist()):
                cols.append(_unbucketed(row))
                size += row["n"]
                if size >= BLOCK:
                    for out in _bucketed(*map(np.concatenate, zip(*cols, strict=True)), bits):
                        yield pa.RecordBatch.from_pydict(out, schema=_BUCKET)
                    cols, size = [], 0
            if cols:
                for out in _bucketed(*map(np.concatenate, zip(*cols, strict=True)), bits):
                    yield pa.RecordBatch.from_pydict(out, schema=_BUCKET)
            trim()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal keys of rows that arrive sorted by key, as lists of slices."""
    at, held = None, []
    for batch in batches:
        key = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and key[lo] != at:
                yield at, held
                held = []
            at = key[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, held


def _share(bits: int):
    """By token range: tokens of at least two sets, each with the number of its sets, dealt by set into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("size", pa.int64()), *_BUCKET])

        def out(rows, **cols):
            return pa.RecordBatch.from_pydict({f.name: cols.get(f.name, pa.nulls(rows, f.type)) for f in schema}, schema=schema)

        for _, held in _grouped(batches, "key"):
            toks, names, sizes = [], [], []
            for row in (row for batch in held for row in batch.to_pylist()):
                if row["n"] < 0:
                    n = -row["n"]
                    both = np.frombuffer(row["names"], dtype=np.int64)
                    null = np.frombuffer(row["local"], dtype=bool)
                    yield out(n, doc_id=pa.array(both[:n], pa.int64(), mask=null), name=both[n:], size=np.frombuffer(row["sizes"], dtype=np.uint32).astype(np.int64))
                    continue
                for kept, x in zip((toks, names, sizes), _dealt(row), strict=True):
                    kept.append(x)
            if not toks:
                continue
            tok, name, size = np.concatenate(toks), np.concatenate(names), np.concatenate(sizes)
            del toks, names, sizes
            order = np.argsort(tok, kind="stable")
            tok = tok[order]
            same = tok[1:] == tok[:-1]
            twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            order, tok = order[twice], tok[twice]
            name, size = name[order], size[order]
            order = np.lexsort((name, tok))
            tok, name, size = tok[order], name[order], size[order]
            if not len(tok):
                continue
            first = np.concatenate([[True], (tok[1:] != tok[:-1]) | (name[1:] != name[:-1])])
            tok, name, size = tok[first], name[first], size[first]
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            count = np.diff(np.append(start, len(tok)))
            count = np.repeat(count, count)
            tok, name, size, count = (x[count > 1] for x in (tok, name, size, count))
            for row in _bucketed(tok, count, name, size, bits):
                yield out(1, **row)
            del tok, name, size, count, order
            trim()

    return run


def _eligible(percent: int):
    """By bucket: sets that keep enough shared tokens, tokens rarest first, and how many of them are the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "bucket"):
            cols = [_unbucketed(row) for batch in held for row in batch.to_pylist()]
            tok, count, name, size = map(np.concatenate, zip(*cols, strict=True))
            del cols
            order = np.lexsort((tok, count, name))
            tok, name, size = tok[order], name[order], size[order]
            start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            stop = np.append(start[1:], len(name))
            n = size[start].astype(np.int64)
            prefix = stop - start - needed(n, percent) + 1
            for k in np.flatnonzero(prefix > 0).tolist():
                own = tok[start[k] : stop[k]]
                yield pa.RecordBatch.from_pydict({"name": name[start[k] : start[k] + 1].view(np.int64), "size": [n[k]], "prefix": pa.array([prefix[k]], pa.int32()), "tokens": pa.array([own.view(np.int64)], pa.list_(pa.int64()))})

    return run


class Group:
    """Members of a group: the union of their tokens, who holds each, and the parts that links have joined."""

    def __init__(self, names: list[int], sizes: list[int], tokens: list[np.ndarray], percent: int):
        self.names, self.sizes, self.percent = names, np.array(sizes), percent
        flat, who = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        order = np.argsort(flat, kind="stable")
        flat, self.who = flat[order], who[order]
        self.union = np.unique(flat)
        self.left, self.right = np.searchsorted(flat, self.union, "left"), np.searchsorted(flat, self.union, "right")
        self.part = np.arange(len(names))

    def hits(self, size: int, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the members that the query is linked with."""
        at = np.searchsorted(self.union, tokens)
        at = at[self.union[np.minimum(at, len(self.union) - 1)] == tokens]
        if len(at) < needed(size, self.percent):
            return at[:0]  # the union itself holds too little of the query: the group stays closed
        a, b = self.left[at], self.right[at]
        reach = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        both = np.bincount(self.who[reach], minlength=len(self.names))
        return np.flatnonzero(100 * both >= self.percent * (size + self.sizes - both))

    def join(self, name: int, hit: np.ndarray, own: int | None = None) -> list[tuple[int, int]]:
        """One link to each part that the query is linked with; those parts are one from now on."""
        if not len(hit):
            return []
        parts, one = np.unique(self.part[hit], return_index=True)
        if own is not None:
            one = one[parts != self.part[own]]
            parts = np.append(parts, self.part[own])
        out = [(name, self.names[x]) for x in hit[one]]
        self.part[np.isin(self.part, parts)] = parts.min()
        return out


def _open(percent: int):
    """By group: members first, then queries, which stream. Links that join two parts, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, group, found = None, [], None, []

        def close():
            """All members are there: they are queries of their own group, too."""
            nonlocal group
            group = Group(*(list(x) for x in zip(*held, strict=True)), percent)
            for k, (name, size, tokens) in enumerate(held):
                found.extend(group.join(name, (h := group.hits(size, tokens))[h < k], k))
            held.clear()

        def pairs():
            a, b = zip(*found, strict=True)
            found.clear()
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "slice", "kind", "name", "size")), strict=True)
            for (g, s, kind, name, size), tokens in zip(keys, batch.column("tokens"), strict=True):
                if (g, s) != at:
                    if held:
                        close()
                    at, group = (g, s), None
                tokens = tokens.values.to_numpy()
                if kind == 0:
                    held.append((name, size, tokens.copy()))
                    continue
                if group is None:
                    close()
                found.extend(group.join(name, group.hits(size, tokens)))
            if found:
                yield pairs()
        if held:
            close()
        if found:
            yield pairs()

    return run


def links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): enough links between sets (name, size, prefix, tokens) to join all that are linked."""
    least = F.transform("tokens", lambda x: F.xxhash64(x))
    keyed = sets.withColumn("near", F.array_min(least))
    sizes = keyed.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("cuts"))
    placed = keep(
        keyed.join(sizes, "near").withColumn("group", F.xxhash64("near", F.pmod(F.xxhash64("name"), F.col("cuts")))).select("name", "size", "prefix", "tokens", "group"),
        "jac-placed",
    )
    prefix = F.slice("tokens", F.lit(1), F.col("prefix"))
    matrix = placed.select("size", "group", F.explode(prefix).alias("token")).groupBy("token", "group").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    # groups meet first, once for each token that they share; then each member asks only the groups that hold one of its own
    theirs = matrix.select("token", F.col("group").alias("other"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    fits = (F.col("o_low") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("o_high") * 100)
    pairs = matrix.join(theirs, "token").filter((F.col("group") < F.col("other")) & fits)
    pairs = pairs.groupBy("group", "other").agg(F.collect_set("token").alias("shared"), F.min("o_low").alias("o_low"), F.max("o_high").alias("o_high"))
    asks = placed.select("name", "size", F.col("group").alias("own"), prefix.alias("mine"))
    near = asks.join(
        pairs,
        (F.col("own") == F.col("group")) & (F.col("o_low") * percent <= F.col("size") * 100) & (F.col("size") * percent <= F.col("o_high") * 100) & F.arrays_overlap("mine", "shared"),
    ).select("name", "other")
    near = keep(near, "jac-near")
    # a group that many queries ask for is opened in several tasks, each with its slice of the queries
    asked = near.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("slices"))
    mine = F.pmod(F.xxhash64("name"), F.col("slices")).cast("int")
    queries = placed.select("name", "size", "tokens").join(near.join(asked, "other").select("name", F.col("other").alias("group"), mine.alias("slice")), "name").select("group", "slice", F.lit(1).alias("kind"), "name", "size", "tokens")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    members = placed.join(asked.withColumnRenamed("other", "group"), "group", "left").select("group", copies.alias("slice"), F.lit(0).alias("kind"), "name", "size", "tokens")
    return members.unionByName(queries).repartition("group", "slice").sortWithinPartitions("group", "slice", "kind", "name").mapInArrow(_open(percent), "a long, b long")


def _dealt_out(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    bits = max(2, (scan_parts(docs) - 1).bit_length() + 2)
    steps = [*range(FAN, bits, FAN), bits]
    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    posted = own.mapInArrow(_postings(width, steps[0]), _POSTED)
    for step in steps[1:]:
        posted = _dealt_out(posted, "key").mapInArrow(_finer(step), _POSTED)
    shared = keep(_dealt_out(posted, "key").mapInArrow(_share(steps[0]), _SHARED), "jac-shared")
    buckets = shared.filter("bucket is not null").select(*_BUCKET.names)
    for step in steps[1:]:
        buckets = _dealt_out(buckets, "bucket").mapInArrow(_finer_buckets(step), "bucket int, n int, tokens binary, counts binary, names binary, sizes binary")
    sets = keep(_dealt_out(buckets, "bucket").mapInArrow(_eligible(percent), "name long, size long, prefix int, tokens array<long>"), "jac-sets")
    roots = components(links(sets, percent))
    rows = shared.filter("bucket is null").select("doc_id", "name", "size")
    named = rows.filter("size > 0").groupBy("name").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "name"), "name", "left")
    named = named.withColumn("root", F.coalesce("root", "name"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_name = named.join(least, "root").select(F.col("name").alias("n_name"), "component_id")
    return rows.join(by_name, (F.col("size") > 0) & (F.col("name") == F.col("n_name")), "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
