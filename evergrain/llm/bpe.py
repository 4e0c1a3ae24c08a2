"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A text longer than one chunk is cut into chunks that overlap; chunks are rows, dealt out to tasks. Each is pre-tokenised
by itself, as if the text began at its first character, and tells the boundaries that it found in its two overlaps.
Neighbours are stitched at the first boundary that both found: from a common boundary on both see the same text, so all
that follows agrees. A match that ends at the end of its chunk, or as near to it as the pattern looks ahead, counts as
open. Each chunk then encodes the pieces between its two stitches, and the ids of a text come together in order. Where an
overlap holds no common boundary (one run of letters longer than it), the chunks of that text go to one task, which scans
on from the last certain boundary until it meets one of the next chunk's. Pieces are merged by rank, each distinct
short piece once per task while a bounded memo holds it. Decoding joins the raw bytes of the ids.

Corners: a null text is empty; empty text has no ids and the digests of zero bytes; malformed UTF-8 is read as U+FFFD, as
Python's errors=replace does, and decodes to that; repeated rows and a null doc_id are kept as they are; other columns
are ignored; a text is never cut off.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded, keep, trim, utf8

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters of a chunk, of what it shares with the next; pieces that a task remembers, and the longest of them;
#: characters that the pattern looks ahead.
CHUNK, OVERLAP, MEMO, LONGEST, LOOK = 1 << 15, 1 << 10, 100_000, 48, 3


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def boundaries(pattern, text: str, start: int, stop: int) -> list[int]:
    """start, and the ends of the closed matches of text[start:stop]. Unless the text ends at stop, a match that ends
    within LOOK characters of it is open: what follows could change it."""
    limit = stop - start if stop == len(text) else stop - start - LOOK
    out = [start]
    for m in pattern.finditer(text[start:stop]):
        if m.end() > limit:
            break
        out.append(start + m.end())
    return out


def pieces(pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[str]]:
    """Pre-tokens of text, chunk by chunk, the same as one scan over all of it."""
    n = len(text)
    if n <= chunk:
        yield pattern.findall(text)
        return
    sure = 0  # a boundary of the one scan; all before it is out
    for start in range(0, n, chunk):
        own = boundaries(pattern, text, start, min(n, start + chunk + overlap))
        known, out, reach = set(own), [], overlap
        while sure < own[-1] and sure not in known:  # not in step yet: go on from the last certain boundary
            more = boundaries(pattern, text, sure, min(n, sure + reach))
            reach *= 1 + (len(more) == 1)
            for a, b in zip(more, more[1:], strict=False):
                out.append(text[a:b])
                sure = b
                if b in known:
                    break
        if sure < own[-1]:
            own = own[own.index(sure) :]
            out += [text[a:b] for a, b in zip(own, own[1:], strict=False)]
            sure = own[-1]
        yield out
    while sure < n:
        more = boundaries(pattern, text, sure, n)
        yield [text[a:b] for a, b in zip(more, more[1:], strict=False)]
        sure = n


class Codec:
    """Encoder and decoder of one vocabulary; encode gives ids as the tiktoken library's encode_ordinary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        table = ranks(path)
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe
        self.raw = {v: k for k, v in table.items()}
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: str) -> list[int]:
        ids = self.core.encode_single_piece(piece.encode())
        if len(piece) > LONGEST:
            return ids
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[piece] = ids
        return ids

    def pieces(self, part: list[str]) -> list[int]:
        ids: list[int] = []
        memo = self.memo
        for piece in part:
            ids += memo.get(piece) or self.merged(piece)
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        return np.array([x for part in pieces(self.pattern, text, chunk, overlap) for x in self.pieces(part)], dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


_IDS = "row long, doc_id long, k int, ids binary"


def _chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Rows (row, doc_id, text as bytes) to rows of chunks: number, whether it is the last, its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, raw in zip(batch.column("row").to_pylist(), batch.column("doc_id"), batch.column("text"), strict=True):
                text = raw.as_py().decode("utf-8", "replace")
                for k, start in enumerate(range(0, len(text), chunk)):
                    last = start + chunk >= len(text)
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": pa.array([doc.as_py()], pa.int64()), "k": pa.array([k], pa.int32()), "last": [last], "text": [text[start : start + chunk + overlap]]})

    return rows.mapInArrow(run, "row long, doc_id long, k int, last boolean, text string")


def _bounds(pattern, text: str, last: bool) -> list[int]:
    """Boundaries of a chunk, from its first character on; the last chunk has no open match."""
    return boundaries(pattern, text if last else text + "\0", 0, len(text))


def _long(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """ids by chunk (_IDS) of rows (row, doc_id, text) that are longer than a chunk."""
    import regex

    parts = keep(_chunks(rows, chunk, overlap).repartition("row", "k"), "bpe-chunks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = regex.compile(pattern)
        for batch in batches:
            left, right = [], []
            for text, last in zip(batch.column("text"), batch.column("last").to_pylist(), strict=True):
                at = _bounds(own, text.as_py(), last)
                left.append([x for x in at if x <= overlap])
                right.append([x - chunk for x in at if x >= chunk])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "k": batch.column("k"), "last": batch.column("last"), "left": pa.array(left, ints), "right": pa.array(right, ints)})

    order = Window.partitionBy("row").orderBy("k")
    edges = parts.select("row", "k", "last", "text").mapInArrow(find, "row long, k int, last boolean, left array<int>, right array<int>")
    common = F.array_min(F.array_intersect("right", F.lead("left").over(order)))
    met = edges.select("row", "k", "last", common.alias("stop")).withColumn("start", F.lag("stop").over(order))
    torn = F.max(F.col("stop").isNull() & ~F.col("last")).over(Window.partitionBy("row"))
    met = keep(met.withColumn("torn", torn).select(F.col("row").alias("m_row"), F.col("k").alias("m_k"), "start", "stop", "torn"), "bpe-stitches")
    dealt = parts.join(met, (F.col("row") == F.col("m_row")) & (F.col("k") == F.col("m_k")))

    def encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            ids = []
            for text, last, start, stop in zip(*(batch.column(c).to_pylist() for c in ("text", "last", "start", "stop")), strict=True):
                at = [x for x in _bounds(codec.pattern, text, last) if x >= (start or 0) and (last or x <= chunk + stop)]
                ids.append(np.array(codec.pieces([text[a:b] for a, b in zip(at, at[1:], strict=False)]), dtype="<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "k": batch.column("k"), "ids": pa.array(ids, pa.binary())})
        codec.memo.clear()
        trim()

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held = Codec(path, pattern), []
        for batch in batches:
            for row, doc, last, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "last", "text")), strict=True):
                held.append(text if last else text[:chunk])
                if last:
                    yield pa.RecordBatch.from_pydict({"row": [row], "doc_id": pa.array([doc], pa.int64()), "k": pa.array([0], pa.int32()), "ids": [codec.encode("".join(held), chunk, overlap).tobytes()]})
                    held.clear()
        trim()

    whole = dealt.filter("torn").select("row", "doc_id", "k", "last", "text").repartition("row").sortWithinPartitions("row", "k")
    return dealt.filter("not torn").select("row", "doc_id", "k", "last", "text", "start", "stop").mapInArrow(encode_chunk, _IDS).unionByName(whole.mapInArrow(encode_whole, _IDS))


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (array<int>, if asked for), n_tokens and both digests, one row per document; only long texts move."""
    if not 0 < overlap < chunk:
        raise ValueError("an overlap is shorter than its chunk")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)][: len(names)], names=names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            found = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.array(codec.pieces(codec.pattern.findall(raw.as_py().decode("utf-8", "replace"))), dtype="<u4")
                found.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), ids.astype("<i4") if with_ids else None))
            if found:
                yield rows(found)
        codec.memo.clear()
        trim()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of a text arrive in order, chunk by chunk."""
        codec, at, n, first, second, kept = Codec(path, pattern), None, 0, hashlib.sha256(), hashlib.sha256(), []

        def text() -> pa.RecordBatch:
            return rows([(at[1], n, first.hexdigest(), second.hexdigest(), np.concatenate(kept).astype("<i4") if kept else None)])

        for batch in batches:
            for row, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
                if at is not None and at[0] != row:
                    yield text()
                    n, first, second, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                at, ids = (row, doc), np.frombuffer(raw, dtype="<u4")
                n += len(ids)
                first.update(raw)
                second.update(codec.decode(ids))
                if with_ids:
                    kept.append(ids)
        if at is not None:
            yield text()

    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    out = own.filter(F.octet_length("text") <= chunk).mapInArrow(short, schema)
    beyond = own.filter(F.octet_length("text") > chunk)
    if beyond.isEmpty():
        return out
    ids = _long(beyond.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), path, pattern, chunk, overlap)
    return out.unionByName(ids.repartition("row").sortWithinPartitions("row", "k").mapInArrow(joined, schema))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw (binary): the bytes that the ids of encode() stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            raw = [codec.decode(np.array(x.as_py() or [], dtype="<u4")) for x in batch.column("ids")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "raw": pa.array(raw, pa.binary())})

    return bounded(rows).select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")
