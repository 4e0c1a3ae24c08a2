"""LM scoring: the probability of a text over all its segmentations into the pieces of an existing vocabulary.

Pieces and their scores come from a public vocabulary file; its scores are ranks, so they are read as a Zipf law. Pieces
that begin with the word mark begin a word, and no piece crosses one, so the lattice of a text is the chain of its words'
lattices and log-space forward recursion gives the marginal over all segmentations, word by word: every distinct word is
spelled out in every component. ``spelled_score`` is that marginal under the vocabulary's scores alone.

``score`` learns from the training texts, and two things differ in its lattice. The piece scores are fitted: ``passes`` passes of
expected counts (forward and backward sums over the lattice of every distinct training word), with the file's scores
as prior. And each known word has an arc over all of it: its count less an absolute discount, in its component and, of
what the discount saves, in all components; the rest of it weighs the pieces' arcs. So the score is one forward sum over the
lattice of pieces and known words. Scores are learned by component (training rows of one lang; at most ``max_parts``,
the rest share one), and a text's probability is the mixture: log10 sum_k share_k prod_w P_k(w). No level gives more
than one over all words, so it is a proper probability of the text's words, spelling included; the base score is not
(it gives every unknown word the mass of all). lang is read in training only.

Plan: a task packs its texts into blocks of bounded size. Each block gives its distinct words with counts, and its texts
compressed. Words are dealt by hash into ranges, as many as the scan has partitions, and move as sorted, compressed lists,
one a block and range (so no more rows than a block has words): they sum to the word table (never on the driver), whose weights
go back to the blocks the same way, so a frequent word costs one entry a block, not one a document. A block then scores
its texts against its own words. Only the piece table (bounded by the vocabulary file) is broadcast.

Corners: a null text is empty: one token, the end; empty table: no rows; no training rows: N = V = 0 and pieces have
the file's scores; a null doc_id is in training; a null or missing lang is a component of its own; ties of components by
name; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, held_out, keep, scan_parts, trim, utf8, words

#: Taken off every known word's count; what of it goes to the counts over all components.
DISCOUNT, ACROSS = 0.75, 0.1
END = b""
RESULT = {"doc_id": "long", "held_out": "boolean", "n_tokens": "long", "n_known": "long", "train_tokens": "long", "base_score": "double", "score": "double", "spelled_score": "double"}
#: Bytes of text in a block; the range that stands for a block's texts.
BLOCK, LAST = 14 << 20, 1 << 30


def vocabulary(path: str) -> dict[bytes, float]:
    """Pieces as bytes with first probabilities; the word mark is a space, single bytes are always in."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        raw = m.id_to_piece(i).replace("▁", " ").encode()
        if raw.lower() == raw and b" " not in raw[1:]:
            out.setdefault(raw, 1 / (20 - m.get_score(i)))
    least = min(out.values(), default=1.0)
    for b in range(256):
        out.setdefault(bytes([b]), least / 4)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


class Lattice:
    """Sums over the segmentations of words. Words come in sorted order at best: what a word shares with the one before
    it, a prefix, is not computed again, neither forward nor (expected counts are linear) backward."""

    def __init__(self, p: dict[bytes, float]):
        self.pieces = [k for k, v in p.items() if v > 0]
        self.uses = [0.0] * len(self.pieces)
        self.ends: dict = {}  # pieces by their bytes from the last to the first; under None the number and log
        for n, k in enumerate(self.pieces):
            node = self.ends
            for byte in reversed(k):
                node = node.setdefault(byte, {})
            node[None] = (n, math.log(p[k]))
        self.word = b""
        self.a = [0.0]  # log mass of all segmentations up to each byte
        self.b = [0.0]  # weight of the words that have a boundary there
        self.arcs: list[list[tuple[int, int, float]]] = [[]]

    def _back(self, to: int) -> None:
        """Drop what lies behind a prefix of ``to`` bytes; its boundaries' weights go to the pieces that end there."""
        a, b, uses, exp = self.a, self.b, self.uses, math.exp
        for j in range(len(a) - 1, to, -1):
            w = b.pop()
            if w:
                at = a[j]
                for i, n, x in self.arcs[j]:
                    use = exp(x - at) * w
                    uses[n] += use
                    b[i] += use
            a.pop()
            self.arcs.pop()

    def score(self, word: bytes, weight: float = 0.0) -> float:
        """Natural log of the marginal probability of one word; the end has none. weight: for the expected uses."""
        if not word:
            return -math.inf
        word = b" " + word
        old, n = self.word, 0
        for n in range(min(len(old), len(word)) + 1):
            if n == len(old) or n == len(word) or old[n] != word[n]:
                break
        self._back(n)
        self.word, a, root, exp, inf = word, self.a, self.ends, math.exp, -math.inf
        for j in range(n + 1, len(word) + 1):
            node, arcs, most = root, [], inf
            for i in range(j - 1, -1, -1):
                node = node.get(word[i])
                if node is None:
                    break
                hit = node.get(None)
                if hit is not None:
                    x = a[i] + hit[1]
                    arcs.append((i, hit[0], x))
                    if x > most:
                        most = x
            total = 0.0
            for _, _, x in arcs:
                total += exp(x - most)
            a.append(most + math.log(total))
            self.b.append(0.0)
            self.arcs.append(arcs)
        self.b[-1] += weight
        return a[-1]

    def expected(self) -> dict[bytes, float]:
        """Expected uses of the pieces by all words so far, times their weights."""
        self._back(0)
        self.word = b""
        return {k: x for k, x in zip(self.pieces, self.uses, strict=True) if x}


class Lattices:
    """Marginals of many words under several components at once. Their pieces are the same, so a word's arcs are found
    once; the forward recursion runs over all words and components, one position after the other."""

    def __init__(self, scores: list[dict[bytes, float]], chunk: int = 4096):
        self.logs, self.chunk, self.ends = np.log(np.array([list(p.values()) for p in scores]).T), chunk, {}
        for n, k in enumerate(scores[0]):
            node = self.ends
            for byte in reversed(k):
                node = node.setdefault(byte, {})
            node[None] = n

    def score(self, text: list[bytes]) -> np.ndarray:
        """Natural logs of the marginal probabilities, words by components; the end has none. Words come sorted at best."""
        out = [self._some(text[lo : lo + self.chunk]) for lo in range(0, len(text), self.chunk)]
        return np.concatenate(out) if out else np.zeros((0, self.logs.shape[1]))

    def _some(self, text: list[bytes]) -> np.ndarray:
        # prefixes are numbered; an arc leads from one to a longer one, by a piece
        level, to, source, piece, last = array("i", [0]), array("i"), array("i"), array("i"), []
        old, path = b"", [0]
        for word in text:
            if not word:
                last.append(-1)
                continue
            word, n = b" " + word, 0
            for n in range(min(len(old), len(word)) + 1):
                if n == len(old) or n == len(word) or old[n] != word[n]:
                    break
            del path[n + 1 :]
            for j in range(n + 1, len(word) + 1):
                path.append(len(level))
                level.append(j)
                node = self.ends
                for i in range(j - 1, -1, -1):
                    node = node.get(word[i])
                    if node is None:
                        break
                    if None in node:
                        to.append(path[j])
                        source.append(path[i])
                        piece.append(node[None])
            old = word
            last.append(path[-1])
        level, to, source, piece = (np.frombuffer(x, dtype=np.int32) if len(x) else np.zeros(0, np.int32) for x in (level, to, source, piece))
        order = np.argsort(level[to], kind="stable")
        to, source, piece = to[order], source[order], piece[order]
        cuts = np.searchsorted(level[to], np.arange(1, level.max() + 2))
        a = np.zeros((len(level) + 1, self.logs.shape[1]))
        a[-1] = -np.inf
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            x = a[source[lo:hi]] + self.logs[piece[lo:hi]]
            new = np.concatenate([[True], to[lo + 1 : hi] != to[lo : hi - 1]])
            start = np.flatnonzero(new)
            most = np.maximum.reduceat(x, start)
            total = np.add.reduceat(np.exp(x - most[np.cumsum(new) - 1]), start)
            a[to[lo:hi][start]] = most + np.log(total)
        return a[last]


def components(docs: DataFrame, train, max_parts: int) -> list[str | None]:
    """Values of lang with most training rows; one more component takes the rest."""
    if "lang" not in docs.columns:
        return []
    n = docs.filter(train & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.lang for r in n.orderBy(F.desc("n"), "lang").limit(max_parts - 1).collect())


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _wrap(words_: list[bytes]) -> bytes:
    """Words (they hold no line end), sorted: compressed, what neighbours share costs little."""
    return _zip(b"\n".join(words_))


def _unwrap(raw: bytes) -> list[bytes]:
    return _unzip(raw).split(b"\n")


def _columns(raw: bytes, kind: str, n: int) -> np.ndarray:
    """A matrix of n rows from its compressed columns."""
    return np.frombuffer(_unzip(raw), dtype=kind).reshape(-1, n).T


def _planes(m: np.ndarray) -> bytes:
    return _zip(np.ascontiguousarray(m.T).tobytes())


def _pack(parts: int, ranges: int):
    """Rows (doc_id, held_out, part, text) to blocks. Of each block: a row for every range of words with its distinct
    words and one count a component, and one row (range: the last) with all its texts. The name is a digest of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), *((c, pa.binary()) for c in ("words", "counts", "texts"))])
        tables = [Counter() for _ in range(parts + 1)]  # the last: words of held-out rows
        rows: list[tuple] = []
        size = 0

        def block():
            raw = pa.BufferOutputStream()
            texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "held_out": [r[1] for r in rows], "text": pa.array([r[2] for r in rows], pa.large_binary())})
            with pa.ipc.new_stream(raw, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(texts)
            blob = raw.getvalue().to_pybytes()
            name = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little", signed=True)
            dealt: list[list[bytes]] = [[] for _ in range(ranges)]
            for w in sorted(set().union(*tables)):
                dealt[zlib.crc32(w) % ranges].append(w)
            for r, some in enumerate(dealt):
                if some:
                    m = np.array([[t[w] for w in some] for t in tables[:parts]], dtype="<i8").T
                    yield pa.RecordBatch.from_pydict({"block": [name], "range": [r], "words": [_wrap(some)], "counts": [_planes(m)], "texts": [None]}, schema=schema)
            yield pa.RecordBatch.from_pydict({"block": [name], "range": [LAST], "words": [None], "counts": [None], "texts": [blob]}, schema=schema)

        for batch in batches:
            ids, held, part = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "part"))
            for k, text in enumerate(batch.column("text")):
                raw = text.as_py()
                rows.append((ids[k], held[k], raw))
                tables[part[k]].update(words(raw))
                tables[part[k]][END] += 1
                size += len(raw) + 16
                if size >= BLOCK:
                    yield from block()
                    tables, rows, size = [Counter() for _ in range(parts + 1)], [], 0
        if rows:
            yield from block()
        tables, rows = [], []
        trim()

    return run


def _ranges(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows that arrive sorted by key, as runs."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    yield from groupby(rows, lambda row: row[key])


def _merge(parts: int):
    """By range: its words, sorted, with their summed counts; and the sums that the scores need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _ranges(batches, "range"):
            index: dict[bytes, int] = {}
            total = np.zeros((1 << 12, parts), dtype=np.int64)
            for row in rows:
                own = _unwrap(row["words"])
                at = np.array([index.setdefault(w, len(index)) for w in own])
                while len(total) < len(index):
                    total = np.concatenate([total, np.zeros_like(total)])
                total[at] += _columns(row["counts"], "<i8", len(own))
            some = sorted(index)
            m = total[[index[w] for w in some]]
            end = total[index[END]] if END in index else np.zeros(parts, np.int64)
            sums = {f"{k}_c{j}": [int(x)] for k, v in (("n", m.sum(0)), ("v", (m > 0).sum(0)), ("d", end)) for j, x in enumerate(v)}
            for lo in range(0, len(some), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "words": [_wrap(some[part])], "counts": [_planes(m[part])], "v": [int((m.any(1)).sum()) if lo == 0 else 0]} | (sums if lo == 0 else {k: [0] for k in sums}))

    return run


def fit_pieces(table: DataFrame, parts: list[int], prior: list[dict[bytes, float]], strength: float = 200.0) -> list[dict[bytes, float]]:
    """One pass of expected counts over the distinct training words of each component; a word weighs its discount. The
    sum has one row a piece and component, so its size is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lattice(p) for p in prior]
        for batch in batches:
            for row in batch.to_pylist():
                text = _unwrap(row["words"])
                c = _columns(row["counts"], "<i8", len(text))
                for lattice, k in zip(own, parts, strict=True):
                    for i in np.flatnonzero(c[:, k]):
                        lattice.score(text[i], DISCOUNT)
        for k, lattice in enumerate(own):
            got = lattice.expected()
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(got), pa.int32()), "piece": pa.array(list(got), pa.binary()), "n": pa.array(list(got.values()), pa.float64())})

    got: list[dict[bytes, float]] = [{} for _ in parts]
    for r in table.select("words", "counts").mapInArrow(run, "k int, piece binary, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).collect():
        got[r.k][bytes(r.piece)] = r.n
    out = []
    for g, p in zip(got, prior, strict=True):
        total = sum(g.values()) + strength
        out.append({k: (g.get(k, 0.0) + strength * v) / total for k, v in p.items()})
    return out


def _back():
    """By range: words with their count and weights first, then what each block has of the range: it gets its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows in _ranges(batches, "range"):
            index: dict[bytes, int] = {}
            count, logs, ready = [], [], None
            for row in rows:
                own = _unwrap(row["words"])
                if row["block"] is None:
                    index.update(zip(own, range(len(index), len(index) + len(own)), strict=True))
                    count.append(_columns(row["counts"], "<i8", len(own)))
                    logs.append(_columns(row["logs"], "<f4", len(own)))
                    continue
                if ready is None:
                    ready = np.concatenate(count), np.concatenate(logs)
                    count, logs = [], []
                at = np.array([index[w] for w in own])
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "range": pa.array([r], pa.int32()), "words": [row["words"]], "counts": [_planes(ready[0][at])], "logs": [_planes(ready[1][at])], "texts": pa.array([None], pa.binary())})

    return run


class Weights:
    """Log probabilities of words by component, from counts and lattices (every word has one in every component)."""

    def __init__(self, n: float, v: float, n_part: np.ndarray, v_part: np.ndarray, share: np.ndarray, pieces: list[dict[bytes, float]]):
        self.n, self.v, self.n_part, self.v_part, self.share, self.pieces = n, v, n_part, v_part, share, pieces

    def logs(self, c: np.ndarray, lat: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.where(np.isfinite(lat), lat + math.log(0.99), math.log(0.01))
        every = c.sum(1)
        with np.errstate(divide="ignore"):
            mean = np.logaddexp.reduce(lat + self.share, axis=1)
            back = np.logaddexp(np.log(np.maximum(every - DISCOUNT, 0) / self.n), math.log(DISCOUNT * self.v / self.n) + mean)
            rest = np.logaddexp(lat + math.log(1 - ACROSS), back[:, None] + math.log(ACROSS))
            return np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / self.n_part), np.log(DISCOUNT * self.v_part / self.n_part) + rest)


def score(docs: DataFrame, vocab_path: str, max_parts: int = 8, modulo: int = 7, passes: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score: one row per row of docs."""
    held = held_out("doc_id", modulo)
    langs = components(docs, ~held, max_parts)
    parts = len(langs) + 1
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, langs)), lang) - 1, F.lit(-1)) if langs else F.lit(-1)
    own = bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held.alias("held_out"),
        F.when(held, F.lit(-1)).when(number < 0, F.lit(parts - 1)).otherwise(number).cast("int").alias("part"),
        utf8("text").alias("text"),
    )
    ranges = max(8, scan_parts(docs))
    packed = keep(own.mapInArrow(_pack(parts, ranges), "block long, range int, words binary, counts binary, texts binary"), "lm-blocks")
    by_range = packed.filter(F.col("range") < LAST)
    kinds = [f"{k}_c{j}" for k in "nvd" for j in range(parts)]
    merged = by_range.select("range", "words", "counts").repartition("range").sortWithinPartitions("range")
    table = keep(merged.mapInArrow(_merge(parts), "range int, words binary, counts binary, v long, " + ", ".join(f"{k} long" for k in kinds)), "lm-table")
    # tokens and distinct words, in all and by component; the count of ends is that of training rows
    sums = table.agg(F.sum("v").alias("v"), *(F.sum(k).alias(k) for k in kinds)).first()
    all_of = lambda kind: np.array([sums[f"{kind}_c{j}"] or 0 for j in range(parts)], dtype=float)
    n, v = int(all_of("n").sum()), sums.v or 0
    live = [j for j in range(parts) if all_of("n")[j]] or [0]
    rows = all_of("d")[live]
    share = np.log((rows + 1) / (rows.sum() + len(live)))
    given = vocabulary(vocab_path)
    pieces = [given] * len(live)
    if n:
        for _ in range(passes):
            pieces = fit_pieces(table, live, pieces)
    weights = Weights(n, v, all_of("n")[live], all_of("v")[live], share, pieces)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices([*weights.pieces, given])
        for batch in batches:
            for row in batch.to_pylist():
                text = _unwrap(row["words"])
                c = _columns(row["counts"], "<i8", len(text))[:, live].astype(float)
                spelled = lattices.score(text)
                plain = np.where(np.isfinite(spelled[:, -1:]), spelled[:, -1:], 0.0)  # the end is no spelling
                logs = np.concatenate([weights.logs(c, spelled[:, :-1]), plain], 1).astype("<f4")
                yield pa.RecordBatch.from_pydict({"range": pa.array([row["range"]], pa.int32()), "words": [row["words"]], "counts": [_planes(c.sum(1).astype("<i8")[:, None])], "logs": [_planes(logs)], "block": pa.array([None], pa.int64())})

    both = "range int, words binary, counts binary, logs binary, block long"
    weighed = keep(table.select("range", "words", "counts").mapInArrow(weigh, both), "lm-scores")
    asked = by_range.select("range", "words", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("logs"), "block")
    answers = weighed.unionByName(asked).repartition("range").sortWithinPartitions("range", F.col("block").isNotNull()).mapInArrow(_back(), "block long, range int, words binary, counts binary, logs binary, texts binary")
    texts = packed.filter(F.col("range") == LAST).select("block", "range", "words", "counts", F.lit(None).cast("binary").alias("logs"), "texts")
    dealt = answers.unionByName(texts).repartition("block").sortWithinPartitions("block", "range")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's words come first, then its texts."""
        for _, rows in _ranges(batches, "block"):
            index: dict[bytes, int] = {}
            count, logs, ready = [], [], None
            for row in rows:
                if row["texts"] is None:
                    got = _unwrap(row["words"])
                    at = sum(map(len, count))
                    index.update(zip(got, range(at, at + len(got)), strict=True))
                    count.append(_columns(row["counts"], "<i8", len(got))[:, 0])
                    logs.append(_columns(row["logs"], "<f4", len(got)))
                    continue
                if ready is None:
                    c = np.concatenate(count)
                    ready = np.concatenate(logs), np.log10((c + 1) / (n + v + 1)), c > 0
                    count, logs = [], []
                weight, base, known = ready
                texts = pa.ipc.open_stream(row["texts"]).read_next_batch()
                out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": [], "spelled_score": []}
                for text in texts.column("text"):
                    ids = np.array([index[w] for w in words(text.as_py())] + [index[END]])
                    logs_ = weight[ids].sum(0, dtype=float)
                    joint = share + logs_[:-1]
                    out["spelled_score"].append(float(logs_[-1] / math.log(10)))
                    out["n_tokens"].append(len(ids))
                    out["n_known"].append(int(known[ids].sum()))
                    out["base_score"].append(float(base[ids].sum()))
                    out["score"].append(float(np.logaddexp.reduce(joint) / math.log(10)))
                out |= {"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "train_tokens": pa.array([n] * len(texts), pa.int64())}
                yield pa.RecordBatch.from_pydict({x: out[x] for x in RESULT})

    return dealt.mapInArrow(final, ", ".join(f"{k} {t}" for k, t in RESULT.items()))
