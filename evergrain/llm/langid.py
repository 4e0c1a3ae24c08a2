"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; one logistic classifier per bit reads hashed 1- to 3-grams of the lower-cased letters
of the whole text. Decoding is loss-weighted: the loss of each bit against a codeword counts by how well that bit's
classifier does on training rows of that language, and the codeword with the least loss wins. A small gap between
the best two marks the text as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: of every language the ``per_lang`` rows with the smallest
hash of doc_id and text, of a long text the first ``largest`` bytes; with very many languages fewer of each, so that they are
about ``rows`` in all. Every language that has a labelled text is learned, whatever its ids and the length of its texts. Prediction
reads text alone, whole.

Corners: a null text and a text without a letter give ``und`` with score 0; with no labelled row every text does; one
language only gives that language; a null lang is no label; ties of codewords go to the smaller name; repeated rows
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bounded, held_out, utf8

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
BITS, NGRAMS = 15, (1, 2, 3)
#: ASCII bytes that are no letters become spaces, A-Z become a-z; bytes of other scripts stay.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def grams(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed n-grams that end at each byte, per order; raw begins with two spaces."""
    a = raw.astype(np.uint32)
    code = a[2:].copy()
    for n in NGRAMS:
        if n > 1:
            code = code * np.uint32(257) + a[3 - n : len(a) - n + 1] + np.uint32(1)
        h = (code + np.uint32(n)) * np.uint32(2654435761)
        yield h >> np.uint32(32 - BITS)


def folded(text: bytes) -> bytes:
    """Lower-case, letters only, runs of anything else as one space."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split())


def codewords(k: int) -> np.ndarray:
    """k codewords of +1 and -1: all splits of the classes for up to 4, else seeded random columns with the
    largest least distance of 64 draws."""
    if k <= 4:
        cols = [[1 if (m >> i) & 1 else -1 for i in range(k)] for m in range(1, 1 << (k - 1))] or [[1] * k]
        return np.array(cols, dtype=np.int8).T
    rng, best, far = np.random.default_rng(7), None, -1
    n = int(np.ceil(10 * np.log2(k)))
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, n))
        m[0, np.abs(m.sum(0)) == k] *= -1
        d = n - (m.astype(int) @ m.T + n) // 2
        least = d[~np.eye(k, dtype=bool)].min()
        if least > far:
            best, far = m, least
    return best


class Model:
    """Codewords, a weight for each bit and n-gram, and the weight of each bit for each language."""

    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.trust = langs, code, w, bias, trust

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Signed margin of every bit for every (folded) text; the texts are read as one array."""
        whole = b"  " + b"  ".join(texts) + b"  "
        raw = np.frombuffer(whole, dtype=np.uint8)
        sizes = np.array([len(t) + 2 for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        out = np.zeros((len(texts), self.w.shape[1]))
        step = 1 << 17  # letters at a time: bounds memory for any text
        for lo in range(0, len(raw) - 2, step):
            part = raw[lo : lo + step + 2]
            got = sum(self.w[h] for h in grams(part))
            first = np.searchsorted(starts, lo, "right") - 1
            last = np.searchsorted(starts, lo + len(got), "left")
            cuts = np.maximum(starts[first:last] - lo, 0)
            out[first:last] += np.add.reduceat(got, cuts, axis=0)
        return out / np.sqrt(np.maximum(sizes, 1) * len(NGRAMS) * 1.0)[:, None] ** 2 * SCALE + self.bias

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the softmin of the losses, and the gap to the next."""
        z = f[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -z) * self.trust[None]).sum(2)
        best = loss.argmin(1)
        least = loss.min(1, keepdims=True)
        p = np.exp(-(loss - least) * loss.shape[1])
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, axis=1)[:, ::-1]
        gap = top[:, 0] - (top[:, 1] if p.shape[1] > 1 else 0)
        return best, top[:, 0], gap


#: Margins are means over n-grams; this factor gives them the range that the logistic loss needs.
SCALE = 64.0


def fit(rows: list[tuple[str, bytes]], epochs: int = 12, rate: float = 0.5, decay: float = 1e-4) -> Model | None:
    """A model from (lang, text) rows; None without rows."""
    langs = sorted({x for x, _ in rows})
    if not langs:
        return None
    code = codewords(len(langs))
    bits, rng = code.shape[1], np.random.default_rng(11)
    kept = []
    for lang, text in rows:
        raw = folded(text)
        h, c = np.unique(np.concatenate(list(grams(np.frombuffer(b"  " + raw + b"  ", dtype=np.uint8)))), return_counts=True)
        kept.append((langs.index(lang), h, (c / c.sum() * SCALE).astype(np.float32)))
    w, seen = np.zeros((1 << BITS, bits), np.float32), np.full((1 << BITS, bits), 1e-3, np.float32)
    bias = np.zeros(bits, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(kept)):
            k, h, x = kept[i]
            y = code[k].astype(np.float32)
            z = y * (x @ w[h] + bias)
            g = (-y / (1 + np.exp(np.clip(z, -30, 30))))[None] * x[:, None] + decay * w[h]
            seen[h] += g * g
            w[h] -= rate * g / np.sqrt(seen[h])
    model = Model(langs, code, w, bias, np.ones(code.shape))
    right = np.zeros(code.shape)
    count = np.zeros(len(langs))
    for k, h, x in kept:
        right[k] += (x @ w[h] + bias) * code[k] > 0
        count[k] += 1
    trust = np.maximum(right / count[:, None], 1e-3)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def sample(docs: DataFrame, train, per_lang: int, rows: int, largest: int) -> list[tuple[str, bytes]]:
    """The bounded sample of labelled rows: of every language those with the least hash, ``per_lang`` at most, fewer if
    there are so many languages that they would pass ``rows`` in all (eight at least). Two scans: the first counts, the
    second moves a few times the sample."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), utf8("text").alias("text")).filter(F.col("lang").isNotNull() & train & (F.octet_length("text") > 0))
    own = own.select("lang", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("mix"), F.substring("text", 1, largest).alias("text"))
    counts = own.groupBy("lang").agg(F.approx_count_distinct("mix", 0.02).alias("n")).collect()
    if not counts:
        return []
    few = min(per_lang, max(8, rows // len(counts)))
    # a hashed share of each language, four times what is wanted, so that no language's rows meet in one task; one row a language
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 4 * few / max(1, r.n)) * (1 << 30))) for r in counts], "lang string, share long")
    some = own.join(F.broadcast(shares), "lang").filter(F.pmod("mix", F.lit(1 << 30)) < F.col("share")).groupBy("lang", "mix").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("mix")
    got = some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= few).select("lang", "mix", "text").collect()
    return [(r.lang, bytes(r.text)) for r in sorted(got, key=lambda r: (r.mix, r.lang))]


def label(model: Model | None, texts: Iterable[bytes]) -> tuple[list[str], list[float], list[float]]:
    """Language, score and gap of each text; some texts at a time are read as one array."""
    import regex

    letter = regex.compile(r"\p{L}")
    lang, score, gap = [], [], []
    todo: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        best, top, far = model.decode(model.margins([x for _, x in todo]))
        for (i, _), b, t, g in zip(todo, best, top, far, strict=True):
            lang[i], score[i], gap[i] = model.langs[b], float(t), float(g)
        todo.clear()

    for i, raw in enumerate(texts):
        lang.append("und")
        score.append(0.0)
        gap.append(0.0)
        if model is not None and letter.search(raw.decode("utf-8", "replace")):
            todo.append((i, folded(raw)))
            size += len(raw)
            if size > 1 << 19:
                flush()
                size = 0
    if todo:
        flush()
    return lang, score, gap


def predict(docs: DataFrame, model: Model | None, held, min_gap: float) -> DataFrame:
    """One row per row of docs; no shuffle. The model's size is fixed by BITS and the number of bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, gap = label(model, (x.as_py() for x in batch.column("text")))
            low = [x == "und" or g < min_gap for x, g in zip(lang, gap, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score, "ambiguous": low})

    own = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), utf8("text").alias("text"))
    return own.mapInArrow(run, SCHEMA)


def learned(docs: DataFrame, held, per_lang: int = 300, rows: int = 20_000, largest: int = 1 << 15) -> Model | None:
    return fit(sample(docs, ~held, per_lang, rows, largest))


def identify(docs: DataFrame, min_gap: float = 0.05, **parameters) -> DataFrame:
    """Fit on labelled rows outside the held-out fold (parameters: see learned()), predict all rows."""
    held = held_out("doc_id", 4)
    return predict(docs, learned(docs, held, **parameters), held, min_gap)


def identified(docs: DataFrame, min_gap: float = 0.05, **parameters) -> DataFrame:
    """Rows of docs, unchanged, whose language is known: neither ``und`` nor ambiguous. Takes what identify() takes."""
    model = learned(docs, held_out("doc_id", 4), **parameters)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            for lo in range(0, len(text), 256):
                lang, _, gap = label(model, [x.as_py() for x in text.slice(lo, 256)])
                good = [x != "und" and g >= min_gap for x, g in zip(lang, gap, strict=True)]
                own = batch.column(0).slice(lo, 256).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(own.flatten(), names=names)

    # the columns of docs travel as one, so that none of their names can meet ours
    clear = bounded(docs).select(F.struct("*").alias("_own"), utf8("text").alias("_text"))
    return clear.mapInArrow(run, docs.schema)
