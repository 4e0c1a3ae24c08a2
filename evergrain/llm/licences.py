"""License scans: passages of texts against licence templates, by the Dice coefficient over word bigrams.

Texts are normalised: A-Z in lower case, punctuation and white space part words, full stops are dropped, licence is read
as license. A passage of n bigrams is compared with a template of m as multisets: Dice = 2 x shared / (n + m), so with at
least ``least`` Dice n lies between m x least / (2 - least) and m x (2 - least) / least, and the passage must share at
least (n + m) x least / 2 bigrams. Hashed bigrams of a whole batch are looked up in the few thousand of all templates; a
template is a candidate for a text only if the text holds enough distinct ones of its bigrams. Of a candidate every
passage of an admissible size that begins and ends with a bigram of the template is compared exactly (any other has a
part with a greater Dice). Of passages that overlap, that of the greater Dice stands, then the longer, then the earlier,
then the first name; one that holds a part with a greater Dice can never stand and is dropped at once.

Corners: null, empty and wordless texts have no finding; repeated rows are scanned alike; a null doc_id is kept; long
texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEMPLATES
from .shared import bounded, utf8
from .shingles import Hasher

SCHEMA = "doc_id long, n_found long, licences string, best string, score double"
_PART = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: bytes) -> bytes:
    return text.translate(_PART, b".").replace(b"licence", b"license")


class Scanner:
    def __init__(self, templates: dict[tuple[str, str], str], least: float):
        self.hasher, self.least = Hasher(), least
        self.names = [name for name, _ in templates]
        self.grams = [self.bigrams(normalised(t.encode())) for t in templates.values()]
        self.sizes = np.array([len(g) for g in self.grams])
        self.counts = [Counter(g.tolist()) for g in self.grams]
        self.known = np.unique(np.concatenate(self.grams))
        self.holds = np.stack([np.isin(self.known, g) for g in self.grams]).astype(np.int32)
        # of the distinct bigrams that a passage shares: Dice >= least needs at least so many, whatever its size
        low = np.ceil(self.sizes * least / (2 - least) - 1e-9)
        repeats = np.array([len(g) - len(set(g.tolist())) for g in self.grams])
        self.need = np.maximum(1, np.ceil((self.sizes + low) * least / 2 - 1e-9) - repeats)

    def bigrams(self, norm: bytes) -> np.ndarray:
        h = self.hasher.words(norm)
        return self.hasher.runs(h, 2) if len(h) > 1 else h[:0]

    def batch(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float]]]:
        """Findings of each text: first bigram, bigrams, template, Dice."""
        out: list[list] = []
        for lo in range(0, len(texts), 128):
            own = [self.bigrams(normalised(t)) for t in texts[lo : lo + 128]]
            cuts = np.concatenate([[0], np.cumsum([len(g) for g in own])])
            grams = np.concatenate(own)
            at = np.searchsorted(self.known, grams)
            hit = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == grams)
            edge = np.searchsorted(hit, cuts)
            for k, mine in enumerate(own):
                where = hit[edge[k] : edge[k + 1]]
                out.append(self.one(mine, where - cuts[k], at[where]) if len(where) else [])
        return out

    def one(self, grams: np.ndarray, where: np.ndarray, what: np.ndarray) -> list[tuple[int, int, int, float]]:
        present = np.zeros(len(self.known), dtype=np.int32)
        present[what] = 1
        found = []
        for t in np.flatnonzero(self.holds @ present >= self.need):
            mine = self.holds[t][what] == 1
            for start, n, dice in self.passages(grams[where[mine]], where[mine], int(t)):
                found.append((start, n, int(t), dice))
        found.sort(key=lambda f: (-f[3], -f[1], f[0], self.names[f[2]]))
        kept: list[tuple[int, int, int, float]] = []
        for f in found:
            at = bisect(kept, f[0], key=lambda g: g[0])
            if (not at or kept[at - 1][0] + kept[at - 1][1] <= f[0]) and (at == len(kept) or f[0] + f[1] <= kept[at][0]):
                kept.insert(at, f)
        return kept

    def passages(self, grams: np.ndarray, spots: np.ndarray, t: int) -> Iterator[tuple[int, int, float]]:
        """First bigram, bigrams and Dice of passages between two spots of the template's bigrams; not those that hold
        a part with a greater Dice."""
        m, count = int(self.sizes[t]), self.counts[t]
        # a spot adds to what a passage shares unless the template's number of its bigram already stands before it there
        full, seen = np.full(len(spots), -1), {}
        for k, g in enumerate(grams.tolist()):
            own = seen.setdefault(g, [])
            if len(own) >= count[g]:
                full[k] = own[-count[g]]
            own.append(k)
        most = int(m * (2 - self.least) / self.least + 1e-9)
        stop = np.searchsorted(spots, spots + most)
        best = np.zeros(len(spots))  # by last spot: the greatest Dice of passages that begin later and end there or before
        for k in range(len(spots) - 1, -1, -1):
            ends = slice(k, stop[k])
            n = spots[ends] - spots[k] + 1
            dice = 2 * np.cumsum(full[ends] < k) / (n + m)
            best[ends] = np.maximum.accumulate(np.maximum(best[ends], dice))
            for x in np.flatnonzero((dice >= self.least) & (dice >= best[ends])):
                yield int(spots[k]), int(n[x]), float(dice[x])


def scan(docs: DataFrame, least: float = 0.85, templates: dict[tuple[str, str], str] = TEMPLATES) -> DataFrame:
    """One row per row of docs: how many passages are licences, their names in text order, the best and its Dice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = scanner.batch(batch.column("text").to_pylist())
            best = [max(f, key=lambda x: (x[3], x[1], -x[0])) if f else None for f in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_found": [len(f) for f in found],
                    "licences": pa.array([";".join(scanner.names[x[2]] for x in f) for f in found], pa.string()),
                    "best": pa.array([scanner.names[b[2]] if b else None for b in best], pa.string()),
                    "score": pa.array([b[3] if b else None for b in best], pa.float64()),
                }
            )

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, SCHEMA)
