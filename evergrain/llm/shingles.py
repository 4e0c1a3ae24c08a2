"""Hashed word shingles of whole texts: words by a keyless cryptographic hash, runs of them in numpy."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial over a shingle's word hashes.
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are split into words at a time; words that a task remembers, and the longest of them.
CHUNK, MEMO, LONGEST = 1 << 19, 200_000, 64


class Words(dict):
    """The first 64 bits of BLAKE2b by word: no structure of a word's letters makes two of them meet."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


class Hasher:
    """64-bit hashes of words and of runs of words."""

    def __init__(self) -> None:
        self.memo = Words()

    def words(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of raw, lower-cased already; a long text is split piece by piece."""
        if len(raw) <= CHUNK:
            part = raw.split()
            return np.fromiter(map(self.memo.__getitem__, part), np.uint64, len(part))
        out, lo = [], 0
        while lo < len(raw):
            gap = _SPACE.search(raw, lo + CHUNK)
            hi = gap.start() if gap else len(raw)
            part = raw[lo:hi].split()
            out.append(np.fromiter(map(self.memo.__getitem__, part), np.uint64, len(part)))
            lo = hi
        return np.concatenate(out)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def runs(self, h: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
        width = min(width, len(h))
        if not width:
            return h
        out = np.zeros(len(h) - width + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                out = out * _STEP + h[k : len(h) - width + 1 + k]
            return self.mix(out + np.uint64(width))

    def texts(self, texts: list[bytes], width: int) -> Iterator[np.ndarray]:
        """Sorted distinct shingles of each text."""
        for text in texts:
            yield np.unique(self.runs(self.words(text.lower()), width))
