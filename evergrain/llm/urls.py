"""URL filters: rules on host and path first, then boosted trees over lexical features.

A rule is a host and a path prefix, written ``host/prefix``. It fits a url whose host is the rule's or a subdomain of it and
whose path starts with the rule's; of several the longest rule wins, of equally long ones the smaller. Urls that no
rule fits are judged by gradient-boosted trees over length, depth, digit and punctuation shares, entropy, parameter counts
and suffix statistics.

The trees learn from labelled urls: those given, else the urls of the input that a rule fits, by its verdict.
Suffix statistics (how many labelled urls end their host, or their file name, in a suffix, and how many of them are blocked)
count all labelled urls, hashed into ``BUCKETS`` counters a fold, so that their size does not depend on the input. The trees
are fitted on at most ``rows`` distinct labelled urls, the half of each verdict (those of least hash); only their
features, numbers of fixed width, reach the driver. A labelled url reads the statistics of the other fold, so its own label
is never among its features.

Corners: a null url, and one without ``://``, has an empty host and path, fits no rule, and is judged by its features;
a path is empty, not ``/``, where the url has none, so that ``net/`` does not fit ``http://a.net``; without labelled urls the
method allows, with those of one verdict it gives that; repeated rows are judged alike; malformed UTF-8 is read as U+FFFD;
a null page_id stays null; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted
from .shared import bounded, utf8

SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"
#: Counters of suffix statistics, per fold.
BUCKETS = 1 << 12
#: Rules a table may hold: every task has all of them.
MOST_RULES = 100_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_END = re.compile("[/?#]")
_PATH_END = re.compile("[?#]")


def split(url: str) -> tuple[str, str, str, str]:
    """Host, path, query and fragment; all empty without ``://``."""
    _, there, rest = url.partition("://")
    if not there:
        return "", "", "", ""
    m = _END.search(rest)
    at = m.start() if m else len(rest)
    m = _PATH_END.search(rest, at)
    end = m.start() if m else len(rest)
    query, _, fragment = rest[end + 1 :].partition("#") if rest[end : end + 1] == "?" else ("", "", rest[end + 1 :])
    return rest[:at].translate(_LOWER), rest[at:end], query, fragment


class Rules:
    """Rules by host; ``verdicts`` maps ``host/prefix`` to ``block`` or ``allow``."""

    def __init__(self, verdicts: dict[str, str]):
        if len(verdicts) > MOST_RULES:
            raise ValueError(f"at most {MOST_RULES} rules")
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule in sorted(verdicts, key=lambda r: (-len(r), r)):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWER), []).append((slash + path, rule, verdicts[rule]))
        self.widest = max(map(len, self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest fitting rule and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        # only ends of the host that a rule can have are looked up
        at = max(0, len(host) - self.widest - 1)
        ends = [0] if len(host) <= self.widest else []
        while (at := host.find(".", at)) >= 0:
            at += 1
            ends.append(at)
        for at in ends:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    if best[0] is None or (-len(rule), rule) < (-len(best[0]), best[0]):
                        best = (rule, verdict)
                    break
        return best


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str, host: str, path: str, query: str, fragment: str) -> list[float]:
    """Length, depth, character shares, entropy and parameter counts of a url."""
    n, labels, steps = max(1, len(url)), host.split(".") if host else [], [s for s in path.split("/") if s]
    digits = sum(c.isdigit() for c in url)
    marks = sum(not c.isalnum() for c in url)
    longest = max(map(len, labels), default=0)
    return [
        len(url), len(host), len(path), len(query), len(fragment), len(labels), longest, len(steps), max(map(len, steps), default=0),
        digits / n, marks / n, sum(c.isdigit() for c in host) / max(1, len(host)), host.count("-"), path.count("-") + path.count("_"), url.count("%"),
        _entropy(url), _entropy(host), _entropy(path), query.count("=") , query.count("&") + bool(query), max(map(len, query.split("&"))),
        float(url.startswith("https")), float(path.endswith("/")), float(":" in host or "@" in host), float(bool(labels) and all(x.isdigit() for x in labels)),
    ]


def suffixes(host: str, path: str) -> list[int]:
    """Counters of the last label, the last two and the last three labels of the host, of its first label, and of the file's suffix."""
    labels = host.rsplit(".", 3)
    ends = [".".join(labels[-k:]) if len(labels) >= k else "" for k in (1, 2, 3)]
    name = path.rpartition("/")[2]
    return [zlib.crc32(f"{k}:{s}".encode()) % BUCKETS for k, s in enumerate([*ends, host.partition(".")[0], name.rpartition(".")[2] if "." in name else ""])]


def fold(url: bytes) -> int:
    return zlib.crc32(url) & 1


class Statistics:
    """Labelled urls and blocked ones among them, by fold and counter."""

    def __init__(self, seen: np.ndarray | None = None, blocked: np.ndarray | None = None):
        self.seen = np.zeros((2, BUCKETS)) if seen is None else seen
        self.blocked = np.zeros((2, BUCKETS)) if blocked is None else blocked

    def features(self, ends: np.ndarray, folds: np.ndarray | None) -> np.ndarray:
        """Log count and smoothed share of each suffix: of the other fold, or (folds None) of both."""
        pick = lambda x: x[1 - folds][np.arange(len(ends))[:, None], ends] if folds is not None else x.sum(0)[ends] / 2
        seen, blocked = pick(self.seen), pick(self.blocked)
        rate = (self.blocked.sum() + 1) / (self.seen.sum() + 2)
        return np.concatenate([np.log1p(seen), (blocked + 2 * rate) / (seen + 2)], 1)


def _shape(urls: list[bytes]) -> tuple[list[tuple[str, str, str, str]], np.ndarray, np.ndarray]:
    """Parts, lexical features and suffix counters of urls."""
    texts = [u.decode("utf-8", "replace") for u in urls]
    parts = [split(t) for t in texts]
    x = np.array([lexical(t, *p) for t, p in zip(texts, parts, strict=True)], dtype=float)
    return parts, x, np.array([suffixes(p[0], p[1]) for p in parts], dtype=np.int64)


def _labelled(pages: DataFrame, rules: Rules, labels: DataFrame | None) -> DataFrame:
    """url (bytes), blocked: labelled urls, from the rules where none are given."""
    if labels is not None:
        return bounded(labels).select(utf8("url").alias("url"), F.col("blocked").cast("boolean").alias("blocked")).filter("blocked IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rules.find(*split(u.as_py().decode("utf-8", "replace"))[:2])[1] for u in batch.column("url")]
            blocked = pa.array([None if v is None else v == "block" for v in found], pa.bool_())
            yield pa.RecordBatch.from_pydict({"url": batch.column("url"), "blocked": blocked}).filter(blocked.is_valid())

    return bounded(pages).select(utf8("url").alias("url")).mapInArrow(run, "url binary, blocked boolean")


def statistics(known: DataFrame) -> Statistics:
    """Suffix statistics over all labelled urls: each task counts in BUCKETS counters, which are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 2 * BUCKETS), dtype=np.int64)
        for batch in batches:
            urls = [u.as_py() for u in batch.column("url")]
            if urls:
                ends = _shape(urls)[2]
                at = ends + BUCKETS * np.array([fold(u) for u in urls])[:, None]
                blocked = np.array(batch.column("blocked").to_pylist(), dtype=float)
                got[0] += np.bincount(at.ravel(), minlength=2 * BUCKETS)
                got[1] += np.bincount(at.ravel(), np.repeat(blocked, ends.shape[1]), 2 * BUCKETS).astype(np.int64)
        used = np.flatnonzero(got[0])
        yield pa.RecordBatch.from_pydict({"at": used.astype(np.int64), "seen": got[0][used], "blocked": got[1][used]})

    counted = known.mapInArrow(run, "at long, seen long, blocked long").groupBy("at").agg(F.sum("seen").alias("seen"), F.sum("blocked").alias("blocked"))
    seen, blocked = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for r in counted.collect():  # at most 2 * BUCKETS rows
        seen[r.at], blocked[r.at] = r.seen, r.blocked
    return Statistics(seen.reshape(2, -1), blocked.reshape(2, -1))


def sample(known: DataFrame, stats: Statistics, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` distinct labelled urls, those of least hash of each verdict."""
    some = known.select("url", "blocked", F.xxhash64("url").alias("h"))
    counts = some.groupBy("blocked").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    # a hashed share of each verdict, twice what is wanted, so that copies of a url and whole tables do not move
    share = {r.blocked: int(min(1.0, rows / max(1, r.n)) * (1 << 30)) for r in counts}
    near = F.pmod("h", F.lit(1 << 30))
    some = some.filter(F.when(F.col("blocked"), near < share.get(True, 0)).otherwise(near < share.get(False, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [u.as_py() for u in batch.column("url")]
            if urls:
                _, x, ends = _shape(urls)
                x = np.concatenate([x, stats.features(ends, np.array([fold(u) for u in urls]))], 1)
                yield pa.RecordBatch.from_pydict({"h": batch.column("h"), "blocked": batch.column("blocked"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    shaped = some.mapInArrow(run, "h long, blocked boolean, x array<double>").dropDuplicates(["h", "blocked"])
    got = [r for v in (False, True) for r in shaped.filter(F.col("blocked") == v).orderBy("h").limit(rows // 2).collect()]
    return np.array([r.x for r in got]), np.array([float(r.blocked) for r in got])


def learned(known: DataFrame, rows: int = 10_000) -> tuple[Statistics, Boosted | None]:
    stats = statistics(known)
    x, y = sample(known, stats, rows)
    return stats, Boosted(trees=40).fit(x, y) if len(y) else None


def judge(pages: DataFrame, verdicts: dict[str, str], labels: DataFrame | None = None, rows: int = 10_000) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the method's probability of block) of every row; labels: url and
    blocked of urls to learn from."""
    rules = Rules(verdicts)
    stats, model = learned(_labelled(pages, rules, labels), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [u.as_py() for u in batch.column("url")]
            if not urls:
                continue
            parts, x, ends = _shape(urls)
            odds = model.log_odds(np.concatenate([x, stats.features(ends, None)], 1)) if model is not None else np.full(len(urls), -np.inf)
            found = [rules.find(p[0], p[1]) for p in parts]
            verdict = [v or ("block" if o > 0 else "allow") for (_, v), o in zip(found, odds, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "host": [p[0] for p in parts], "path": [p[1] for p in parts],
                "rule": pa.array([r for r, _ in found], pa.string()), "verdict": verdict, "score": 1 / (1 + np.exp(-np.clip(odds, -500, 500))),
            })

    own = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), utf8("url").alias("url"))
    return own.mapInArrow(run, SCHEMA)
