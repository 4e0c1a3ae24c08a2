"""Operators over documents against brute force, on tables with every corner."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from evergrain.llm import bpe, jaccard, langid, lattice, licences, mixture, shingles
from evergrain.llm.queries import pattern, tokenizer

from .common import DOCS, corpus, frame, words


def split(text):
    return (text or "").encode().lower().split()


def fold(doc_id, modulo):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulo == 2


# --- op1


def test_lattice_sums_all_segmentations():
    p = {b" ": 0.1, b"a": 0.2, b"b": 0.2, b"ab": 0.2, b" a": 0.1, b" ab": 0.1, b"ba": 0.1}
    own = lattice.Lattice(p)

    def brute(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * p.get(w[i:j], 0) for i in range(j))
        return a[-1]

    total = Counter()
    for w in (b"abab", b"abba", b"ab", b"b", b"abab"):
        assert math.isclose(own.score(w, 1.0), math.log(brute(b" " + w)))
        full = brute(b" " + w)
        for piece in p:  # expected uses by derivative
            up = {**p, piece: p[piece] * (1 + 1e-6)}
            a = [1.0] + [0.0] * (len(w) + 1)
            x = b" " + w
            for j in range(1, len(x) + 1):
                a[j] = sum(a[i] * up.get(x[i:j], 0) for i in range(j))
            total[piece] += (a[-1] - full) / full / 1e-6
    got = own.expected()
    for piece, n in total.items():
        assert math.isclose(got.get(piece, 0), n, abs_tol=1e-4)


def test_lattice_of_every_word_and_component():
    """Frequent words and words of one component have their lattices, too, the same as word by word."""
    import random

    rng, p = random.Random(4), {bytes([b]): 0.001 for b in range(256)} | {b" a": 0.1, b"ab": 0.2, b" ab": 0.05, b"ba": 0.1}
    both = [p, {k: v / 2 + 0.0001 * (n % 7) for n, (k, v) in enumerate(p.items())}]
    text = sorted({b"", *(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(200)), b"ab" * 2000})
    for chunk in (7, 4096):
        got = lattice.Lattices(both, chunk).score(text)
        for k, one in enumerate(both):
            own = lattice.Lattice(one)
            assert all(math.isclose(got[i, k], own.score(w), rel_tol=1e-9) for i, w in enumerate(text) if w) and got[0, k] == -math.inf

    # a word of 40 counts in one component and none in the other: both weigh its spelling
    table, c = lattice.Weights(40.0, 3, np.array([40.0, 20.0]), np.array([2.0, 2.0]), np.log([0.5, 0.5]), both), np.array([[40.0, 0.0]])
    lat = lattice.Lattices(table.pieces).score([b"ab"])
    assert np.isfinite(lat).all() and (table.logs(c, lat) > table.logs(c, np.full((1, 2), -np.inf))).all()


def test_lattice_query_counts_and_base(spark):
    rows = corpus()
    got = lattice.score(frame(spark, rows), tokenizer("piece_bpe_32k.model")).collect()
    assert len(got) == len(rows)
    count, n = Counter(), 0
    for r in rows:
        if not fold(r[0], 7):
            count.update([*split(r[1]), None])
            n += len(split(r[1])) + 1
    v = len(count)
    want = {}
    for r in rows:
        t = [*split(r[1]), None]
        want.setdefault(r[0], []).append((fold(r[0], 7), len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)))
    for g in got:
        w = want[g.doc_id][0]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == w[:4]
        assert math.isclose(g.base_score, w[4], rel_tol=1e-9)
        assert g.score < 0 and math.isfinite(g.score)


def forward(word, p):
    """Marginal probability of a word over all segmentations, with the mass up to and from each byte."""
    x = b" " + word
    a, b = [1.0] + [0.0] * len(x), [0.0] * len(x) + [1.0]
    for j in range(1, len(x) + 1):
        a[j] = sum(a[i] * p[x[i:j]] for i in range(j) if x[i:j] in p)
    for i in range(len(x) - 1, -1, -1):
        b[i] = sum(p[x[i:j]] * b[j] for j in range(i + 1, len(x) + 1) if x[i:j] in p)
    return x, a, b


def test_lattice_score_is_a_forward_sum(spark, monkeypatch):
    """Both scores of every row against a plain forward recursion over the whole text's lattice of pieces and known words,
    with piece scores fitted by plain forward and backward sums."""
    given = {bytes([b]): 0.002 for b in range(256)} | {b" a": 0.1, b"ab": 0.1, b" ab": 0.05, b"cd": 0.1, b" b": 0.05, b"ef": 0.05}
    given = {k: v / sum(given.values()) for k, v in given.items()}
    monkeypatch.setattr(lattice, "vocabulary", lambda path: given)
    rows = corpus(60, 4)
    rows = [r for r in rows if len(r[1] or "") < 3000]
    d, across, strength = lattice.DISCOUNT, lattice.ACROSS, 200.0
    train = [r for r in rows if not fold(r[0], 7)]
    names = sorted({r[2] for r in train if r[2]}) + [None]
    counts = {k: Counter(w for r in train if r[2] == k for w in [*split(r[1]), b""]) for k in names}
    every = sum(counts.values(), Counter())
    n, v = every.total(), len(every)
    ends = {k: sum(r[2] == k for r in train) for k in names}
    share = {k: (ends[k] + 1) / (len(train) + len(names)) for k in names}
    fitted = {}
    for k in names:
        uses = Counter()
        for w in counts[k]:
            if w:
                x, a, b = forward(w, given)
                for i in range(len(x)):
                    for j in range(i + 1, len(x) + 1):
                        if x[i:j] in given:
                            uses[x[i:j]] += d * a[i] * given[x[i:j]] * b[j] / a[-1]
        fitted[k] = {q: (uses[q] + strength * given[q]) / (uses.total() + strength) for q in given}

    def joint(tokens, k):
        """One forward recursion over the text: a state a boundary of words; arcs are known words and spelled ones."""
        nk, vk, log = counts[k].total(), len(counts[k]), 0.0
        for w in tokens:
            spelled = {j: forward(w, fitted[j])[1][-1] if w else 0.0 for j in names}
            back = max(every[w] - d, 0) / n + d * v / n * sum(share[j] * spelled[j] for j in names)
            arcs = [max(counts[k][w] - d, 0) / nk, d * vk / nk * across * back, d * vk / nk * (1 - across) * spelled[k]]
            log += math.log(sum(arcs))
        return log

    want = {}
    for r in rows:
        t = [*split(r[1]), b""]
        logs = [math.log(share[k]) + joint(t, k) for k in names]
        top = max(logs)
        plain = sum(math.log10(forward(w, given)[1][-1]) for w in t if w)
        want[r[0]] = ((top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10), plain)
    for g in lattice.score(frame(spark, rows), "none", passes=1).collect():
        assert math.isclose(g.score, want[g.doc_id][0], rel_tol=1e-5, abs_tol=1e-4)
        assert math.isclose(g.spelled_score, want[g.doc_id][1], rel_tol=1e-5, abs_tol=1e-4)


def test_lattice_is_a_probability():
    """No level gives more than one: the discounted counts and what they save."""
    p = {bytes([b]): 1 / 300 for b in range(97, 101)} | {b" ": 0.5}
    weights = lattice.Weights(10, 3, np.array([6.0, 4.0]), np.array([2.0, 2.0]), np.log([0.6, 0.4]), [p, p])
    c = np.array([[4.0, 2.0], [2.0, 0.0], [0.0, 2.0]])
    known = np.exp(weights.logs(c, np.full(c.shape, -np.inf))).sum(0)
    alone = (np.maximum(c - lattice.DISCOUNT, 0) / [6.0, 4.0]).sum(0)
    assert (known <= 1).all() and (known >= alone).all()


def test_lattice_empty_and_untrained(spark):
    vocab = tokenizer("piece_bpe_32k.model")
    assert lattice.score(frame(spark, []), vocab).count() == 0
    alone = next(i for i in range(100) if fold(i, 7))
    (r,) = lattice.score(spark.createDataFrame([(alone, "some words")], "doc_id long, text string"), vocab).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score) == (0, 0, 3, 0.0) and r.score < 0


# --- op2


def shingle_sets(rows, width):
    out = {}
    for r in rows:
        w = split(r[1])
        out.setdefault(r[0], set()).update(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else out.setdefault(r[0], set())
    return out


def brute_classes(rows, width, percent):
    sets = shingle_sets([r for r in rows if r[0] is not None], width)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_against_brute_force(spark, width, percent):
    rows = corpus(seed=width)
    want = brute_classes(rows, width, percent)
    got = jaccard.classes(frame(spark, rows), width, percent).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is not None:
            assert (g.n_shingles, g.component_id) == want[g.doc_id]


def test_jaccard_large_group_and_small_caps(spark, monkeypatch):
    """Chains of near copies in groups and slices cut far below their sizes lose no link."""
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "QUERIES", 2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(40):
        w = base.copy()
        for k in range(i % 9):
            w[(7 * k + i) % 60] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "en", "a", 1, "x", 1, "y", 0))
    want = brute_classes(rows, 4, 60)
    assert len({c for _, c in want.values()}) < 40
    for g in jaccard.classes(frame(spark, rows), 4, 60).collect():
        assert g.component_id == want[g.doc_id][1]


def test_jaccard_deals_in_steps(spark, monkeypatch):
    """Several exchanges of few bits each give the same classes, and no row of a block beyond the fan."""
    monkeypatch.setattr(jaccard, "FAN", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 500)
    rows = corpus(seed=2)
    want = brute_classes(rows, 4, 85)
    for g in jaccard.classes(frame(spark, rows), 4, 85).collect():
        assert g.doc_id is None or (g.n_shingles, g.component_id) == want[g.doc_id]


def test_jaccard_words_that_polynomials_confuse(spark):
    """The Thue-Morse word and its complement agree in every polynomial modulo 2^64; they are two words."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    rows = [(1, a, "en", "s", 1, "x", 1, "y", 0), (2, b, "en", "s", 1, "x", 1, "y", 0), (3, a, "en", "s", 1, "x", 1, "y", 0)]
    assert {(g.doc_id, g.component_id) for g in jaccard.classes(frame(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_jaccard_empty(spark):
    assert jaccard.classes(frame(spark, [])).count() == 0


def test_shingle_hashes_do_not_depend_on_chunks(monkeypatch):
    text = [b"a bb  ccc\td " * 9, b"x" * 200 + b" y z", b"", b"q"]
    whole = list(shingles.Hasher().texts(text, 3))
    monkeypatch.setattr(shingles, "CHUNK", 32)
    for a, b in zip(whole, shingles.Hasher().texts(text, 3), strict=True):
        assert np.array_equal(a, b)


# --- op3


def test_langid_learns_and_abstains(spark):
    import random

    rng = random.Random(4)
    alphabet = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno"}
    rows = [(i, words(rng, 30, alphabet[lang]), lang, "s", 1, "x", 1, "y", 0) for i in range(180) for lang in [rng.choice(list(alphabet))]]
    rows += [(1000, None, "aa", "s", 1, "x", 1, "y", 0), (1001, "123 --", "aa", "s", 1, "x", 1, "y", 0), (1002, words(rng, 20, "vwxyz"), None, None, 1, "x", 1, "y", 0)]
    got = {r.doc_id: r for r in langid.identify(frame(spark, rows)).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1000].score == 0
    assert got[1002].lang_pred == "bb"
    assert sum(got[r[0]].lang_pred != r[2] for r in rows[:180]) == 0
    assert all(0 <= g.score <= 1 and g.held_out == fold(g.doc_id, 4) for g in got.values())
    kept = {r.doc_id for r in langid.identified(frame(spark, rows)).collect()}
    assert {1000, 1001}.isdisjoint(kept) and set(range(180)) <= kept


def test_langid_without_labels(spark):
    rows = [(i, "some text", None, "s", 1, "x", 1, "y", 0) for i in range(4)]
    assert {r.lang_pred for r in langid.identify(frame(spark, rows)).collect()} == {"und"}
    assert langid.identify(frame(spark, [])).count() == 0
    one = [(i, "some text", "en", "s", 1, "x", 1, "y", 0) for i in range(9)]
    assert {r.lang_pred for r in langid.identify(frame(spark, one)).collect()} == {"en"}


def test_langid_learns_every_language(spark):
    """Rows without an id, rows of one id, long texts only, one row many times: each language is learned."""
    rng = random.Random(9)
    alphabet = {"aa": "abcde", "bb": "vwxyz", "cc": "klmno", "dd": "fghij", "ee": "pqrst"}
    make = lambda lang, n=30: words(rng, n, alphabet[lang])
    row = lambda i, text, lang: (i, text, lang, "s", 1, "x", 1, "y", 0)
    hot, (one, other) = make("ee"), [i for i in range(7000, 7100) if not fold(i, 4)][:2]
    rows = [row(i, make("aa"), "aa") for i in range(60)] + [row(None, make("bb"), "bb") for _ in range(30)] + [row(one, make("cc"), "cc") for _ in range(30)]
    rows += [row(8000 + i, make("dd", 20_000), "dd") for i in range(16)] + [row(other, hot, "ee")] * 300
    rows += [row(20_000 + k, make(lang), None) for k, lang in enumerate(alphabet)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, rows)).filter("doc_id >= 20000").collect()}
    assert got == {20_000 + k: lang for k, lang in enumerate(alphabet)}
    model = langid.learned(frame(spark, rows), langid.held_out("doc_id", 4), per_lang=5, largest=64)
    assert model.langs == sorted(alphabet)
    sample = langid.sample(frame(spark, rows), langid.F.lit(True), 5, 20_000, 64)
    assert {lang: sum(x == lang for x, _ in sample) for lang in alphabet} == {"aa": 5, "bb": 5, "cc": 5, "dd": 5, "ee": 1} and all(len(t) <= 64 for _, t in sample)


def test_codewords_differ():
    for k in (2, 3, 4, 7, 20):
        code = langid.codewords(k).astype(int)
        distance = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(distance) >= (1 if k == 2 else 2)


# --- op4


def water_fill(size, weights, most):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cap = sum(size.values()), {s: most * n for s, n in size.items()}
    target, free = {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            target |= share
            break
        target |= {s: float(cap[s]) for s in over}
        free -= over
    return target


def test_mixture_targets_and_limits(spark):
    rows = [r for r in corpus(400, 3) if r[1] is None or len(r[1]) < 5000]
    got = mixture.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    size, taken = Counter(), Counter()
    for r in rows:
        size[r[3]] += len(split(r[1]))
    for g in got:
        s = source[g.doc_id]
        assert g.source_size == size[s] and g.taken <= 3 * g.size and (g.size == 0 or g.taken % g.size == 0)
        taken[s] += g.taken
    want = water_fill(size, (1, 2, 3), 3)
    for g in got:
        assert math.isclose(g.target, want[source[g.doc_id]], rel_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(60, 0.02 * t)
    again = mixture.mix(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mixture_caps_are_reshared(spark):
    rows = [(i, "w " * (5 if i < 3 else 50), None, "tiny" if i < 3 else "big", 1, "x", 1, "y", 0) for i in range(60)]
    got = {g.doc_id: g for g in mixture.mix(frame(spark, rows)).collect()}
    assert got[0].target == 45.0 and math.isclose(got[10].target, 57 * 50 + 15 - 45)


def test_mixture_emits_what_it_takes(spark):
    rows = corpus(200, 8)[:200]
    docs = frame(spark, rows)
    taken = Counter({g.doc_id: g.taken // g.size for g in mixture.mix(docs).collect() if g.taken})
    out = mixture.emit(docs).collect()
    assert Counter(r.doc_id for r in out) == taken
    assert set(docs.columns) | {"_shard"} == set(out[0].asDict())


def test_mixture_of_repeated_rows(spark):
    """Rows that agree in every column are dealt apart: their source meets its target, too."""
    rows = [(7, "some words of a row", "en", "rep", 1, "x", 1, "y", 0)] * 300 + [(i, "w " * 40, "en", s, 1, "x", 1, "y", 0) for i, s in enumerate(["a", "b", "c"] * 40, 100)]
    docs = frame(spark, rows)
    got = mixture.mix(docs).collect()
    assert len(got) == len(rows) and all(g.taken == g.size * len(g.shards) <= 3 * g.size for g in got)
    mine = [g for g in got if g.doc_id == 7]
    assert len(mine) == 300 and len({g.taken for g in mine}) > 1
    assert abs(sum(g.taken for g in mine) - mine[0].target) <= 5
    out = mixture.emit(docs).collect()
    assert Counter(r.doc_id for r in out) == Counter({g.doc_id: 0 for g in got}) + Counter(x for g in got for x in [g.doc_id] * len(g.shards))
    assert Counter(r._shard for r in out) == Counter(x for g in got for x in g.shards)


def test_mixture_keeps_columns_of_any_name(spark):
    names = ["more", "shards", "edge_shard", "e_shard", "b_block", "_pass", "_gone", "_text", "_mix", "_copy", "block", "n"]
    rows = [(i, "some words here " * (i % 5 + 1), "s", *(f"{n}{i}" for n in names), {"k": i}, [i]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names) + ", m map<string,int>, arr array<int>")
    whole = {r[0]: r for r in rows}
    out = mixture.emit(docs).collect()
    assert out and all(tuple(r)[:-1] == whole[r.doc_id] for r in out)
    assert mixture.mix(docs).count() == 40


def test_mixture_empty(spark):
    assert mixture.mix(frame(spark, [])).count() == 0
    zero = [(1, None, None, "a", 0, "x", 1, "y", 0), (2, "  ", None, None, 0, "x", 1, "y", 0)]
    assert [(g.size, g.target, g.taken) for g in mixture.mix(frame(spark, zero)).collect()] == [(0, 0.0, 0)] * 2


def test_splitting_tree_adds_up(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 41), (None, 3)], "source string, quota long")
    rows = mixture.split(quotas, 16, 1).collect()
    for source, quota in (("a", 700), ("b", 41), (None, 3)):
        own = sorted((r["first"], r["last"]) for r in rows if r.source == source)
        assert own[0][0] == 0 and own[-1][1] == quota and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    shard = Counter()
    for r in rows:
        shard[r.shard] += r["last"] - r["first"]
    assert len(shard) == 16 and max(shard.values()) - min(shard.values()) <= 4


def test_hypergeometric_has_its_mean(spark):
    from pyspark.sql import functions as F

    # the uniform number must be one for all of a draw: a hash, as in the tree (rand() would be drawn anew at each step)
    u = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    draws = spark.range(3000).select(mixture.hypergeometric(F.lit(30), F.lit(70), F.lit(40), u).alias("x"))
    r = draws.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert abs(r.m - 12) < 0.15 and abs(r.v - 40 * 0.3 * 0.7 * 60 / 99) < 0.6 and r.lo >= 0 and r.hi <= 30


# --- op5


def test_bpe_is_the_library(spark):
    import hashlib

    import tiktoken

    path = tokenizer("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=bpe.ranks(path), special_tokens={})
    rows = corpus()
    texts = {r[0]: r[1] or "" for r in rows}
    out = bpe.encode(frame(spark, rows), path, pattern()).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    back = bpe.decode(bpe.encode(frame(spark, rows), path, pattern()), path, pattern()).collect()
    assert all(bytes(r.raw).decode() == texts[r.doc_id] for r in back)


def test_bpe_deals_chunks_out(spark):
    """Texts of many chunks through the query's own path: stitched, torn (a run longer than the overlap), malformed."""
    import hashlib

    import tiktoken

    path = tokenizer("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=pattern(), mergeable_ranks=bpe.ranks(path), special_tokens={})
    texts = [words(__import__("random").Random(k), 400, "abé\n'世 1") for k in range(6)] + ["ab " * 30 + "x" * 700 + " tail", " " * 900, "short", "", None, "it's" * 300]
    rows = [(k, None if t is None else bytearray(t.encode())) for k, t in enumerate(texts)] + [(None, bytearray(b"bad \xff bytes " * 40)), (3, bytearray(texts[3].encode()))]
    docs = spark.createDataFrame(rows, "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) as text", "1 as row", "2 as k", "3 as ids").repartition(3)
    for chunk, overlap in ((64, 16), (200, 30)):
        out = bpe.encode(docs, path, pattern(), chunk=chunk, overlap=overlap).collect()
        assert sorted((str(r.doc_id) for r in out)) == sorted(str(r[0]) for r in rows)
        for r in out:
            text = "bad \ufffd bytes " * 40 if r.doc_id is None else texts[r.doc_id] or ""
            ids = enc.encode_ordinary(text)
            assert list(r.ids or []) == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), path, pattern()).count() == 0


def test_bpe_stitches_chunks():
    import random

    rng, codec = random.Random(2), bpe.Codec(tokenizer("byte_bpe_50k.tiktoken"), pattern())
    for _ in range(400):
        text = "".join(rng.choice("aab  \n'srelvé12!.\t世") for _ in range(rng.randint(0, 150)))
        text += rng.choice(["", "a" * 60, " " * 50 + text])
        whole = codec.encode(text).tolist()
        for chunk, overlap in ((7, 5), (16, 4), (30, 10)):
            assert codec.encode(text, chunk, overlap).tolist() == whole


# --- op8


def test_licences_found_and_clean_left_alone(spark):
    mit = licences.TEMPLATES["MIT", "text"]
    rows = [
        (0, "plain words of the text and of the world", None),
        (1, "some words. Released under the MIT License. more words", None),
        (2, "Copyright 2020 X\n" + mit.replace("charge", "cost") + "\nint main", None),
        (3, "this work is licensed under the gnu general public licence version 3", None),
        (4, None, None),
        (5, "", None),
        (6, "Licensed under CC BY-NC 4.0. and then Licensed under the Apache License, Version 2.0.", None),
        (7, "word", None),
    ]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, best string")).collect()}
    assert [got[k].n_found for k in range(8)] == [0, 1, 1, 1, 0, 0, 2, 0]
    assert got[1].best == "MIT" and got[1].score == 1.0
    assert got[2].best == "MIT" and 0.95 < got[2].score < 1
    assert got[3].best == "GPL-3.0-only" and got[6].licences == "CC-BY-NC-4.0;Apache-2.0"


def test_licences_bounds_lose_nothing():
    """Pruning against brute force over every window."""
    import random

    rng, scanner = random.Random(5), licences.Scanner(licences.TEMPLATES, 0.85)
    vocabulary = "licensed under the mit license apache version 20 released work is this of a".split()
    for _ in range(200):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))).encode()
        grams = scanner.bigrams(licences.normalised(text))
        best = 0.0
        for t, m in enumerate(scanner.sizes.tolist()):
            n = min(m, len(grams))
            for s in range(len(grams) - n + 1):
                shared = (Counter(grams[s : s + n].tolist()) & scanner.counts[t]).total()
                best = max(best, 2 * shared / (n + m))
        found = scanner.batch([text])[0]
        assert (max((f[3] for f in found), default=0.0) == best) if best >= 0.85 else not found


def test_licences_of_every_size_are_found():
    """A template shortened, or with words inserted, inside a longer text; and all findings against brute force."""
    import random

    rng, made = random.Random(6), [f"w{k}" for k in range(171)]
    scanner = licences.Scanner({("M", "text"): " ".join(made)}, 0.85)
    other = [f"x{k}" for k in range(400)]
    cut, wide = made[:130], made[:90] + other[:40] + made[90:]
    for passage, dice in ((cut, 2 * 129 / (129 + 170)), (wide, 2 * 169 / (210 + 170))):
        text = " ".join(other[100:200] + passage + other[200:]).encode()
        assert scanner.batch([text]) == [[(100, len(passage) - 1, 0, dice)]]

    templates = {(n, "t"): t for n, t in (("A", "a b c a b d a b"), ("B", "a b c d e"), ("C", "d e a b c a b c f"))}
    for least in (0.5, 0.7, 0.85):
        scanner = licences.Scanner(templates, least)
        for _ in range(150):
            text = " ".join(rng.choice("abcdefx") if rng.random() < 0.4 else rng.choice(("a b c", "a b", "d e")) for _ in range(rng.randint(1, 25))).encode()
            grams, every = scanner.bigrams(text), []
            for t, m in enumerate(scanner.sizes.tolist()):
                for a in range(len(grams)):
                    for b in range(a + 1, len(grams) + 1):
                        dice = 2 * (Counter(grams[a:b].tolist()) & scanner.counts[t]).total() / (b - a + m)
                        if dice >= least:
                            every.append((a, b - a, t, dice))
            want: list = []
            for f in sorted(every, key=lambda f: (-f[3], -f[1], f[0], scanner.names[f[2]])):
                if all(f[0] + f[1] <= g[0] or g[0] + g[1] <= f[0] for g in want):
                    want.append(f)
            assert scanner.batch([text])[0] == sorted(want)


# --- shapes of results


def test_rows_and_columns_of_all(spark):
    docs = frame(spark, corpus(40))
    assert DOCS.startswith("doc_id")
    assert {"doc_id", "n_shingles", "component_id"} <= set(jaccard.classes(docs).columns)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(mixture.mix(docs).columns)
