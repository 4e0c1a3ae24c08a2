"""Operators over vectors and pages, the pipeline, and the registered queries."""

import random

import numpy as np
import pytest

from evergrain.llm import components, impact, mainpage, quantise, warc

from .common import corpus, frame

VECTORS = "vec_id long, embedding array<float>, label int, name string, raw string, dim int"


def vectors(n=300, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:90] = x[3] + rng.normal(size=(40, dim)).astype(np.float32) * 0.08
    x[90:130] = x[4]
    rows = [(i, v.tolist(), int(i % 3 == 0), "n", "r", 1) for i, v in enumerate(x)]
    rows[10] = (10, None, 1, "n", "r", 1)
    rows[11] = (11, [0.0] * dim, 1, "n", "r", 1)
    rows[12] = (12, [float("nan")] + [1.0] * (dim - 1), 1, "n", "r", 1)
    rows[13] = (13, [None] + [1.0] * (dim - 1), 1, "n", "r", 1)
    rows[14] = (14, rows[5][1], None, "n", "r", 1)
    rows[15] = (15, [1.0, 2.0], 0, "n", "r", 1)
    rows[16] = (16, [2.0, 4.0], 0, "n", "r", 1)
    rows[17] = (17, [], 0, "n", "r", 1)
    return rows


def test_quantise_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantise, "CHUNK", 7)
    monkeypatch.setattr(quantise, "BATCH", 3)
    rows = vectors()
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    root = {i: i for i in links}
    for _ in range(20):
        root = {i: min([root[i], *(root[j] for j in links[i])]) for i in links}
    for lists in (1, 9, None):
        got = quantise.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3), lists=lists, sample=64).collect()
        assert len(got) == len(rows)
        for g in got:
            assert (g.n_links, g.component_id, g.kept) == (len(links[g.vec_id]), root[g.vec_id], root[g.vec_id] == g.vec_id)


def test_quantise_repeated_ids_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0, "n", "r", 1), (1, [1.0, 0.0], 0, "n", "r", 1), (2, [1.0, 0.01], 0, "n", "r", 1)]
    got = quantise.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((g.vec_id, g.n_links, g.component_id) for g in got) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert quantise.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize(("levels", "segments", "open_rows"), [(64, 6, 64), (4, 3, 2), (1, 1, 0)])
def test_impact_against_brute_force(spark, levels, segments, open_rows):
    rows = vectors(seed=levels)
    good = [(r[0], np.floor(256 * np.array(r[1], float)).astype(int)) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    want = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q and len(x) == len(y))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = impact.top_k(spark.createDataFrame(rows, VECTORS), shard_numbers=60 * 16, levels=levels, segments=segments, open_rows=open_rows).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_impact_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, "n", "r", 1)], VECTORS)
    assert impact.top_k(one).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, "n", "r", 1), (7, [1.0, -2.0], 0, "n", "r", 1)], VECTORS)
    assert list(map(tuple, impact.top_k(two).collect())) == [(0, 1, 7, 256 * 256 - 512 * 512)]
    assert impact.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_impact_answers_each_query_row(spark):
    """Rows that repeat a query's id, with its vector or another, are asked and answered each."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-3.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (3, [-1.0, 0.0])]
    got = impact.top_k(spark.createDataFrame([(*r, 0, "n", "r", 1) for r in rows], VECTORS), k=2, shard_numbers=4).collect()
    one = [(0, 1, 2, 512 * 256 + 512 * 512), (0, 2, 2, 512 * 256 + 512 * 512)]
    other = [(0, 1, 3, 3 * 65536), (0, 2, 1, -2 * 65536)]
    assert sorted(map(tuple, got)) == sorted(one + one + other)


PAGES = "page_id long, url string, html string, digest string, text string, content string"


def page(i, html, url="http://x/1"):
    return (i, url, html, "d", "t", "c")


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 1200, "y" * 1000
    rows = [page(1, big), page(5, big), page(3, big, None), page(4, other), page(6, "small"), page(7, "small"), page(8, None), page(9, ""), page(None, other), page(5, big)]
    rows += [page(20, "a\r\n\r\nb" * 300, "http://x/ä b%20\r\n?q=1")]
    docs = spark.createDataFrame(rows, PAGES).repartition(3)
    archives = warc.write(warc.decide(docs))
    back = warc.read(archives).collect()
    assert len(back) == len(rows) and not any(r.error for r in back)
    assert sorted((r.page_id or -1, r.url or "") for r in back) == sorted((r[0] or -1, r[1] or "") for r in rows)
    held = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
    assert all(held[r.payload_digest].decode() in {x[2] or "" for x in rows} for r in back)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(docs).collect()}
    n = len(big.encode())
    assert {(1, n, "revisit", 5), (3, n, "revisit", 5), (5, n, "response", None), (4, 1000, "response", None), (None, 1000, "revisit", 4), (6, 5, "response", None), (7, 5, "response", None), (8, 0, "response", None)} <= got
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_files_and_damage(spark, tmp_path):
    (row,) = warc.write(warc.decide(spark.createDataFrame([page(1, "abc"), page(2, "def")], PAGES).coalesce(1))).collect()
    raw = bytes(row.content)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    assert warc.read(spark.read.format("binaryFile").load(str(tmp_path))).count() == 2
    for bad in (raw[:-9], raw[:40] + b"\0" + raw[41:]):
        got = warc.read(spark.createDataFrame([(bytearray(bad),)], "content binary")).collect()
        assert got[-1].error
    import gzip

    whole = gzip.decompress(raw)
    assert whole.count(b"WARC/1.1") == 2 and b"".join(warc.inflate([raw[i : i + 7] for i in range(0, len(raw), 7)])) == whole


def test_main_text(spark):
    html = (
        '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this now</div>'
        "<article><h1>A title &amp; more</h1><p><b>First  words\n of it.<br><p>Second paragraph, with <a href=/x>a link</a> and some more words in it.</p><script>no()</script></article>"
        '<section id="comments"><div class="comment"><p>Nice post, thank you very much indeed.</p></div></section><footer>&copy; somebody</footer></body></html>'
    )
    rows = [page(1, html), page(2, None), page(3, ""), page(4, "<p"), page(None, html), page(5, "<div>" * 3000 + "deep words here, in a nest of boxes."), page(6, "no tags at all, but some words, and more.")]
    got = {r.page_id: r for r in mainpage.main_text(spark.createDataFrame(rows, PAGES), made=150, seen=5).collect()}
    want = "A title & more\nFirst words of it.\nSecond paragraph, with a link and some more words in it."
    assert got[1].text == want == got[None].text and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0


def test_silent_elements_stay_silent():
    """Blocks inside controls and noscript give no text; what was never closed ends with the block around it."""
    text = lambda source: [t for t in mainpage.Page(source).text if t]
    assert text("<p>a</p><noscript><p>b</p><div>c</div></noscript><p>d</p>") == ["a", "d"]
    assert text("<div><button><p>b</p></button>x</div><select><option>y</select><p>z") == ["x", "z"]
    assert text("<div>a<button><div>b</div>c</div><p>d</p>") == ["a", "d"]
    assert text("<head><noscript><h1>n</h1></noscript><p>in the body") == ["in the body"]
    assert text("<template><article><p>no</p></article></template><article><p>yes</p></article>") == ["yes"]
    assert text("<svg><p>no</svg><p>yes") == ["yes"]


def test_main_text_of_bytes(spark):
    docs = spark.createDataFrame([(1, "u", bytearray(b"<article><h1>One</h1><p>bad \xff byte, and some more words of it.</p></article>"))], "page_id long, url string, raw binary")
    (r,) = mainpage.main_text(docs.selectExpr("page_id", "url", "cast(raw as string) as html"), made=60, seen=5).collect()
    assert "bad \ufffd byte" in r.text and r.n_chars == len(r.text)
    assert mainpage.main_text(docs.selectExpr("page_id", "url", "cast(raw as string) as html").limit(0), made=20, seen=5).count() == 0


def test_main_text_of_unseen_layouts():
    model = mainpage.train([], 200)
    maker = mainpage.Maker(77)
    hit = miss = extra = 0
    for source in (maker.page() for _ in range(80)):
        ((p, y),) = mainpage._labelled([source], True)
        want = {t for t, good, leaf in zip(p.text, y, p.leaf, strict=True) if good and leaf}
        got = set(mainpage.extract(model, [source.replace(mainpage._MARK, "")])[0].split("\n")) - {""}
        hit, miss, extra = hit + len(want & got), miss + len(want - got), extra + len(got - want)
    assert hit > 0.97 * (hit + miss) and hit > 0.97 * (hit + extra)


def test_decoding_has_no_contradiction():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        odds = rng.normal(size=n) * 3
        kept = mainpage.decode(odds, parent)
        best = -np.inf
        for bits in range(1 << n):
            s = [(bits >> k) & 1 for k in range(n)]
            if all(p < 0 or s[p] >= s[k] for k, p in enumerate(parent)):
                best = max(best, sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for x, o in zip(s, odds, strict=True)))
        mine = sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for x, o in zip(kept, odds, strict=True))
        assert abs(best - mine) < 1e-9


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    rows = corpus(90, 6)
    table = frame(spark, [(r[0], r[1], rng.choice(["de", "en"]), *r[3:]) for r in rows])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert set(out.columns) == set(docs.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "mixing", "encoding"]
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    from .test_documents import brute_classes

    want = {i for i, (_, c) in brute_classes(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept if r.doc_id is not None} == want and len([r for r in kept if r.doc_id == 0]) == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_decides_by_row(spark, tmp_path):
    """Null ids and an id with two texts: each row by itself, one of each group."""
    import corpus_pipeline

    from .common import DOCS, words

    rng = random.Random(3)
    t = [words(rng, 60) for _ in range(7)]
    near = lambda text: text + " zz"
    rows = [(1, t[0]), (None, t[0]), (None, t[1]), (None, t[2]), (None, near(t[2])), (3, near(t[0])), (3, t[3]), (4, t[4]), (4, near(t[4])), (5, t[5]), (5, t[5]), (None, near(t[3])), (None, t[6]), (None, t[6])]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x), "x", 1, "y", 0) for i, x in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    sure = [(1, t[0]), (None, t[1]), (3, t[3]), (5, t[5]), (None, t[6])]
    assert all(kept.count(r) == 1 for r in sure)
    for i, x in ((None, t[2]), (4, t[4])):
        assert kept.count((i, x)) + kept.count((i, near(x))) == 1
    assert len(kept) == len(sure) + 2


def test_pipeline_corners(spark, tmp_path):
    """Empty tables, columns whose names meet those of the stages, rows without words, and every row accounted for."""
    import corpus_pipeline

    from .common import DOCS, words

    extra = ["_row", "_own", "_again", "more", "_shard", "_gone", "_text_bytes", "component_id", "name"]
    shape = DOCS.split(", word")[0] + ", " + ", ".join(f"`{x}` string" for x in extra)
    rng = random.Random(8)
    t = [words(rng, 40) for _ in range(6)]
    texts = [(1, t[0]), (2, t[0]), (3, None), (3, None), (None, ""), (None, ""), (4, t[1]), (4, t[1]), (5, t[2]), (None, t[3]), (6, t[4])]
    rows = [(i, x, "en", "a", 1, *(f"{e}-{k}" for e in extra)) for k, (i, x) in enumerate(texts)]
    docs = spark.createDataFrame(rows, shape).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted(map(tuple, kept.collect()), key=str)
    assert set(got) <= set(rows)
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted([(1, t[0]), (3, None), (3, None), (None, ""), (None, ""), (4, t[1]), (5, t[2]), (None, t[3]), (6, t[4])], key=str)
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    lettered = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert lettered.columns == docs.columns and {tuple(r) for r in lettered.collect()} == {r for r in rows if r[1]}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_broken_pages_are_read_in_linear_time():
    """Tags, quotes, comments and elements that never close, in pages of 3 MB."""
    import time

    for part in ("<a b='", "<a ", "<a<a", '<a ">" ', "</script ", "<script></script ", "<!--", "<svg><div>", "<p id=\"a' ", "&#99999", "<dt><dl>"):
        start = time.perf_counter()
        mainpage.Page(part * (3_000_000 // len(part)))
        assert time.perf_counter() - start < 30, part
    mainpage.Page("<dt><dl>" + "<div>" * 200_000 + "<dt></dt>" * 150_000)
    assert mainpage.Page("<p>&#" + "9" * 100_000 + ";&#0000000000065;").text[-1] == "\ufffdA"


def test_tags_end_where_they_end():
    tags = mainpage.Tags("a < b <p x='>' y=\">\">t</P ><!-- <i> --><b c=\"<br>d<!x><3 >")
    at, got = 0, []
    while found := tags.next(at):
        at = found[1]
        got.append(found[2:])
    assert got == [(False, "p", " x='>' y=\">\""), (True, "p", " "), (False, "", ""), (False, "b", ' c="<br'), (False, "", "")]


#: Pages of layouts that the maker of training pages does not know; lines of main text begin with +.
LAYOUTS = [
    """<html><body><div id="top-bar"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div>
    <div class="columns"><div class="left-rail"><h4>Most read</h4><ol><li><a href="1">First of all</a></li><li><a href="2">Second one</a></li></ol></div>
    <div class="center"><h1>+A long road to the river</h1><p>+The river rose in the night, and by the morning the lower fields were under water, as they had been twice before.</p>
    <p>+People who live near the bridge said that they had moved their animals to the hill in time; others were less lucky.</p>
    <p>+The council will meet on Monday to decide, once more, about the wall that was planned forty years ago.</p></div></div>
    <div id="footer">Copyright 2020. All rights reserved. <a href="/p">Privacy</a> <a href="/t">Terms</a></div></body></html>""",
    """<body><header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav></header><main><article><h2>+Bread without kneading</h2>
    <p>+Mix the flour, the salt and the yeast; add the water, and stir until no dry flour is left in the bowl.</p><ul><li>+Four cups of flour, sifted</li><li>+Two cups of water, warm</li></ul>
    <p>+Let it rest until the next day, then bake it in a hot pot for half an hour, and longer without the lid.</p></article>
    <section class="comments"><h3>Comments</h3><div class="comment">Ann: I tried this with rye, and it was very good, thank you!</div></section></main>
    <aside><p>Subscribe to our letter</p><form><input name=e><button>Send</button></form></aside><footer><p>Imprint</p></footer></body>""",
    """<table width=100%><tr><td><a href=x>Index</a> | <a href=y>Archive</a> | <a href=z>About</a></td></tr></table>
    <div class="post-body"><p>+In the old days the mail came twice a week, on a cart, and everybody knew the driver by his name.</p><blockquote>+He never was late, not even in the winter of the great snow.</blockquote>
    <p>+When the railway was opened, he sold the horses, and began to grow apples behind the station.</p></div><div class="advertisement">Buy cheap apples now! <a href=q>Here</a></div><div class="cookie-consent">We use cookies. <button>Fine</button></div>""",
]


def test_main_text_of_layouts_written_by_hand(spark):
    """Most blocks of pages that no maker made: at least nine in ten are judged right."""
    import re

    blocks = [re.findall(r">([^<>]*[^<>\s][^<>]*)<", p.replace("\n", " ")) for p in LAYOUTS]
    table = spark.createDataFrame([(k, None, p.replace("+", "")) for k, p in enumerate(LAYOUTS)], "page_id long, url string, html string")
    got = {r.page_id: set(r.text.split("\n")) for r in mainpage.main_text(table).collect()}
    good = total = 0
    for k, own in enumerate(blocks):
        text = " ".join(got[k])
        for b in own:
            b = " ".join(b.split())
            main, total = b.startswith("+"), total + 1
            good += (b.lstrip("+") in text) == main
    assert good >= 0.9 * total, (good, total)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert {"op10_warc", "op12_audit", "op13_dialogue", "url_rules"} <= set(__spark_entry__.oracle_sql())


def test_kept_tables_can_be_removed(spark):
    from evergrain.llm import shared

    df = shared.keep(spark.range(3), "t")
    path = shared._written[-1].removeprefix("file:")
    import os

    assert df.count() == 3 and os.path.isdir(path.replace("//", "/"))
    shared._written[:] = shared._written[-1:]
    shared.clean(spark)
    assert not os.path.isdir(path.replace("//", "/"))
