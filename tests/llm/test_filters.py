"""URL filters, the filter audit and the repair of conversations, against plain forms of the same rules."""

import hashlib
import heapq
import itertools
import random
import zlib

from evergrain.llm import audit, dialogue, urls

from .common import corpus, frame

URLS = "page_id long, url string, html string, host string, path string, rule string, score string"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def pages(spark, given):
    return spark.createDataFrame([(k, u, "h", "x", "y", "z", "s") for k, u in enumerate(given)], URLS).repartition(3)


def test_url_parts_and_rules():
    rules = urls.Rules(RULES | {"b.example.net/en/x": "block", "example.net/en/x": "allow"})
    cases = {
        "https://A.Example.NET/en/x?q=1#f": ("a.example.net", "/en/x", "example.net/en/x"),
        "https://b.example.net/en/xy": ("b.example.net", "/en/xy", "b.example.net/en/x"),
        "http://example.net/EN/": ("example.net", "/EN/", "net/"),
        "http://notexample.net/en/": ("notexample.net", "/en/", "net/"),
        "http://a.net": ("a.net", "", None),
        "http://a.net?x=/": ("a.net", "", None),
        "http://a.net#/": ("a.net", "", None),
        "x://org/fr/": ("org", "/fr/", "org/fr/"),
        "http://xorg/fr/": ("xorg", "/fr/", None),
        "http://a.org/fr": ("a.org", "/fr", None),
        "http://a.org:80/fr/": ("a.org:80", "/fr/", None),
        "a://b.org/x://c.org/fr/": ("b.org", "/x://c.org/fr/", None),
        "no scheme": ("", "", None),
        "": ("", "", None),
        "http://ÄB.com/de/": ("Äb.com", "/de/", None),
        "http://" + "a." * 50_000 + "net/" + "x" * 100_000: ("a." * 50_000 + "net", "/" + "x" * 100_000, "net/"),
    }
    for url, (host, path, rule) in cases.items():
        assert urls.split(url)[:2] == (host, path)
        assert rules.find(host, path)[0] == rule
    assert urls.Rules({}).find("a.b", "/") == (None, None)
    assert urls.split("http://h/p?a=b&c#d")[2:] == ("a=b&c", "d") and urls.split("http://h#d?e")[2:] == ("", "d?e")


def _made(rng, n):
    """Urls that are blocked if their host is long and full of digits, some of them under rules."""
    out = []
    for _ in range(n):
        bad = rng.random() < 0.5
        name = "".join(rng.choice("0123456789" if bad and rng.random() < 0.7 else "abcdefgh") for _ in range(rng.randint(9, 20) if bad else rng.randint(3, 9)))
        out.append((f"http://{name}.{rng.choice(['xyz', 'com', 'fr'])}/{'/'.join(rng.choice(['a', 'bb', 'c1']) for _ in range(rng.randint(0, 3)))}" + ("?a=1&b=2" if rng.random() < 0.3 else ""), bad))
    return out


def test_urls_learn_from_labels(spark):
    known, new = _made(random.Random(1), 1500), _made(random.Random(2), 400)
    labels = spark.createDataFrame([*known, *known[:300], ("http://none/", None)], "url string, blocked boolean")
    got = urls.judge(pages(spark, [u for u, _ in new]), {}, labels, rows=800).collect()
    right = sum((r.verdict == "block") == new[r.page_id][1] for r in got)
    assert len(got) == 400 and right >= 360
    again = urls.judge(pages(spark, [u for u, _ in new]), {}, labels, rows=800).collect()
    assert sorted(got) == sorted(again)


def test_urls_learn_from_rules_and_corners(spark):
    given = [f"http://{'pills' if k % 2 else 'news'}{k % 7}.{'net' if k % 2 else 'org'}/{'de' if k % 2 else 'fr'}/{k}" for k in range(300)]
    given += [None, "", "no scheme", "http://pills3.info/de/7", "http://a.net", *["http://news0.org/fr/0"] * 3]
    table = pages(spark, given)
    got = {r.page_id: r for r in urls.judge(table, RULES, rows=100).collect()}
    assert len(got) == len(given)
    for k, url in enumerate(given):
        host, path = urls.split(url or "")[:2]
        rule, verdict = urls.Rules(RULES).find(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule) and got[k].verdict in ("block", "allow")
        assert verdict in (None, got[k].verdict)
    assert len({(got[k].verdict, got[k].score) for k in range(len(given) - 3, len(given))} | {(got[0].verdict, got[0].score)}) == 1
    assert {r.verdict for r in urls.judge(table, {}).collect()} == {"allow"}
    only = {r.verdict for r in urls.judge(table, {"net/": "block"}).collect() if r.rule is None}
    assert only == {"block"}
    assert urls.judge(table.limit(0), RULES).count() == 0
    torn = table.sparkSession.sql("SELECT CAST(NULL AS BIGINT) AS page_id, CAST(x'687474703a2f2f61ff2e6e65742f' AS STRING) AS url")
    (r,) = urls.judge(torn, RULES).collect()
    assert (r.page_id, r.host, r.rule, r.verdict) == (None, "a�.net", "net/", "block")


def test_suffix_statistics_count_every_labelled_url(spark):
    """One url in a third of all rows, and more suffixes than counters: counts are those of a plain loop."""
    rng = random.Random(5)
    rows = [(f"http://h{rng.randrange(9000)}.{rng.choice('abc')}/x", rng.random() < 0.3) for _ in range(3000)] + [("http://hot.a/x", True)] * 1500
    stats = urls.statistics(urls._labelled(None, None, spark.createDataFrame(rows, "url string, blocked boolean").repartition(5)))
    seen = {}
    for url, blocked in rows:
        for at in urls.suffixes(*urls.split(url)[:2]):
            n = seen.setdefault((urls.fold(url.encode()), at), [0, 0])
            n[0] += 1
            n[1] += blocked
    assert all((stats.seen[k], stats.blocked[k]) == tuple(v) for k, v in seen.items()) and stats.seen.sum() == 5 * len(rows)


def _brute_audit(rows, labels):
    smallest = {}
    for r in rows:
        if r[0] is not None:
            smallest[r[1] or ""] = min(smallest.get(r[1] or "", r[0]), r[0])
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    parts = {}
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = [w for w in text.translate(str.maketrans("\t\n\r\x0b\f", "     ")).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and smallest[text] < doc,
        }
        parts.setdefault(lang or "", []).append((frozenset(k for k, v in fails.items() if v), doc is not None and doc in good, doc is not None and doc in toxic))
    out, removed = set(), {}
    for part, docs in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, own in enumerate(order, 1):
                here = [d for d in left if own in d[0]]
                left = [d for d in left if own not in d[0]]
                removed[part, own] = removed.get((part, own), 0) + len(here)
                fails = [d for d in docs if own in d[0]]
                out.add((part, "".join(order), step, len(left), len(here), len(fails) - len(here), sum(len(d[0]) == 1 for d in fails), sum(d[1] for d in here), sum(d[2] for d in here)))
    return {(*r, removed[r[0], r[1][r[2] - 1]]) for r in out}


def test_audit_against_brute_force(spark):
    rows = corpus(90, seed=4)
    rng = random.Random(3)
    long = " ".join(f"w{k}" for k in range(120))
    more = [long] * 80 + [long + " $"] * 3 + ["Ä B"] * 3 + [long.upper()] * 2 + ["w " * 120] + [None, "", "", " "] + ["SHOUT\x0b& \x1cé"]
    rows += [(rng.choice([None, *range(1000, 1040)]), t, rng.choice(["en", "", None]), "a", 1, "x", 1, "y", 0) for t in more]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.7]
    labels += labels[:20] + [(10**6, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for parts in (1, 4, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = audit.audit(frame(spark, rows).withColumn("mask", audit.F.lit(1)).withColumn("run", audit.F.lit("r")), table).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert {tuple(r) for r in got} == _brute_audit(rows, labels) and len(got) == len(set(got))
    none = frame(spark, rows).limit(0)
    assert audit.audit(none, table).count() == 0
    assert {tuple(r) for r in audit.audit(frame(spark, rows), table.limit(0)).collect()} == _brute_audit(rows, [])


def test_audit_texts_of_one_fingerprint():
    """Texts whose fingerprints meet are told apart, inside a range and at its borders."""
    import pyarrow as pa

    def run(rows):
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((d, "p", 7, t) for d, t in rows), strict=True)], names=["doc_id", "part", "fp", "text"])
        return [r for b in audit._masks(iter([batch]), lambda raw: 0) for r in b.to_pylist()]

    got = run([(1, b"a"), (3, b"a"), (2, b"b"), (2, b"b"), (None, b"b")])
    assert [(r["doc_id"], r["mask"], r["run"] is not None) for r in got if not r["head"]] == [(1, 0, True), (3, 16, False), (2, 0, True), (2, 0, True), (None, 0, False)]
    assert {(r["run"], r["doc_id"]) for r in got if r["head"]} == {(hashlib.sha256(b"a").digest(), 1), (hashlib.sha256(b"b").digest(), 2)}


TALK = "conv_id long, turn long, role string, text string, audit string, part string, seg int"


def _damaged(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
        out[conv] += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def _brute_repair(rows):
    """Least cost, then least audit, over all edits, by search; the grammar is a pattern here."""
    white, seen, faults = " \t\n\r\x0b\f", set(), []
    for _, role, text in rows:
        if not text.strip(white):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if text.strip(white)[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, k, last, out = heapq.heappop(heap)
        if (k, last) in done:
            continue
        if k == len(rows) and last in ("", "a"):
            break
        done.add((k, last))
        fits = lambda i, last=last: (i == "s" and last == "") or (i == "u" and last in ("", "s", "a")) or (i == "a" and last == "u")
        for name in ("user", "assistant"):
            if fits(name[0]):
                heapq.heappush(heap, (cost + 3, edits + "I", k, name[0], (*out, f"{name}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, edits + "D", k + 1, last, out))
            if faults[k] not in ("blank", "duplicate"):
                late = 3 if faults[k] == "truncated" else 0
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + late, edits + "K", k + 1, role[:1], (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if fits(name[0]):
                        heapq.heappush(heap, (cost + 3 + late, edits + "R", k + 1, name[0], (*out, f"{name}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _talks(seed, n):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Hello.", "hello", "what?", "yes! ", "", " \t", None, "né.", "a\nb.", "x" * 70 + rng.choice("ab.")])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "admin", "éve"])
    rows = [(c if c else None, rng.choice([None, *range(6)]) if c % 3 else t, role() if c % 2 else ["user", "assistant"][t % 2], text(), "x", "y", 1) for c in range(n) for t in range(rng.randint(1, 9))]
    return rows + rows[:9]


def test_dialogue_against_brute_force(spark, monkeypatch):
    rows = _talks(1, 120)
    rng = random.Random(2)
    rows += [(5000, t, rng.choice(["user", "assistant", "system", "x"]), f"{rng.randrange(90)}{rng.choice(['.', '', '!'])}", "x", "y", 1) for t in range(400)]
    rows += [(6000, 1, "user", "same.", "x", "y", 1)] * 100
    want = {c: _brute_repair(r) for c, r in _damaged(rows).items()}
    table = spark.createDataFrame(rows, TALK).repartition(3)
    for segment, parts in ((4096, 4), (3, 4), (7, 40)):
        monkeypatch.setattr(dialogue, "SEGMENT", segment)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = dialogue.repair(dialogue.damage(table)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    assert dialogue.repair(dialogue.damage(table.limit(0))).count() == 0


def test_dialogue_cases():
    """The least audit of equal costs, and audits that begin alike."""
    chart = dialogue.Chart()

    def parse(roles, texts=None):
        rows = [(k, r, (texts or ["t."] * 99)[k] + ("" if texts else str(k) + ".")) for k, r in enumerate(roles)]
        got = dialogue._whole(chart, [r[0] for r in rows], [r[1].encode() for r in rows], [r[2].encode() for r in rows])
        assert got == _brute_repair(rows)
        return got[5], got[6]

    assert parse([]) == (0, "")
    assert parse(["system"]) == (4, "D")
    assert parse(["system", "user", "assistant"]) == (0, "KKK")
    assert parse(["user"]) == (3, "KI")
    assert parse(["assistant"]) == (3, "IK")
    assert parse(["user", "user"]) == (3, "KR")
    for n in range(1, 6):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            parse(list(roles))


def test_long_conversation_of_long_rows(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t} " + "long " * 20_000 + ".", "x", "y", 1) for t in range(120)]
    (got,) = dialogue.repair(spark.createDataFrame(rows, TALK)).collect()
    assert tuple(got)[1:] == _brute_repair([(r[1], r[2], r[3]) for r in rows]) and got.cost == 0
