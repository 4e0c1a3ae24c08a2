"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A tolerant parser builds the tree of block elements and, as leaves, the runs of text between block boundaries. Every
node gets features: its tag and attribute tokens and those of its ancestors, text length, link share, punctuation, the
density of its subtree, depth, place in the page, and how it compares with its siblings and parent. One boosted model
gives each node the odds that it is, or holds, main text. Decoding picks the labels of greatest total log-likelihood under
the rule that nothing in a removed node is kept: a node that is kept has kept ancestors, one that is removed has no
kept descendant. Kept leaves, in page order, are the text.

The model is fitted on a bounded sample: ``made`` seeded pages of a grammar of layouts (with and without semantic
tags), and ``seen`` pages of the input (those of least hash, of at most ``largest`` bytes) that have an article or main element, labelled by it, and half of
them again with semantic tags made plain. Any fixed labels would do; none come from outside.

Corners: null or empty html, and pages without text, give an empty text of 0 characters; unclosed, crossed or stray tags are
repaired; text of any length and nesting of any depth is read; scripts, styles, head, noscript, comments and form controls never
give text, whatever blocks stand in them; malformed UTF-8 is read as U+FFFD; repeated rows are treated alike; a null page_id or url stays null; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted
from .shared import bounded, utf8

#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template svg math iframe object textarea select button canvas audio video map datalist".split())
RAW = frozenset("script style textarea title".split())
GROUPS = {
    "p": ["p"],
    "h": ["h1", "h2", "h3", "h4", "h5", "h6"],
    "item": ["li", "dd", "dt"],
    "cell": ["td", "th", "tr", "caption"],
    "div": ["div", "center"],
    "article": ["article"],
    "main": ["main"],
    "section": ["section", "details", "summary", "hgroup"],
    "nav": ["nav", "menu"],
    "aside": ["aside", "dialog"],
    "header": ["header"],
    "footer": ["footer", "address"],
    "form": ["form", "fieldset", "legend", "label"],
    "list": ["ul", "ol", "dl"],
    "table": ["table", "tbody", "thead", "tfoot"],
    "quote": ["blockquote", "pre"],
    "figure": ["figure", "figcaption"],
    "root": ["html", "body"],
}
#: Words in class, id and role, by what they say of an element.
TOKENS = {
    "ad": "ad ads advert adverts advertisement advertising adsense promo promotion promoted sponsor sponsored",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc menubar tabs skip",
    "foot": "footer foot copyright colophon contentinfo legal imprint",
    "head": "header masthead topbar logo branding banner hero",
    "side": "sidebar side aside rail widget widgets related recommended complementary trending popular teaser",
    "note": "cookie cookies consent gdpr notice notices alert popup modal overlay privacy warning paywall toast",
    "form": "form newsletter subscribe signup login search register poll",
    "talk": "comment comments commentlist reply replies respond discussion disqus feedback thread responses",
    "share": "share sharing social follow tags meta byline",
    "main": "article content main post entry story body text prose",
}
TAGS = {t: k for k, names in enumerate(GROUPS.values()) for t in names}
PLAIN = TAGS["div"]
_TOKEN = {w: k for k, words in enumerate(TOKENS.values()) for w in words.split()}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_DIGITS = re.compile(r"&#0*([1-9][0-9]{7,});?")
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = re.compile(r"[.,;:!?。，、]")
#: A start tag closes an open element of these, unless one of the walls lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


class Tags:
    """Tags and comments of a page, in order. A tag ends at the first > outside of quotes; where quotes never close it ends at
    the first > of all; without any > it is text. What was found once not to close is remembered, so a page is
    read in time that grows with its length, however it is broken."""

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.quotes = {q: source.rfind(q) for q in "\"'"}
        self.open: set[int] = set()  # quotes that lead to no end of a tag

    def _end(self, at: int) -> int | None:
        """The first > outside of quotes from ``at``."""
        seen = []
        while True:
            m = _STOP.search(self.source, at)
            if m and m[0] == ">":
                return m.start()
            if not m or m.start() in self.open or m.start() >= self.quotes[m[0]]:
                self.open.update(seen)
                if m:
                    self.open.add(m.start())
                return None
            seen.append(m.start())
            at = self.source.index(m[0], m.end()) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, lower-case name (empty of comments) and attributes of the first tag from ``at``."""
        s = self.source
        while (at := s.find("<", at)) >= 0:
            if s.startswith("<!--", at):
                end = s.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(s), False, "", ""
            if at > self.last:
                at = s.find("<!--", at)
                if at < 0:
                    return None
                continue
            closing = s.startswith("/", at + 1)
            m = _NAME.match(s, at + 1 + closing)
            if m:
                end = self._end(m.end())
                if end is None:
                    end = s.index(">", m.end())
                return at, end + 1, closing, m[0].lower(), s[m.end() : end]
            if s[at + 1 : at + 2] in ("!", "?"):
                return at, s.index(">", at) + 1, False, "", ""
            at += 1
        return None


def decoded(text: str) -> str:
    """Character references become characters; numbers beyond all characters become U+FFFD, however long."""
    return entities.unescape(_DIGITS.sub("\ufffd", text))


def flags(attributes: str) -> int:
    """Bits of TOKENS that class, id and role hold."""
    out = 0
    for m in _NAMED.finditer(attributes):
        for word in _PART.findall(m[1] or m[2] or m[3] or ""):
            k = _TOKEN.get(word.lower())
            if k is not None:
                out |= 1 << k
    return out


class Page:
    """Nodes in page order: parent, tag group, flags, and of leaves the text and its counts."""

    __slots__ = ("depth", "flags", "leaf", "linked", "marks", "parent", "tag", "text", "words")

    def __init__(self, source: str, plain: bool = False):
        self.parent, self.tag, self.flags, self.leaf, self.depth = [-1], [TAGS["body"]], [0], [False], [0]
        self.text, self.words, self.marks, self.linked = [""], [0], [0], [0]
        stack: list[tuple[int, str]] = [(0, "body")]
        places: dict[str, list[int]] = {"body": [0]}  # of open elements in the stack
        buffer: list[str] = []
        linked = links = 0
        silent: list[str] = []  # open elements that give no text
        names: Counter[str] = Counter()  # the same, counted
        inner: Counter[str] = Counter()  # blocks that were opened in them
        at, n, tags = 0, len(source), Tags(source)

        def flush():
            nonlocal linked
            if buffer:
                text = " ".join(decoded("".join(buffer)).split())
                buffer.clear()
                if text:
                    self._add(stack[-1][0], self.tag[stack[-1][0]], self.flags[stack[-1][0]], text, linked)
                linked = 0

        def pop():
            _, name = stack.pop()
            places[name].pop()

        def top(some: set[str]) -> int:
            return max((places[t][-1] for t in some if places.get(t)), default=-1)

        while at < n:
            found = tags.next(at)
            stop = found[0] if found else n
            if stop > at and not silent:
                buffer.append(source[at:stop])
                if links:
                    linked += stop - at
            if not found:
                break
            _, at, closing, name, attributes = found
            if not name:
                continue
            if name in SILENT:
                if name in RAW and not closing:
                    m = _ENDS[name].search(source, at)
                    end = source.find(">", m.end()) if m else -1
                    at = end + 1 if end >= 0 else n
                elif closing:
                    if names[name]:
                        while names[name]:
                            last = silent.pop()
                            names[last] -= 1
                            if last == name:
                                break
                elif not attributes.endswith("/"):
                    silent.append(name)
                    names[name] += 1
                if not silent:
                    inner.clear()
                continue
            if silent and name in TAGS:
                if closing and inner[name]:
                    inner[name] -= 1
                    continue
                # the end of a block around them, or a page's body, closes what was never closed; so does any block a head
                if name == "body" or (closing and places.get(name)) or (not closing and names["head"] == len(silent)):
                    silent.clear()
                    names.clear()
                    inner.clear()
                elif not closing:
                    inner[name] += 1
            if name == "a":
                links = 0 if closing else 1
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr", "img"):
                    buffer.append(" ")
                continue
            group = TAGS.get(name)
            if group is None or silent:
                continue  # inline, or nothing to see
            flush()
            if name in ("html", "body"):
                continue
            if closing:
                if places.get(name):
                    while stack[-1][1] != name:
                        pop()
                    pop()
                continue
            if stack[-1][1] == "p":
                pop()
            if name in CLOSES:
                like, walls = CLOSES[name]
                k = top(like)
                if k > top(walls):
                    while len(stack) > k:
                        pop()
            if plain and name in ("article", "main", "section", "nav", "aside", "header", "footer"):
                group = PLAIN
            self._add(stack[-1][0], group, flags(attributes))
            places.setdefault(name, []).append(len(stack))
            stack.append((len(self.parent) - 1, name))
        flush()

    def _add(self, parent: int, tag: int, bits: int, text: str | None = None, linked: int = 0) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.flags.append(bits)
        self.leaf.append(text is not None)
        self.depth.append(self.depth[parent] + 1)
        self.text.append(text or "")
        self.words.append(text.count(" ") + 1 if text else 0)
        self.marks.append(len(_MARKS.findall(text)) if text else 0)
        self.linked.append(min(linked, len(text)) if text else 0)


_LIKE = [TAGS[t] for t in ("article", "main", "nav", "aside", "header", "footer", "form", "table", "li")]


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, their parents (-1: a root) and the ends of their subtrees."""
    sizes = np.array([len(p.parent) for p in pages])
    offset = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    get = lambda name, kind=np.int64: np.fromiter((v for p in pages for v in getattr(p, name)), kind, sizes.sum())
    own_parent, tag, bits, leaf, depth = get("parent"), get("tag"), get("flags"), get("leaf", bool), get("depth")
    n = len(tag)
    parent = np.where(own_parent < 0, -1, own_parent + offset)
    # nodes are in page order: a subtree is a run, which ends where the next node of no greater depth begins
    end = np.full(n, n)
    stack: list[int] = []
    for k, d in enumerate(depth.tolist()):
        while stack and depth[stack[-1]] >= d:
            end[stack.pop()] = k
        stack.append(k)
    run = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[end] - c[:-1]
    chars = np.fromiter((len(t) for p in pages for t in p.text), np.int64, n)
    text, words, marks, linked, leaves = run(chars), run(get("words")), run(get("marks")), run(get("linked")), run(leaf)
    up = np.maximum(parent, 0)
    above = np.zeros(n, np.int64)  # tokens of ancestors
    like = np.zeros(n, np.int64)  # kinds of ancestors, and own
    kinds = np.zeros(len(GROUPS), np.int64)
    kinds[_LIKE] = 1 << np.arange(len(_LIKE))
    level = np.argsort(depth, kind="stable")
    for part in np.split(level, np.flatnonzero(np.diff(depth[level])) + 1) if n else []:
        inner = parent[part] >= 0
        above[part] = np.where(inner, above[up[part]] | bits[up[part]], 0)
        like[part] = np.where(inner, like[up[part]], 0) | kinds[tag[part]]
    brothers = np.bincount(up, parent >= 0, n)
    total, roots = text[np.maximum(offset, 0)], offset
    before = np.concatenate([[0], np.cumsum(chars)])[:-1] - np.concatenate([[0], np.cumsum(chars)])[:-1][roots]
    mean = text[up] / np.maximum(brothers[up], 1)
    ahead = np.where(parent == np.roll(parent, 1), np.roll(text, 1), 0)
    safe = np.maximum(text, 1)
    count = lambda g: run((tag == TAGS[g]) & ~leaf)
    cols = [leaf, np.log1p(text), np.log1p(words), linked / safe, marks / np.maximum(words, 1), text / np.maximum(words, 1)]
    cols += [np.minimum(depth, 40), before / np.maximum(total, 1), text / np.maximum(total, 1), text / np.maximum(text[up], 1), linked[up] / np.maximum(text[up], 1)]
    cols += [np.log1p(end - np.arange(n)), (end - np.arange(n)) / safe, np.log1p(text / np.maximum(leaves, 1)), np.log1p(count("p")), np.log1p(count("li")), np.log1p(count("h1"))]
    cols += [np.log1p(brothers[up]), np.log1p(mean), text / np.maximum(mean, 1), np.log1p(ahead)]
    cols += [(tag == g) for g in range(len(GROUPS))]
    cols += [(bits >> k) & 1 for k in range(len(TOKENS))] + [(above >> k) & 1 for k in range(len(TOKENS))]
    cols += [(like >> k) & 1 for k in range(len(_LIKE))]
    return np.stack([np.asarray(c, dtype=np.float32) for c in cols], 1), parent, end


def decode(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Kept nodes: the labels of greatest total log-likelihood with no kept node under a removed one."""
    keep, gone = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    up = parent.tolist()
    best, out = keep.tolist(), gone.tolist()  # of the subtree: the node kept, and all of it removed
    for k in range(len(up) - 1, -1, -1):
        if up[k] >= 0:
            best[up[k]] += max(best[k], out[k])
            out[up[k]] += out[k]
    kept = np.zeros(len(up), dtype=bool)
    for k, p in enumerate(up):
        kept[k] = (p < 0 or kept[p]) and best[k] > out[k]
    return kept


def extract(model: Boosted, sources: list[str]) -> list[str]:
    pages = [Page(s) for s in sources]
    x, parent, _ = features(pages)
    step = 1 << 16  # nodes at a time: bounds memory for any page
    odds = [model.log_odds(x[lo : lo + step]) for lo in range(0, len(x), step)]
    kept = decode(np.concatenate(odds) if odds else np.zeros(0), parent)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        out.append("\n".join(t for t, good in zip(p.text, kept[at : at + n], strict=True) if good and t))
        at += n
    return out


_MARK = ""


class Maker:
    """Seeded pages of a grammar of layouts; what is main text begins with a private mark."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def language(self) -> None:
        """The words of a page: drawn syllables, some with a mark behind them."""
        r = self.r
        syllables = [r.choice("bcdfghlmnprstvwäéñ") + r.choice("aeiouy") for _ in range(24)]
        self.pool = ["".join(r.choices(syllables, k=r.randint(1, 4))) + (r.choice(",.") if r.random() < 0.14 else "") for _ in range(200)]

    def say(self, low: int, high: int, mark: str = "") -> str:
        r = self.r
        return mark + " ".join(r.choices(self.pool, k=r.randint(low, high))).capitalize() + ("." if high > 6 and r.random() < 0.9 else "")

    def box(self, tags: list[str], names: list[str], inner: str) -> str:
        r = self.r
        tag = r.choice(tags)
        named = tag in ("div", "section", "ul", "ol", "p") or r.random() < 0.5
        attribute = f' {r.choice(["class", "id"])}="{r.choice(["", "", "page-", "site-", "c "])}{r.choice(names)}{r.choice(["", "", "-1", "-box", " wrap"])}"' if named else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.say(1, 4)}</a>' for k in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else r.choice([" | ", " "]).join(items)

    def paragraphs(self, low: int, high: int, mark: str = "", words: tuple[int, int] = (3, 120)) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            text = self.say(r.choice([1, words[0]]), r.choice([words[0] + 4, words[1]]), mark)
            out.append(r.choice([f"<p>{text}</p>"] * 5 + [f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href='/x'>{self.say(1, 3)}</a> {self.say(2, 9)}</p>"]))
        return "".join(out)

    def waste(self, kind: str) -> str:
        r, box = self.r, self.box
        if kind == "nav":
            return box(["nav", "div", "ul"], ["nav", "menu", "navbar", "breadcrumbs", "pagination"], self.links(3, 12))
        if kind == "header":
            return box(["header", "div"], ["header", "masthead", "topbar"], self.say(1, 5) + (self.links(2, 6) if r.random() < 0.5 else self.paragraphs(0, 1, words=(2, 14))))
        if kind == "footer":
            return box(["footer", "div"], ["footer", "copyright", "colophon"], r.choice(["&copy; ", ""]) + self.say(1, r.choice([8, 16, 40])) + (self.links(2, 6) if r.random() < 0.4 else "") + self.paragraphs(0, 1, words=(3, 24)))
        if kind == "side":
            return box(["aside", "div"], ["sidebar", "related", "widget", "rail"], f"<h3>{self.say(1, 4)}</h3>" + self.paragraphs(0, 3, words=(3, 40)) + self.links(0, 6))
        if kind == "notice":
            return box(["div", "section", "p"], ["cookie-notice", "consent", "notice", "alert", "popup"], self.say(4, 40) + (f"<button>{self.say(1, 2)}</button>" if r.random() < 0.5 else ""))
        if kind == "ad":
            return box(["div", "aside", "p"], ["ad", "ads", "advert", "sponsored", "promo"], self.say(2, 40))
        if kind == "form":
            return box(["form", "div"], ["newsletter", "search", "login", "subscribe"], f"<label>{self.say(1, 5)}</label><input name=q>" + self.paragraphs(0, 1, words=(3, 20)) + f"<button>{self.say(1, 2)}</button>")
        if kind == "share":
            return box(["div", "ul"], ["share", "social"], self.links(2, 5))
        each = "".join(box(["div", "li", "article"], ["comment", "reply"], self.say(1, 3) + self.paragraphs(1, 2, words=(3, 60))) for _ in range(r.randint(1, 5)))
        return box(["section", "div", "ol"], ["comments", "responses", "commentlist", "discussion"], f"<h2>{self.say(1, 3)}</h2>" + each)

    def page(self) -> str:
        r = self.r
        self.language()
        some = lambda *kinds: "".join(self.waste(k) for k in kinds if r.random() < 0.5)
        body = "" if r.random() < 0.15 else f"<h1>{self.say(2, 12, _MARK)}</h1>"
        body = r.choice([body, f"<header>{body}</header>"]) if body and r.random() < 0.2 else body
        short = r.random() < 0.35
        for _ in range(1 if short else r.randint(1, 4)):
            body += self.paragraphs(1, 1, _MARK, (1, 12)) if short else self.paragraphs(1, 6, _MARK)
            body += r.choice(["", "", "", f"<h2>{self.say(1, 7, _MARK)}</h2>", f"<blockquote>{self.say(5, 40, _MARK)}</blockquote>", "<ul>" + "".join(f"<li>{self.say(2, 20, _MARK)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", "<table>" + f"<tr><td>{self.say(1, 4, _MARK)}</td><td>{self.say(1, 4, _MARK)}</td></tr>" * 3 + "</table>", self.waste(r.choice(["ad", "share", "form", "side"]))])
        if r.random() < 0.25:
            body += self.waste("talk")
        main = self.box(["article", "article", "main", "div", "section"], ["content", "article", "post", "entry", "main", "story", "x1"], body)
        main = self.box(["main", "div"], ["wrapper", "page", "container", "content"], some("nav", "ad") + main + some("side", "talk")) if r.random() < 0.4 else main
        after = some("ad", "side", "talk", "form", "notice") + (self.waste("footer") if r.random() < 0.8 else "")
        whole = some("notice", "header", "ad") + (self.waste("nav") if r.random() < 0.8 else "") + some("ad", "side", "form") + main + after
        head = '<head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var a="</p>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{whole}" + ("</body></html>" if r.random() < 0.9 else "")


def _labelled(sources: list[str], marked: bool) -> Iterator[tuple[Page, np.ndarray]]:
    """Pages with a label for every node: whether it is, or holds, main text."""
    body, removed = {TAGS["article"], TAGS["main"]}, {TAGS[t] for t in ("nav", "aside", "footer", "form")}
    noise = sum(1 << k for k, name in enumerate(TOKENS) if name not in ("main", "head"))
    for source in sources:
        p = Page(source)
        n = len(p.parent)
        good, inside = np.zeros(n, dtype=bool), [False] * n
        for k in range(1, n):
            up = p.parent[k]
            if marked:
                good[k] = p.leaf[k] and _MARK in p.text[k]
                p.text[k] = p.text[k].replace(_MARK, "")
            else:
                inside[k] = (inside[up] or p.tag[k] in body) and p.tag[k] not in removed and not p.flags[k] & noise
                good[k] = inside[k] and p.leaf[k]
        for k in range(n - 1, 0, -1):
            good[p.parent[k]] |= good[k]
        yield p, good


def train(seen: list[str], made: int, seed: int = 5) -> Boosted:
    maker = Maker(seed)
    own = [maker.page() for _ in range(made)]
    rows = [*_labelled(own, True), *((p, y) for p, y in _labelled(seen, False) if y.any())]
    for source, (_, y) in zip(seen[::2], list(_labelled(seen[::2], False)), strict=True):
        if y.any():
            rows.append((Page(source, plain=True), y))
    x, _, _ = features([p for p, _ in rows])
    return Boosted(trees=48).fit(x, np.concatenate([y for _, y in rows]).astype(float))


def sample(own: DataFrame, seen: int, largest: int) -> list[str]:
    """Pages of least hash that have an article or main element, of at most ``largest`` bytes: their hashes first, so that
    what reaches the driver is bounded in bytes, not in rows alone."""
    share = int(min(1.0, 20 * seen / max(1, own.count())) * (1 << 30))
    mix = F.xxhash64("page_id", "url")
    some = own.filter((F.pmod(mix, F.lit(1 << 30)) < share) & (F.octet_length("html") <= largest) & F.lower(F.col("html").cast("string")).rlike("<(article|main)[ >]"))
    chosen = [r.h for r in some.select(mix.alias("h")).distinct().orderBy("h").limit(seen).collect()]
    if not chosen:
        return []
    got = some.filter(mix.isin(chosen)).groupBy(mix.alias("h")).agg(F.min("html").alias("html")).collect()
    return [bytes(r.html).decode("utf-8", "replace") for r in sorted(got, key=lambda r: r.h)]


def main_text(pages: DataFrame, made: int = 400, seen: int = 60, largest: int = 1 << 17, batch: int = 200) -> DataFrame:
    """page_id, url, text, n_chars of every row; no shuffle beside the sample's."""
    own = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8("html").alias("html"))
    model = train(sample(own, seen, largest), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                text = extract(model, [x.as_py().decode("utf-8", "replace") for x in part.column("html")])
                yield pa.RecordBatch.from_pydict({"page_id": part.column("page_id"), "url": part.column("url"), "text": text, "n_chars": [len(t) for t in text]})

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
