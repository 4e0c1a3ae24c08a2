"""Stateful scans of whole texts, over Arrow batches: comments, fences, structured-data validity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comment_mask(line: str | None, block: tuple[str, str] | None, quotes: str = "\"'`"):
    """A UDF that blanks everything outside comments and keeps offsets and line ends. Quotes may hold comment signs."""

    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            out, i, n = [], 0, len(s)
            blank = lambda part: "".join(c if c == "\n" else " " for c in part)
            while i < n:
                if line and s.startswith(line, i):
                    j = s.find("\n", i)
                    j = n if j < 0 else j
                    out.append(s[i:j])
                elif block and s.startswith(block[0], i):
                    j = s.find(block[1], i + len(block[0]))
                    j = n if j < 0 else j + len(block[1])
                    out.append(s[i:j])
                elif s[i] in quotes:
                    j = i + 1
                    while j < n and s[j] != s[i] and (s[i] == "`" or s[j] != "\n"):
                        j += 2 if s[j] == "\\" and s[i] != "`" else 1
                    j = min(n, j + 1)
                    out.append(blank(s[i:j]))
                else:
                    j = i + 1
                    out.append(blank(s[i]))
                i = j
            return "".join(out)

        return texts.map(one)

    return mask


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fenced_lines(text: pd.Series) -> pd.Series:
    """Numbers, from 1, of the lines inside fenced code blocks; a fence closes with its own sign, at least as long."""

    def one(s):
        if s is None:
            return None
        out, fence = [], ""
        for k, row in enumerate(s.split("\n"), 1):
            t = row.strip()
            sign = t[:1]
            run = len(t) - len(t.lstrip(sign)) if sign and sign in "`~" else 0
            if fence:
                if run >= len(fence) and sign == fence[0] and t == sign * run:
                    fence = ""
                else:
                    out.append(k)
            elif run >= 3 and not (sign == "`" and "`" in t[run:]):
                fence = sign * run
        return out

    return text.map(one)


def _pairs(items):
    if len({k for k, _ in items}) != len(items):
        raise ValueError("duplicate key")
    return dict(items)


def parse_yaml(text: str):
    """A value of the subset of YAML that descriptions of services use: block maps and lists by indentation, flow lists and
    maps in JSON's form, plain and quoted scalars, literal and folded blocks, comments. Anchors, tags, tabs and documents
    after the first are refused."""
    import json

    rows = []
    for n, raw in enumerate(text.split("\n"), 1):
        body = raw.rstrip()
        if body.strip() in ("---", "...") and not rows:
            continue
        rows.append((n, len(body) - len(body.lstrip(" ")), body.strip()))
    at = 0

    def wrong(n, why):
        raise ValueError(f"line {n}: {why}")

    def bare(s):
        quote, out = "", ""
        for k, c in enumerate(s):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "#" and (k == 0 or s[k - 1] == " "):
                break
            out += c
        return out.rstrip()

    def skip():
        nonlocal at
        while at < len(rows) and (not rows[at][2] or rows[at][2].startswith("#")):
            at += 1

    def scalar(s, n):
        if not s or s in ("~", "null"):
            return None
        if s[0] in "&*!|>%@`" or s.startswith("\t"):
            wrong(n, "not in the subset")
        if s[0] in "[{":
            return json.loads(s, object_pairs_hook=_pairs)
        if s[0] == '"':
            return json.loads(s)
        if s[0] == "'":
            if len(s) < 2 or s[-1] != "'":
                wrong(n, "open quote")
            return s[1:-1].replace("''", "'")
        if s in ("true", "false"):
            return s == "true"
        try:
            return int(s) if s.lstrip("-").isdigit() else float(s) if any(c.isdigit() for c in s) and not s[0].isalpha() else s
        except ValueError:
            return s

    def block(style, indent):
        nonlocal at
        lines = []
        while at < len(rows) and (not rows[at][2] or rows[at][1] > indent):
            lines.append(rows[at])
            at += 1
        while lines and not lines[-1][2]:
            lines.pop()
        least = min((i for _, i, t in lines if t), default=0)
        return ("\n" if style[0] == "|" else " ").join(" " * (i - least) + t if t else "" for _, i, t in lines) + ("" if style.endswith("-") else "\n")

    def split(s):
        """The key and the rest of a map's line, or None."""
        if s[0] in "\"'":
            end = s.find(s[0], 1)
            return (s[1:end], s[end + 2 :].strip()) if end > 0 and s[end + 1 : end + 2] == ":" else None
        k = s.find(": ")
        return (s[:k], s[k + 2 :].strip()) if k > 0 else (s[:-1], "") if s.endswith(":") else None

    def value(rest, indent, n):
        if rest in ("|", ">", "|-", ">-"):
            return block(rest, indent)
        if rest:
            return scalar(rest, n)
        skip()
        if at < len(rows) and (rows[at][1] > indent or (rows[at][1] == indent and rows[at][2].startswith("- "))):
            return node(rows[at][1])
        return None

    def node(indent):
        nonlocal at
        skip()
        n, i, s = rows[at]
        if s == "-" or s.startswith("- "):
            out = []
            while skip() or (at < len(rows) and rows[at][1] == indent and (rows[at][2] == "-" or rows[at][2].startswith("- "))):
                n, i, s = rows[at]
                rest = bare(s[1:].strip())
                if rest and rest[0] not in "[{" and split(rest):
                    rows[at] = (n, i + 2, s[1:].strip())
                    out.append(node(i + 2))
                else:
                    at += 1
                    out.append(value(rest, i, n))
            return out
        if not split(bare(s)):
            at += 1
            return scalar(bare(s), n)
        out = {}
        while skip() or (at < len(rows) and rows[at][1] == indent and not rows[at][2].startswith("- ")):
            n, i, s = rows[at]
            pair = split(bare(s))
            if pair is None or pair[0] in out:
                wrong(n, "no pair" if pair is None else "duplicate key")
            at += 1
            out[pair[0]] = value(pair[1], i, n)
        return out

    skip()
    if at == len(rows):
        return None
    if any("\t" in raw[: len(raw) - len(raw.lstrip())] for raw in text.split("\n")):
        raise ValueError("tab in the indentation")
    out = node(rows[at][1])
    skip()
    if at < len(rows):
        wrong(rows[at][0], "bad indentation")
    return out


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """The JSON of YAML texts of the subset, keys in their order; null for what is malformed or beyond it."""
    import json

    def one(s):
        try:
            return None if s is None else json.dumps(parse_yaml(s), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, IndexError, RecursionError):
            return None

    return texts.map(one)


def _properties(s):
    keys = set()
    for row in s.splitlines():
        row = row.strip()
        if row and row[0] not in "#!":
            key = row.replace(":", "=").partition("=")[0].strip()
            if not key or key in keys:
                raise ValueError("duplicate or empty key")
            keys.add(key)


def _hcl(s):
    """Blocks and attributes: every brace and bracket closes, quotes end on their line, an attribute has a value."""
    stack, quoted = [], False
    for n, row in enumerate(s.split("\n"), 1):
        code, k = "", 0
        while k < len(row):
            c = row[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
                code += "s"
            elif c == "#" or row.startswith("//", k):
                break
            else:
                code += c
                if c in "{[(":
                    stack.append(c)
                elif c in "}])" and (not stack or stack.pop() + c not in ("{}", "[]", "()")):
                    raise ValueError(f"line {n}: unmatched {c}")
            k += 1
        if quoted:
            raise ValueError(f"line {n}: open quote")
        if code.strip().endswith("="):
            raise ValueError(f"line {n}: no value")
    if stack:
        raise ValueError("unclosed block")


def structured_problem(kind: str):
    """A UDF: null for a valid text of its kind, else what is wrong with it. Duplicate keys are wrong."""

    @F.pandas_udf(T.StringType())
    def problem(texts: pd.Series) -> pd.Series:
        import json
        import plistlib
        import tomllib
        from xml.etree import ElementTree
        from xml.parsers.expat import ExpatError

        def strict(s):
            value = json.loads(s, object_pairs_hook=_pairs)
            json.dumps(value, ensure_ascii=False).encode()  # a lone surrogate is no text
            return value

        def check(s):
            if kind == "toml":
                tomllib.loads(s)
            elif kind == "yaml":
                parse_yaml(s)
            elif kind == "properties":
                _properties(s)
            elif kind == "hcl":
                _hcl(s)
            elif kind in ("xml", "svg"):
                root = ElementTree.fromstring(s)
                if kind == "svg" and root.tag.rpartition("}")[2] != "svg":
                    raise ValueError("no svg element")
            elif kind == "plist":
                plistlib.loads(s.encode(), fmt=plistlib.FMT_XML)
            elif kind == "jsonl":
                for part in filter(str.strip, s.splitlines()):
                    strict(part)
            elif kind == "webmanifest":
                if not isinstance(strict(s), dict):
                    raise ValueError("no object")
            else:
                strict(s)

        def one(s):
            if s is None:
                return "no text"
            try:
                check(s)
            except (ValueError, RecursionError, SyntaxError, IndexError, ExpatError, plistlib.InvalidFileException) as e:
                return f"{type(e).__name__}: {e}"[:200]
            return None

        return texts.map(one)

    if kind not in ("json", "jsonl", "toml", "yaml", "properties", "hcl", "xml", "svg", "plist", "webmanifest"):
        raise ValueError(kind)
    return problem


@F.pandas_udf(T.StringType())
def web_code_mask(texts: pd.Series) -> pd.Series:
    """Code with strings, templates, comments and the text between JSX tags blanked; offsets and line ends stay. Code
    inside ${} of a template and {} of JSX is code again."""

    def one(s):
        if s is None:
            return None
        out = list(s)

        def blank(a, b):
            for k in range(a, min(b, len(s))):
                if out[k] != "\n":
                    out[k] = " "

        modes, i = ["code"], 0  # code, {: a brace in code, template, ${: code in a template, jsx: text between tags
        while i < len(s):
            c, mode = s[i], modes[-1]
            if mode == "template":
                if c == "`":
                    modes.pop()
                elif s.startswith("${", i):
                    modes.append("${")
                    i += 1
                else:
                    blank(i, i + (2 if c == "\\" else 1))
                    i += c == "\\"
            elif mode == "jsx":
                if c == "{":
                    modes.append("{")
                elif c == "<":
                    modes.pop()
                    continue
                else:
                    blank(i, i + 1)
            elif s.startswith("//", i) or s.startswith("/*", i):
                end = s.find("\n" if s[i + 1] == "/" else "*/", i + 2)
                end = len(s) if end < 0 else end + (0 if s[i + 1] == "/" else 2)
                blank(i, end)
                i = end - 1
            elif c in "\"'":
                end = i + 1
                while end < len(s) and s[end] != c and s[end] != "\n":
                    end += 2 if s[end] == "\\" else 1
                blank(i + 1, end)
                i = end
            elif c == "`":
                modes.append("template")
            elif c == "{":
                modes.append("{")
            elif c == "}" and len(modes) > 1:
                modes.pop()
            elif c == "<" and (s[i + 1 : i + 2].isalpha() or s[i + 1 : i + 2] in ("/", ">")) and not s[:i].rstrip()[-1:].isalnum():
                # a tag: on to its end, then the text behind it, unless it closes the outermost or itself
                depth, k = 0, i
                while k < len(s) and not (s[k] == ">" and depth == 0):
                    depth += (s[k] == "{") - (s[k] == "}")
                    k += 1
                if s[i + 1 : i + 2] != "/" and s[k - 1 : k] != "/" and s.find("</", k) >= 0:
                    modes.append("jsx")
                i = k
            i += 1
        return "".join(out)

    return texts.map(one)
