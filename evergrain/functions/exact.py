"""Functions with no built-in form, over Arrow batches: canonical JSON, UTF-8 repair, HMAC sets, VLQ, line diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, no spaces, ASCII only. Floats, duplicate keys and trailing text give null."""
    import json

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate key")
        return out

    def floats(_):
        raise ValueError("float")

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x, object_pairs_hook=pairs, parse_float=floats, parse_constant=floats), sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def repair_utf8(raw: pd.Series) -> pd.Series:
    """Bytes as text; every malformed run becomes U+FFFD as in Python's errors=replace."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def decode_vlq(text: pd.Series) -> pd.Series:
    """Numbers of a base64 VLQ segment; null for a malformed one."""
    digits = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}

    def one(s):
        if s is None:
            return None
        out, value, shift = [], 0, 0
        for c in s:
            d = digits.get(c)
            if d is None or shift > 30:
                return None
            value |= (d & 31) << shift
            if d & 32:
                shift += 5
            else:
                out.append(-(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
        return None if shift else out

    return text.map(one)


def environment_digest(key: bytes):
    """HMAC-SHA256 over a name-to-value map in name order, each part framed by its length; a null value gives null."""
    if len(key) < 16:
        raise ValueError("the key is too short")

    @F.pandas_udf(T.StringType())
    def digest(names: pd.Series) -> pd.Series:
        import hmac

        def one(m):
            m = None if m is None else dict(m)
            if m is None or any(v is None for v in m.values()):
                return None
            mac = hmac.new(key, digestmod="sha256")
            for k in sorted(m):
                for part in (k.encode(), hmac.new(key, m[k].encode(), "sha256").digest()):
                    mac.update(len(part).to_bytes(8, "big") + part)
            return mac.hexdigest()

        return names.map(one)

    return digest


@F.pandas_udf(T.StringType())
def apply_hunks(old: pd.Series, hunks: pd.Series) -> pd.Series:
    """The new text: hunks (old_start, lines taken, lines put) in ascending order on the lines of the old one; null where a hunk
    does not stand on the lines that it takes, or meets the one before it."""

    def one(text, parts):
        if text is None or parts is None:
            return None
        lines, out, at = text.split("\n"), [], 0
        for h in parts:
            start, gone, new = h["start"] - 1, list(h["gone"]), list(h["new"])
            if start < at or lines[start : start + len(gone)] != gone:
                return None
            out += lines[at:start] + new
            at = start + len(gone)
        return "\n".join(out + lines[at:])

    return pd.Series([one(t, p) for t, p in zip(old, hunks, strict=True)])


#: What apply_hunks takes.
HUNKS = "array<struct<start:int,gone:array<string>,new:array<string>>>"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("line", "column", "source", "source_line", "source_column", "name")])))
def source_positions(mappings: pd.Series) -> pd.Series:
    """Positions of a source map's mappings: lines part at semicolons, segments at commas, every field but the column counts
    on from the one before it in the whole map; null for a malformed map."""
    digits = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}

    def numbers(segment):
        out, value, shift = [], 0, 0
        for c in segment:
            d = digits[c]
            value |= (d & 31) << shift
            shift += 5
            if not d & 32:
                out.append(-(value >> 1) if value & 1 else value >> 1)
                value = shift = 0
            elif shift > 30:
                raise ValueError(segment)
        if shift or len(out) not in (1, 4, 5):
            raise ValueError(segment)
        return out

    def one(text):
        if text is None:
            return None
        out, run = [], [0, 0, 0, 0]
        try:
            for n, line in enumerate(text.split(";"), 1):
                column = 0
                for segment in filter(None, line.split(",")):
                    got = numbers(segment)
                    column += got[0]
                    for k, x in enumerate(got[1:]):
                        run[k] += x
                    full = len(got) > 1
                    out.append({"line": n, "column": column, "source": run[0] if full else None, "source_line": run[1] if full else None, "source_column": run[2] if full else None, "name": run[3] if len(got) == 5 else None})
        except (KeyError, ValueError):
            return None
        return out

    return mappings.map(one)
