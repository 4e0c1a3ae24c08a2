"""Repair of conversations by an error-correcting Earley parser over roles.

The grammar of roles is right-linear: Talk -> system Open | user Reply | (nothing); Open -> user Reply;
Reply -> assistant More; More -> user Reply | (nothing). Error productions give every expected role two more ways to be met
(rerole a row, insert an empty one; system knows neither) and let every item skip a row (delete). Predicted nonterminals stand
last in their productions, so they are entered by tail calls and every item starts at the first row: a column of
the chart has one item per expected nonterminal, with the least (cost, audit) of the rows so far. A complete
column is one whose item may end; its audit, the initials of its edits (Keep, Rerole, Delete, Insert), is the repair.

Audits are compared without being kept: between two rows an audit grows by a block, inserts and then one edit that consumes
the row, and no block begins another. So items of a column are ranked by the rank of their parent and their block, and
chains of blocks are followed back only for the item that won. Columns relative to their least cost are few, and known after
their first appearance.

Scale: rows are range-partitioned by conversation and turn and read as a stream. A conversation that begins and ends inside
one task and within ``SEGMENT`` rows is repaired there. Others, at most two a task beside the long ones, are cut into
segments of bounded rows and bytes. Each segment gives, for each item it may be entered with, the items it leaves and their costs
and ranks; those small tables are folded per conversation, and then each segment is repaired by itself, knowing how it is entered and left.
Only the digest and the audit, both of them one value by contract, are put together in one task, as a stream.

Corners: null roles and texts are one space; a null conv_id is a conversation of its own; turns may be null (first), repeat
or leave gaps; rows of one turn stand by role and text, as far as their first 64 characters tell; roles count by their first character, and one that is
none of s, u and a can only be reroled or deleted; very long rows and conversations are read whole; an empty table has no
conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, keep

#: Rows and bytes of a segment.
SEGMENT, SEGMENT_BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
CUT = 3  # what a truncated row adds if it stays
#: What each nonterminal expects: roles and what is expected after them.
GRAMMAR = {"Talk": {"s": "Open", "u": "Reply"}, "Open": {"u": "Reply"}, "Reply": {"a": "More"}, "More": {"u": "Reply"}}
NAMES = list(GRAMMAR)
ENDS = {"Talk", "More"}
ROLES = {"u": b"user", "a": b"assistant"}
_LEGAL = {b"su", b"ua", b"au"}
OK, TRUNCATED, GONE = range(3)

#: An item: the nonterminal that is expected, by number, and its cost; a column: items by the rank of their audits.
Column = tuple[tuple[int, int], ...]


def _inserted(at: str) -> dict[str, int]:
    """Nonterminals that inserts alone lead to, with the least number of them."""
    got, todo = {at: 0}, [at]
    for x in todo:
        for role, y in GRAMMAR[x].items():
            if role in ROLES and y not in got:
                got[y] = got[x] + 1
                todo.append(y)
    return got


def _moves(initial: str, fault: int) -> list[dict[int, tuple[int, str]]]:
    """For each item, the items that consuming one row can lead to, each with its least (cost, block)."""
    out = []
    for x in GRAMMAR:
        best: dict[int, tuple[int, str]] = {}
        for z, k in _inserted(x).items():
            ways = [(z, DELETE, "D")]
            if fault != GONE:
                late = CUT if fault == TRUNCATED else 0
                ways += [(y, (KEEP if role == initial else REROLE) + late, "K" if role == initial else "R") for role, y in GRAMMAR[z].items() if role == initial or role in ROLES]
            for y, cost, edit in ways:
                y_at, way = NAMES.index(y), (INSERT * k + cost, "I" * k + edit)
                best[y_at] = min(best.get(y_at, way), way)
        out.append(best)
    return out


_MOVES = [_moves(i, f) for i in ("s", "u", "a", "") for f in (OK, TRUNCATED, GONE)]
_ENDING = [min((k for z, k in _inserted(x).items() if z in ENDS), default=None) for x in GRAMMAR]


class Chart:
    """Columns of the chart, remembered by the column before and the row's code."""

    def __init__(self) -> None:
        self.known: dict[tuple[Column, int], tuple[int, Column, dict[int, tuple[int, str]]]] = {}

    def step(self, column: Column, code: int) -> tuple[int, Column, dict[int, tuple[int, str]]]:
        """The least cost added, the next column relative to it, and where its items come from."""
        got = self.known.get((column, code))
        if got is None:
            best: dict[int, tuple[int, int, str, int]] = {}
            for rank, (x, cost) in enumerate(column):
                for y, (more, block) in _MOVES[code][x].items():
                    way = (cost + more, rank, block, x)
                    best[y] = min(best.get(y, way), way)
            least = min(w[0] for w in best.values())
            order = sorted(best, key=lambda y: best[y][1:3])
            got = least, tuple((y, best[y][0] - least) for y in order), {y: (w[3], w[2]) for y, w in best.items()}
            self.known[column, code] = got
        return got

    def run(self, codes: bytes, column: Column) -> tuple[int, Column, list[dict[int, tuple[int, str]]]]:
        cost, back = 0, []
        for code in codes:
            more, column, parents = self.step(column, code)
            cost += more
            back.append(parents)
        return cost, column, back

    def blocks(self, codes: bytes, entered: int, left: int) -> list[str]:
        """Edits of each row of the best way from one item to another."""
        _, _, back = self.run(codes, ((entered, 0),))
        out = []
        for parents in reversed(back):
            left, block = parents[left]
            out.append(block)
        return out[::-1]


def complete(column: Column) -> tuple[int, int, int]:
    """Cost, item and last inserts of the best way to end."""
    cost, _, x, k = min((cost + INSERT * _ENDING[x], rank, x, _ENDING[x]) for rank, (x, cost) in enumerate(column) if _ENDING[x] is not None)
    return cost, x, k


def repaired(entered: int, blocks: Iterable[str], roles: list[bytes], texts: list[bytes]) -> Iterator[bytes]:
    """The rows that the edits leave, as role:text. More blocks than rows: inserts at the end."""
    at = NAMES[entered]
    for k, block in enumerate(blocks):
        for edit in block:
            if edit == "D":
                continue
            own = roles[k][:1].decode("latin-1") if edit == "K" else ""
            role = own if edit == "K" else next(r for r in GRAMMAR[at] if r in ROLES)
            yield (roles[k] if edit == "K" else ROLES[role]) + b":" + (b"" if edit == "I" else texts[k])
            at = GRAMMAR[at][role]


class Summary:
    """What is counted of rows in order; summaries of neighbours add up."""

    FIELDS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")

    def __init__(self, **given):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.__dict__.update(given)

    def add(self, other: Summary) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if other.first is not None:
            self.illegal += self.last is not None and (self.last + other.first).encode("latin-1") not in _LEGAL
            self.first = other.first if self.first is None else self.first
            self.last = other.last
        if other.turns:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    @property
    def gaps(self) -> int:
        return min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0


def read(turns: list[int | None], roles: list[bytes], texts: list[bytes], seen: set[bytes]) -> tuple[bytes, Summary]:
    """Codes of rows in order, and their summary; ``seen`` holds digests of rows that stood before, and gets theirs."""
    codes, s = bytearray(), Summary()
    before: bytes | None = None
    for turn, role, text in zip(turns, roles, texts, strict=True):
        own, fault = role[:1], OK
        if not text.strip():
            s.blank += 1
            fault = GONE
        else:
            name = digest(role, text)
            if name in seen:
                s.duplicate += 1
                fault = GONE
            else:
                seen.add(name)
                if text.rstrip()[-1:] not in (b".", b"!", b"?"):
                    s.truncated += 1
                    fault = TRUNCATED
        codes.append(3 * b"sua".find(own) + fault if own and own in b"sua" else 9 + fault)
        s.illegal += before is not None and before + own not in _LEGAL
        s.first = own.decode("latin-1") if s.first is None else s.first
        before = own
        if turn is not None and turn != s.high:
            s.low = turn if s.low is None else s.low
            s.high = turn
            s.turns += 1
    s.last = before.decode("latin-1") if before is not None else None
    return bytes(codes), s


def digest(role: bytes, text: bytes) -> bytes:
    return hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: A repaired conversation (part is null), or a segment of one that other tasks may hold rows of.
PIECES = f"conv_id long, {COUNTS}, part int, seg int, turns array<long>, roles array<binary>, texts array<binary>"
RESULT = f"conv_id long, {COUNTS}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def _figures(s: Summary, cost: int) -> tuple:
    return s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, cost


def _whole(chart: Chart, turns: list, roles: list, texts: list) -> tuple:
    codes, s = read(turns, roles, texts, set())
    cost, column, back = chart.run(codes, ((0, 0),))
    more, at, inserts = complete(column)
    blocks = []
    for parents in reversed(back):
        at, block = parents[at]
        blocks.append(block)
    blocks = [*blocks[::-1], "I" * inserts]
    return (*_figures(s, cost + more), "".join(blocks), hashlib.sha256(b"\n".join(repaired(0, blocks, roles, texts))).hexdigest())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in; conversations that end here repaired, the others as segments."""
    chart, schema, part = Chart(), _schema(PIECES), TaskContext.get().partitionId()
    out: list[tuple] = []
    held = size = seg = 0
    turns, roles, texts = [], [], []
    conv, begun, edge = None, False, True  # edge: rows of conv may stand in the range before

    def cut(last: bool, ends: bool):
        """Give what is held away; last: of its conversation in this task, ends: and anywhere."""
        nonlocal turns, roles, texts, size, seg, held
        if last and ends and not edge and seg == 0:
            out.append((conv, *_whole(chart, turns, roles, texts), None, None, None, None, None))
        else:
            out.append((conv, *[None] * 8, part, seg, turns, roles, texts))
        held += size + 200
        seg, turns, roles, texts, size = (0 if last else seg + 1), [], [], [], 0

    for batch in batches:
        cols = [batch.column(n) for n in ("conv_id", "turn", "role", "text", "gone")]
        for own, turn, role, text, gone in zip(*(c.to_pylist() for c in cols), strict=True):
            if not begun or own != conv:
                if begun:
                    cut(True, True)
                    edge = False
                conv, begun = own, True
            elif len(texts) >= SEGMENT or size >= SEGMENT_BYTES:
                cut(False, False)
            if not gone:
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                size += len(text) + len(role)
            if held > SEGMENT_BYTES or len(out) >= SEGMENT:
                yield _batch(out, schema)
                out, held = [], 0
    if begun:
        cut(True, False)
    if out:
        yield _batch(out, schema)


SEGMENTS = "turns array<long>, roles array<binary>, texts array<binary>, seen array<binary>"


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in; what they count, and where each item leads to."""
    chart, schema = Chart(), _schema("id string, part int, seg int, outline string")
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            codes, s = read(r["turns"], r["roles"], r["texts"], set(r["seen"] or ()))
            ways = []
            for entered in range(len(NAMES)):
                cost, column, _ = chart.run(codes, ((entered, 0),))
                ways.append([(y, cost + c) for y, c in column])
            rows.append((r["id"], r["part"], r["seg"], json.dumps([ways, {f: getattr(s, f) for f in Summary.FIELDS}])))
        yield _batch(rows, schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outlines by conversation, in order, in; how each segment is entered and left out, with the conversation's figures at its last."""
    schema = _schema("id string, part int, seg int, entered int, left_at int, inserts int, figures string")
    own, todo = None, []

    def close():
        column: Column = ((0, 0),)
        total, back = Summary(), []
        for _, _, outline in todo:
            ways, summary = json.loads(outline)
            total.add(Summary(**summary))
            best: dict[int, tuple[int, int, int, int]] = {}
            for rank, (x, cost) in enumerate(column):
                for place, (y, more) in enumerate(ways[x]):
                    way = (cost + more, rank, place, x)
                    best[y] = min(best.get(y, way), way)
            column = tuple((y, best[y][0]) for y in sorted(best, key=lambda y: best[y][1:3]))
            back.append({y: w[3] for y, w in best.items()})
        cost, at, inserts = complete(column)
        rows = []
        for (part, seg, _), parents in zip(reversed(todo), reversed(back), strict=True):
            rows.append((own, part, seg, parents[at], at, 0 if rows else inserts, None if rows else json.dumps(_figures(total, cost))))
            at = parents[at]
        return _batch(rows, schema)

    for batch in batches:
        for r in batch.to_pylist():
            if r["id"] != own and todo:
                yield close()
                todo = []
            own = r["id"]
            todo.append((r["part"], r["seg"], r["outline"]))
    if todo:
        yield close()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments that know how they are entered and left in; their audits and repaired rows out."""
    chart, schema = Chart(), _schema("id string, conv_id long, part int, seg int, audit string, rows binary, figures string")
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            codes, _ = read(r["turns"], r["roles"], r["texts"], set(r["seen"] or ()))
            blocks = [*chart.blocks(codes, r["entered"], r["left_at"]), "I" * r["inserts"]]
            text = b"\n".join(repaired(r["entered"], blocks, r["roles"], r["texts"]))
            rows.append((r["id"], r["conv_id"], r["part"], r["seg"], "".join(blocks), text, r["figures"]))
        yield _batch(rows, schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mended segments by conversation, in order, in; a row per conversation out. Held: the digest's state and the audit."""
    schema = _schema(RESULT)
    audit, sha, any_row = [], hashlib.sha256(), False
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            audit.append(r["audit"])
            if r["rows"]:
                sha.update(b"\n" + r["rows"] if any_row else r["rows"])
                any_row = True
            if r["figures"] is not None:
                rows.append((r["conv_id"], *json.loads(r["figures"]), "".join(audit), sha.hexdigest()))
                audit, sha, any_row = [], hashlib.sha256(), False
        yield _batch(rows, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows with seeded faults; a dropped row is one that is gone, so that its
    conversation is still known."""
    blank = F.lit(" ")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    own = own.withColumn("d", F.crc32(named.cast("binary")) % 20)
    text = F.when(F.col("d") <= 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    own = own.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), F.when(F.col("d") == 3, 2).otherwise(1).alias("times"))
    return own.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of ``rows``
    (conv_id, turn, role, text and, if there is one, gone: a row that only names its conversation)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone").cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    own = bounded(rows).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("gone"))
    own = own.withColumn("spread", F.monotonically_increasing_id())  # deals rows that are equal in all else
    # ranges are drawn from short keys: a sample of them reaches the driver
    dealt = own.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "spread")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), "role", "text", "spread")
    pieces = keep(dealt.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "gone").mapInArrow(_pieces, PIECES), "dialogues")
    whole = pieces.filter("part IS NULL").select(*[f.split()[0] for f in RESULT.split(", ")])
    # from here on: conversations at the borders of tasks, and long ones
    segments = pieces.filter("part IS NOT NULL").select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id"), "part", "seg", "turns", "roles", "texts")
    at = ["id", "part", "seg"]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema("id string, part int, seg int, name binary")
        for batch in batches:
            for r in batch.to_pylist():
                got = {digest(a, b) for a, b in zip(r["roles"], r["texts"], strict=True) if b.strip()}
                yield _batch([(r["id"], r["part"], r["seg"], n) for n in got], schema)

    named = segments.mapInArrow(names, "id string, part int, seg int, name binary")
    first = named.groupBy("id", "name").agg(F.min(F.struct("part", "seg")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    later = named.join(first, ["id", "name"]).filter(F.col("first") < F.struct("part", "seg"))
    seen = keep(later.groupBy(*at).agg(F.collect_list("name").alias("seen")), "dialogues-seen")
    told = segments.join(seen, at, "left")
    ordered = lambda df: df.repartition("id").sortWithinPartitions(*at)
    outlines = told.select(*at, "turns", "roles", "texts", "seen").mapInArrow(_outline, "id string, part int, seg int, outline string")
    ways = keep(ordered(outlines).mapInArrow(_fold, "id string, part int, seg int, entered int, left_at int, inserts int, figures string"), "dialogues-ways")
    mended = told.join(ways, at).mapInArrow(_mend, "id string, conv_id long, part int, seg int, audit string, rows binary, figures string")
    return whole.unionByName(ordered(mended).mapInArrow(_joined, RESULT))
