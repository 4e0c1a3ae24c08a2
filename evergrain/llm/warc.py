"""WARC archives: writer, and a sequential reader of one gzip member per record.

Every record is its own gzip member. The reader inflates member after member from one pass over the bytes, in
slices of bounded size, takes the header block up to the blank line, the block by Content-Length, then the two line
ends, and checks block and payload digests. Equal payloads of at least ``dedup_from`` bytes are stored once: the
row with the largest page_id is the response, the others are revisits that keep the HTTP header and name it.

Nulls and corners: null html is an empty payload; a null url has no WARC-Target-URI and is read as null; a null
page_id is smaller than any other and refers to nothing if all of its group are null (then all are responses);
repeated rows that share the winning page_id are all responses; an empty table gives empty archives and no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, keep

SLICE = 1 << 16
ARCHIVE_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "block_ok boolean, payload_ok boolean, error string, payload binary"
)
DATE = "2000-01-01T00:00:00Z"


def decide(pages: DataFrame, dedup_from: int = 1000) -> DataFrame:
    """page_id, url, html, digest, refers_to: which rows are revisits and of which page."""
    own = bounded(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    again = (
        own.filter(F.octet_length("html") >= dedup_from)
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and winner is not null")
        .select("digest", "winner")
    )
    return own.join(again, "digest", "left").select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"),
    )


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        plain = url == url.strip() and url.isprintable()
        lines.append("WARC-Target-URI: " + (url if plain else quote(url)))
        if not plain:  # a header line can't hold it as it is
            lines.append("Original-URL: " + base64.b64encode(url.encode()).decode())
    if refers_to is not None:
        lines += [
            f"WARC-Refers-To: {_urn(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    lines.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write(rows: DataFrame, archive_mb: int = 8) -> DataFrame:
    """Rows of decide() as archives of about archive_mb; a task streams its rows and holds one archive."""
    limit = archive_mb << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, name, n = [], 0, "", 0

        def archive():
            return pa.RecordBatch.from_pydict({"archive": [f"{name}-{n:06d}.warc.gz"], "content": [b"".join(held)]})

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for k in range(batch.num_rows):
                member = record(*(c[k].as_py() for c in cols))
                name = name or hashlib.sha1(member).hexdigest()[:16]
                held.append(member)
                size += len(member)
                if size >= limit:
                    yield archive()
                    held, size, n = [], 0, n + 1
        if held:
            yield archive()

    return rows.mapInArrow(run, ARCHIVE_SCHEMA)


def inflate(slices: Iterator[bytes]) -> Iterator[bytes]:
    """Members of a gzip stream, one after the other, from slices of it; a torn last member raises."""
    z, out, any_in = zlib.decompressobj(31), [], False
    for piece in slices:
        while piece:
            any_in = True
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out, any_in = zlib.decompressobj(31), [], False
    if any_in:
        raise ValueError("truncated gzip member")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and the block; framing is checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("block does not match Content-Length")
    return fields, rest[:n]


def _page(urn: str | None):
    tail = (urn or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def facts(raw: bytes) -> dict:
    """A row of RECORD_SCHEMA from one inflated member."""
    fields, block = parse(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    url = fields.get("warc-target-uri")
    if "original-url" in fields:
        url = base64.b64decode(fields["original-url"]).decode()
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": url,
        "payload_bytes": size,
        "payload_digest": base64.b32decode(digest.partition(":")[2]).hex(),
        "record_type": kind,
        "refers_to": _page(fields.get("warc-refers-to")),
        "block_ok": _sha1(block) == fields["warc-block-digest"],
        "payload_ok": None if kind == "revisit" else _sha1(payload) == digest and len(payload) == size,
        "error": None,
        "payload": None if kind == "revisit" else payload,
    }


def read(archives: DataFrame, with_payload: bool = True, batch: int = 256) -> DataFrame:
    """Records of archives (a content column: the table of write(), or Spark's binaryFile source). A torn or
    malformed archive yields its good records, then one row with the error."""
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.binary()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        rows: list[dict] = []

        def flush():
            return pa.RecordBatch.from_pylist(rows, schema)

        for b in batches:
            for value in b.column("content"):
                whole = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                try:
                    for raw in inflate(bytes(whole[i : i + SLICE]) for i in range(0, len(whole), SLICE)):
                        rows.append(facts(raw))
                        if not with_payload:
                            rows[-1]["payload"] = None
                        if len(rows) >= batch:
                            yield flush()
                            rows = []
                except (ValueError, KeyError, zlib.error, IndexError) as e:
                    rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
        if rows:
            yield flush()

    return archives.select("content").mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, dedup_from: int = 1000) -> DataFrame:
    """Write every page, read the archives back; a failed digest or framing fails the job."""
    back = read(keep(write(decide(pages, dedup_from)), "warc"), with_payload=False)
    bad = F.col("error").isNotNull() | ~F.col("block_ok") | ~F.coalesce("payload_ok", F.lit(True))
    kind = F.when(bad, F.raise_error(F.concat(F.lit("archive is damaged: "), F.coalesce("error", F.lit("digest"))))).otherwise(F.col("record_type"))
    return back.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")
