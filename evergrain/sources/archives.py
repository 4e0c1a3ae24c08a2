"""Sources and sinks with a format of their own inside: SQLite databases as rows of bytes, trace archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows that one database is to have, and MB of rows after which a range goes on in another one.
_ROWS, _MB = 500_000, 32


def to_sqlite(df: DataFrame, table: str, index: str, parts: int = 8) -> DataFrame:
    """(part, content): databases of the hash ranges of ``index``, each written in one transaction, indexed and compacted. Ranges are
    ``parts``, or more if the rows need them; one whose rows are many or wide all the same (a key has one part) goes on in
    further databases of its part, so a task holds one of bounded size. Bytes leave tasks as rows, so any sink can take them."""
    names, limit = df.columns, _MB << 20
    quoted = ", ".join(f'"{c}"' for c in names)
    n = max(parts, -(-df.count() // _ROWS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        def opened() -> sqlite3.Connection:
            db = sqlite3.connect(":memory:")
            db.execute(f'CREATE TABLE "{table}" ({quoted})')
            return db

        def closed(part: int, db: sqlite3.Connection) -> pa.RecordBatch:
            db.execute(f'CREATE INDEX "{table}_{index}" ON "{table}" ("{index}")')
            db.commit()
            db.execute("VACUUM")
            content = db.serialize()
            db.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([content], pa.binary())], ["part", "content"])

        db, part = None, 0
        for batch in batches:
            # a task has the rows of one part alone
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                db, part = db or opened(), some.column("_part")[0].as_py()
                db.executemany(f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(names))})', zip(*(some.column(c).to_pylist() for c in names), strict=True))
                if db.execute("PRAGMA page_count").fetchone()[0] * db.execute("PRAGMA page_size").fetchone()[0] >= limit:
                    yield closed(part, db)
                    db = None
        if db:
            yield closed(part, db)

    dealt = df.withColumn("_part", F.pmod(F.xxhash64(index), F.lit(n)).cast("int")).repartitionById(n, "_part")
    return dealt.mapInArrow(build, "part int, content binary")


def from_sqlite(databases: DataFrame, table: str, schema: str, where: str = "", values: tuple = (), batch: int = 4096) -> DataFrame:
    """Rows of a table of databases (content), with the columns of ``schema``; ``where`` with its ``values`` is a look-up by the
    database's own index. A database without the table, or with a damaged page, fails the query."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]
    sql = f"SELECT {', '.join(f'"{c}"' for c in names)} FROM \"{table}\"" + (f" WHERE {where}" if where else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for rows in batches:
            for content in rows["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                cursor = db.execute(sql, values)
                while got := cursor.fetchmany(batch):
                    yield pd.DataFrame(got, columns=names)
                db.close()

    return databases.select("content").mapInPandas(read, schema)


def regroup(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): a table's rows by their key again, items sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))


def trace_events(archives: DataFrame) -> DataFrame:
    """archive, context, place, time, kind, url of navigations in trace archives (path, content): the root context (trace.trace)
    first, then the numbered ones by their number; malformed archives or lines fail the query."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import json
        import re
        import zipfile

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    members = [(int(m[1] or -1), name) for name in z.namelist() if (m := re.fullmatch(r"(?:(\d+)-)?trace\.trace", name))]
                    for context, name in sorted(members):
                        for line in io.TextIOWrapper(z.open(name), "utf-8"):
                            event = json.loads(line) if line.strip() else {}
                            url = (event.get("params") or {}).get("url") or event.get("url")
                            if url and (event.get("method") in ("goto", "navigated", "reload") or event.get("type") == "frame-navigated"):
                                out.append((path, context, len(out), float(event.get("startTime") or event.get("time") or 0), event.get("method") or event.get("type"), url))
                yield pd.DataFrame(out, columns=["archive", "context", "place", "time", "kind", "url"])

    return archives.select("path", "content").mapInPandas(read, "archive string, context int, place int, time double, kind string, url string")
