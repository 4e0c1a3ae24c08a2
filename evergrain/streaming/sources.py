"""Event sources and fact sources as Python data sources: lines of growing files, and learned facts by element.

Both read folders that driver and executors share. ``register`` makes them known to a session.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    file: str
    start: int
    end: int
    whole: int  # end of the last complete line


class LineReader(DataSourceStreamReader):
    """An offset is the length, in complete lines, of every file; a batch holds the lines between two offsets, and nothing else
    decides what it holds, so a batch that is run again after a failure has the same lines."""

    def __init__(self, folder: str, most: int, chunk: int):
        self.folder, self.most, self.chunk = folder, most, chunk
        self.at: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _complete(self, path: str, start: int) -> int:
        """The end of the last complete line, ``most`` bytes from start at most, a longer line whole."""
        size = os.path.getsize(path)
        if size < start:
            raise OSError(f"{path} has {size} bytes, {start} were read: it was cut or replaced")
        with open(path, "rb") as f:
            end = min(size, start + self.most)
            at = end
            while at > start:
                low = max(start, at - 65536)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    return low + cut + 1
                at = low
            f.seek(end)
            while part := f.read(65536):
                cut = part.find(b"\n")
                if cut >= 0:
                    return f.tell() - len(part) + cut + 1
        return start

    def latestOffset(self) -> dict:
        now = dict(self.at)
        for e in sorted(os.scandir(self.folder), key=lambda e: e.name):
            if e.is_file() and not e.name.startswith((".", "_")):
                now[e.name] = self._complete(e.path, self.at.get(e.name, 0))
        gone = [name for name in self.at if not os.path.exists(os.path.join(self.folder, name))]
        if gone:
            raise OSError(f"files are gone: {gone[:3]}")
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self.at = dict(end)  # after a restart offsets come from the checkpoint
        spans = [(name, start.get(name, 0), stop) for name, stop in sorted(end.items()) if stop > start.get(name, 0)]
        return [Range(name, low, min(low + self.chunk, stop), stop) for name, first, stop in spans for low in range(first, stop, self.chunk)]

    def read(self, partition: Range) -> Iterator[tuple]:
        path = os.path.join(self.folder, partition.file)
        with open(path, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                if f.read(1) != b"\n":
                    at += len(f.readline())
            while at < min(partition.end, partition.whole):
                line = f.readline()
                if not line.endswith(b"\n"):
                    raise OSError(f"{path} ends before {partition.whole}")
                yield partition.file, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass  # files stay where they are; the checkpoint knows how far they were read


class LineSource(DataSource):
    """``evidence_lines``: a row (file, at, value) per complete line of the files of a folder, as they grow; at: where it
    begins, in bytes. Options: path, most_bytes (of a file in a batch), chunk_bytes (of a task). A file that shrinks or goes stops the
    stream with an error."""

    @classmethod
    def name(cls) -> str:
        return "evidence_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def streamReader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("most_bytes", "67108864")), int(self.options.get("chunk_bytes", "8388608")))


def stop_reason(query: StreamingQuery) -> str | None:
    """Why a stream ended: null while it runs and after a stop that was asked for, or an end of its input; else the failure, so that its
    last answer is not kept as fresh."""
    if query.isActive:
        return None
    failed: StreamingQueryException | None = query.exception()
    return str(failed) if failed is not None else None


FACT = "element string, source string, kind string, revision string, text string, authority string"


def bucket(element: str, buckets: int) -> int:
    return zlib.crc32(element.encode()) % buckets


@dataclass
class Bucket(InputPartition):
    number: int


class FactReader(DataSourceReader):
    """Facts lie in folders bucket=N by the CRC-32 of their element; a filter on elements leaves only their buckets to be read."""

    def __init__(self, folder: str):
        self.folder = folder
        with open(os.path.join(folder, "_facts.json")) as f:
            self.buckets = int(json.load(f)["buckets"])
        self.elements: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if own is None or f.attribute != ("element",) or not all(isinstance(v, str) for v in own):
                yield f
            else:
                self.elements = own if self.elements is None else [v for v in self.elements if v in own]

    def partitions(self) -> Sequence[Bucket]:
        numbers = range(self.buckets) if self.elements is None else sorted({bucket(e, self.buckets) for e in self.elements})
        here = [Bucket(n) for n in numbers if os.path.isdir(os.path.join(self.folder, f"bucket={n}"))]
        return here or [Bucket(-1)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        folder = os.path.join(self.folder, f"bucket={partition.number}")
        names = sorted(n for n in os.listdir(folder) if n.endswith(".json")) if partition.number >= 0 else []
        for name in names:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                for line in f:
                    r = json.loads(line)
                    if self.elements is None or r["element"] in self.elements:
                        # a fact is learned, whatever its provider says
                        yield r["element"], r.get("source"), r.get("kind"), r.get("revision"), r.get("text"), "learned"


class FactSource(DataSource):
    """``evidence_facts``: learned facts of a folder that write_facts() made. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "evidence_facts"

    def schema(self) -> str:
        return FACT

    def reader(self, schema) -> FactReader:
        return FactReader(self.options["path"])


def write_facts(facts: DataFrame, folder: str, buckets: int = 64) -> None:
    """facts (element, source, kind, revision, text) as JSON lines, partitioned by element; folder is new."""
    names = ["element", "source", "kind", "revision", "text"]
    own = facts.select(*[F.col(n).cast("string").alias(n) for n in names]).filter("element is not null")
    own.withColumn("bucket", F.crc32(F.col("element").cast("binary")) % buckets).repartition("bucket").write.partitionBy("bucket").json(folder)
    with open(os.path.join(folder, "_facts.json"), "w") as f:
        json.dump({"buckets": buckets}, f)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineSource)
    spark.dataSource.register(FactSource)


def overlay_facts(spark: SparkSession, folder: str, elements: Sequence[str] | None = None) -> DataFrame:
    """Facts of the elements that a projection selected (a bounded list), or of all."""
    register(spark)
    facts = spark.read.format("evidence_facts").option("path", folder).load()
    return facts if elements is None else facts.filter(F.col("element").isin(sorted(set(elements))))


def lines(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("evidence_lines").option("path", folder).options(**options).load()
