"""A bounded sink with a commit in two phases: tasks write part files beside each other, and only a whole within its bound becomes
visible. Nothing is left of one that failed. The folder is shared by driver and executors."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str
    size: int
    rows: int


class BoundedWriter(DataSourceWriter):
    """Rows as JSON lines. A task stops as soon as it alone is over the bound; the sum is checked before anything is moved."""

    def __init__(self, folder: str, most: int):
        if os.path.exists(folder):
            raise FileExistsError(folder)
        self.folder, self.most = folder, most
        self.staging = f"{folder}.staging-{uuid.uuid4().hex}"
        os.makedirs(self.staging)  # here alone: a task that outlives the job must not make it again

    def write(self, iterator: Iterator) -> Part:
        name, size, rows = f"part-{uuid.uuid4().hex}.jsonl", 0, 0
        with open(os.path.join(self.staging, name), "wb") as f:
            for row in iterator:
                line = json.dumps(row.asDict(recursive=True), ensure_ascii=False, separators=(",", ":"), default=str).encode() + b"\n"
                size, rows = size + len(line), rows + 1
                if size > self.most:
                    raise ValueError(f"a task is over the bound of {self.most} bytes")
                f.write(line)
        return Part(name, size, rows)

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        size = sum(m.size for m in parts)
        if size > self.most:
            self._drop()
            raise ValueError(f"{size} bytes are over the bound of {self.most}")
        os.makedirs(self.staging, exist_ok=True)
        # files of attempts that were not the ones to count stay behind
        kept = {m.name for m in parts}
        for name in os.listdir(self.staging):
            if name not in kept:
                os.remove(os.path.join(self.staging, name))
        with open(os.path.join(self.staging, "_index.json"), "w") as f:
            json.dump({"bytes": size, "rows": sum(m.rows for m in parts), "parts": sorted(kept)}, f)
        os.rename(self.staging, self.folder)

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        gone = f"{self.staging}.gone"
        if os.path.exists(self.staging):
            os.rename(self.staging, gone)  # nothing can be opened in it any more
        shutil.rmtree(gone, ignore_errors=True)


class BoundedSink(DataSource):
    """``evidence_index``: options path (new) and most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "evidence_index"

    def writer(self, schema, overwrite: bool) -> BoundedWriter:
        return BoundedWriter(self.options["path"], int(self.options["most_bytes"]))


def write_index(df: DataFrame, folder: str, most_bytes: int) -> None:
    """Write rows as JSON lines, all of them or, if their bytes pass the bound, none."""
    df.sparkSession.dataSource.register(BoundedSink)
    df.write.format("evidence_index").mode("append").option("path", folder).option("most_bytes", str(most_bytes)).save()


def read_index(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a committed index; one whose parts are not those it names is refused."""
    with open(os.path.join(folder, "_index.json")) as f:
        index = json.load(f)
    if sorted(n for n in os.listdir(folder) if n.endswith(".jsonl")) != index["parts"]:
        raise ValueError(f"{folder} does not hold the parts that its index names")
    return spark.read.schema(schema).json([f"file://{folder}/{n}" for n in index["parts"]]) if index["parts"] else spark.createDataFrame([], schema)
