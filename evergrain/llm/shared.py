"""What the operators of this subpackage share: tables written to the shared folder, words, guards on columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; every operator that counts words uses this.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="evergrain-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def trim() -> None:
    """Give what a finished Python task no longer needs back to the system: its worker lives on, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete the tables that this process has kept so far; results that still read them are gone then."""
    jvm = spark.sparkContext._jvm
    for path in _written:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.clear()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that Python workers get at a time, where the session sets nothing: bounds memory whatever the texts' length.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded in bytes, not in rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def utf8(name: str) -> Column:
    """A text column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z only, split at the six ASCII white spaces: bytes.lower and bytes.split do just that."""
    return raw.lower().split()


def held_out(name: str, modulo: int) -> Column:
    """crc32(id as text) mod modulo = 2: the rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulo == 2, F.lit(False))


def scan_parts(df: DataFrame) -> int:
    """Partitions that the scan of df is cut into; follows the size of the input, runs no job."""
    return max(1, df.rdd.getNumPartitions())
