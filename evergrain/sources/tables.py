"""Parquet tables of a directory; only the columns that a plan uses are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def micros(name: str):
    """A timestamp column, with or without a zone, as microseconds since 1970 in UTC."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def snapshot(spark: SparkSession, folder: str, revision: str) -> DataFrame:
    """A table that is partitioned by ``rev``, at one full revision: only that revision's files are read."""
    return spark.read.parquet(folder).filter(F.col("rev") == revision).drop("rev")


def pin(snapshot_: DataFrame, columns: list[str]) -> DataFrame:
    """The identity of a snapshot alone: what is not named is never read."""
    return snapshot_.select(*columns)


def line_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored index, refused unless it has just the columns and types of ``schema``."""
    from pyspark.sql.types import StructType

    df = spark.read.parquet(path)
    want = {(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)}
    have = {(f.name, f.dataType.simpleString()) for f in df.schema}
    if want != have:
        raise ValueError(f"an index of another shape: {sorted(want ^ have)}")
    return df
