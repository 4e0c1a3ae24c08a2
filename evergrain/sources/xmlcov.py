"""XML coverage reports by Spark's XML reader: file, line_no, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _xml(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("mode", "FAILFAST").schema(schema).load(path)


def jacoco(spark: SparkSession, path: str) -> DataFrame:
    """Covered instructions of each line of each source file of a package."""
    schema = "_name string, sourcefile array<struct<_name:string, line:array<struct<_nr:bigint, _ci:bigint>>>>"
    files = _xml(spark, path, "package", schema).select("_name", F.explode("sourcefile").alias("f"))
    return files.select(F.concat("_name", F.lit("/"), "f._name").alias("file"), F.explode("f.line").alias("l")).select("file", F.col("l._nr").alias("line_no"), F.col("l._ci").alias("hits"))


def cobertura(spark: SparkSession, path: str) -> DataFrame:
    """Hits of each line of each class; a line that several classes of a file report has the most of them."""
    schema = "_filename string, lines struct<line:array<struct<_number:bigint, _hits:bigint>>>"
    lines = _xml(spark, path, "class", schema).select(F.col("_filename").alias("file"), F.explode("lines.line").alias("l"))
    return lines.groupBy("file", F.col("l._number").alias("line_no")).agg(F.max("l._hits").alias("hits"))
