"""Text evidence formats as DataFrames. What is malformed is refused (the query fails with the line) or, where the format
says so, skipped; nothing is invented."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.graph import _cut

def numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line, value: lines of text files with their number, whole files per row split inside Spark."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("all"))
    return files.select("path", F.posexplode(F.split("all", "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def refuse(bad: Column, message: Column, value: Column) -> Column:
    """value, unless bad: then the query fails with the message."""
    return F.when(bad, F.raise_error(message)).otherwise(value)


def coverprofile(lines: DataFrame) -> DataFrame:
    """Blocks of Go cover profiles (path, line, value): file, start, start_col, end, end_col, statements, count, mode."""
    shape = r"^(.+):([0-9]+)\.([0-9]+),([0-9]+)\.([0-9]+) ([0-9]+) ([0-9]+)$"
    mode = F.regexp_extract("value", r"^mode: (set|count|atomic)$", 1)
    modes = lines.filter(F.col("value").startswith("mode:")).groupBy("path").agg(F.min(mode).alias("low"), F.max(mode).alias("high"))
    # a row a path, written, so that few of them are sent to the lines: a long profile is not one task
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("mode:")).join(_cut(modes), "path", "left")
    part = lambda k, kind: F.regexp_extract("value", shape, k).try_cast(kind)
    bad = ~F.col("value").rlike(shape) | (F.coalesce("low", F.lit("")) == "") | (F.col("low") != F.col("high"))
    note = F.concat(F.lit("cover profile "), "path", F.lit(" line "), F.col("line").cast("string"))
    return rows.select(
        "path", "line", refuse(bad, note, F.regexp_extract("value", shape, 1)).alias("file"), part(2, "long").alias("start"), part(3, "long").alias("start_col"), part(4, "long").alias("end"), part(5, "long").alias("end_col"), part(6, "long").alias("statements"), part(7, "decimal(20,0)").alias("count"), F.col("low").alias("mode")
    )


def lcov(lines: DataFrame) -> DataFrame:
    """file, line_no, hits of LCOV traces; the SF record above a DA record names its file."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    known = r"^(SF|DA|TN|FN|FNDA|FNF|FNH|BRDA|BRF|BRH|LF|LH|VER|FNL|FNA):|^end_of_record$|^#|^$"
    carried = lines.withColumn("file", F.last(F.when(F.col("value").startswith("SF:"), F.expr("substring(value, 4)")).when(F.col("value") == "end_of_record", ""), True).over(order))
    da = r"^DA:([0-9]+),([0-9]+)(,.*)?$"
    bad = ~F.col("value").rlike(known) | (F.col("value").startswith("DA:") & (~F.col("value").rlike(da) | (F.coalesce("file", F.lit("")) == "")))
    note = F.concat(F.lit("lcov "), "path", F.lit(" line "), F.col("line").cast("string"))
    checked = carried.withColumn("file", refuse(bad, note, F.col("file")))
    return checked.filter(F.col("value").startswith("DA:") | F.col("file").isNull()).filter(F.col("value").startswith("DA:")).select("file", F.regexp_extract("value", da, 1).cast("long").alias("line_no"), F.regexp_extract("value", da, 2).cast("long").alias("hits"))


def raw_diff(lines: DataFrame) -> DataFrame:
    """Hunks of git diff -p -U0: old_file, new_file, old_start, old_count, new_start, new_count."""
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = r"^diff --git a/(.*) b/(.*)$"
    hunk = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
    carry = lambda k: F.last(F.when(F.col("value").rlike(head), F.regexp_extract("value", head, k)), True).over(order)
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract("value", hunk, k), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return lines.withColumn("old_file", carry(1)).withColumn("new_file", carry(2)).filter(F.col("value").rlike(hunk)).select("old_file", "new_file", number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"))


def requirement_map(lines: DataFrame) -> DataFrame:
    """selector, id of SELECTOR=ID[,ID...] lines; blank lines and # comments are skipped."""
    v = F.trim("value")
    rows = lines.filter((v != "") & ~v.startswith("#")).withColumn("v", v)
    bad = ~F.col("v").rlike("^[^=]+=[^=]+$")
    note = F.concat(F.lit("requirement map line "), F.col("line").cast("string"))
    return rows.select(refuse(bad, note, F.trim(F.substring_index("v", "=", 1))).alias("selector"), F.explode(F.split(F.substring_index("v", "=", -1), r"\s*,\s*")).alias("id")).select("selector", F.trim("id").alias("id"))


def requirement_index(spark: SparkSession, path: str) -> DataFrame:
    return index_rows(numbered(spark, path))


def index_rows(rows: DataFrame, columns: tuple[str, ...] = ("file", "title", "acceptance", "acceptedBy")) -> DataFrame:
    """Rows of headed TSV lines (path, line, value) by id; malformed rows are skipped, the last row of an id wins."""
    head = rows.filter("line = 1").select("path", F.split("value", "\t").alias("names"))
    cells = rows.filter("line > 1").join(head, "path").withColumn("cells", F.split("value", "\t"))
    good = cells.filter(F.size("cells") == F.size("names")).withColumn("row", F.map_from_arrays("names", "cells"))
    good = good.withColumn("id", F.col("row")["id"]).filter(F.coalesce("id", F.lit("")) != "")
    best = good.groupBy("id").agg(F.max_by("row", F.struct("path", "line")).alias("row"))
    return best.select("id", *[F.col("row")[c].alias(c) for c in columns])


def test_events(lines: DataFrame) -> DataFrame:
    """package, outcome of go test -json streams: any fail wins, then skip alone, else pass."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("Action", "Package", "Test")])
    e = lines.filter(F.trim("value") != "").select(F.from_json("value", kind).alias("e")).select("e.*").filter(F.col("Package").isNotNull() & F.col("Action").isin("pass", "fail", "skip"))
    any_of = lambda a: F.bool_or(F.col("Action") == a)
    return e.groupBy(F.col("Package").alias("package")).agg(F.when(any_of("fail"), "fail").when(any_of("pass"), "pass").otherwise("skip").alias("outcome"))


def tap(lines: DataFrame) -> DataFrame:
    """path, number, name, verdict of TAP output; a test line without a number keeps its place, what is no test line goes."""
    shape = r"^(not ok|ok)\b\s*([0-9]+)?\s*(?:- )?([^#]*?)\s*(?:#\s*(\w+).*)?$"
    rows = lines.filter(F.col("value").rlike(r"^(not ok|ok)\b"))
    part = lambda k: F.regexp_extract("value", shape, k)
    order = F.row_number().over(Window.partitionBy("path").orderBy("line"))
    note = F.upper(part(4))
    verdict = F.when(note == "SKIP", "skip").when(note == "TODO", "todo").when(part(1) == "ok", "pass").when(part(1) == "not ok", "fail").otherwise("UNKNOWN")
    return rows.select("path", F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), order).alias("number"), part(3).alias("name"), verdict.alias("verdict"))


_LINKS = "commits array<string>, evidence array<string>, paths map<string, array<struct<commit:int, evidence:int>>>"


def link_tables(spark: SparkSession, path: str) -> DataFrame:
    return link_rows(spark.read.schema(_LINKS).option("multiLine", True).option("mode", "FAILFAST").json(path))


def link_rows(raw: DataFrame) -> DataFrame:
    """path, commit, evidence of dictionaries (commits, evidence) and per path records of their numbers; a number
    outside its dictionary fails the query."""
    each = raw.select("commits", "evidence", F.explode("paths").alias("path", "records")).select("commits", "evidence", "path", F.explode("records").alias("r"))
    bad = (F.col("r.commit") < 0) | (F.col("r.commit") >= F.size("commits")) | (F.col("r.evidence") < 0) | (F.col("r.evidence") >= F.size("evidence"))
    return each.select("path", refuse(bad, F.concat(F.lit("dangling link of "), "path"), F.get("commits", F.col("r.commit"))).alias("commit"), F.get("evidence", F.col("r.evidence")).alias("evidence"))


def history(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """commit, tree, subject, paths, place of a git log stream: records begin with U+001E."""
    return history_rows(spark.read.option("lineSep", "\x1e").text(path).withColumn("place", F.monotonically_increasing_id()), most)


def history_rows(raw: DataFrame, most: int | None = 200) -> DataFrame:
    """commit, tree, subject, paths, place of records (value, place): fields part at U+001F, paths at NUL. Grafted commits are
    dropped; more than ``most`` records are refused."""
    raw = raw.filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", "\0")
    body = F.split(parts.getItem(0), "\x1f")
    paths = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.regexp_replace(p, "^\n|\n$", "")), lambda p: p != "")
    rows = raw.select(F.trim(body.getItem(0)).alias("commit"), body.getItem(1).alias("tree"), F.trim(body.getItem(2)).alias("subject"), F.get(body, F.lit(3)).alias("decoration"), paths.alias("paths"), "place")
    kept = rows.filter(~F.array_contains(F.split(F.coalesce("decoration", F.lit("")), ", "), "grafted"))
    if most is None:
        return kept.drop("decoration")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    return kept.crossJoin(F.broadcast(total)).select(refuse(F.col("_n") > most, F.lit("history is longer than its window"), F.col("commit")).alias("commit"), "tree", "subject", "paths", "place")


EXTERNAL = T.StructType([
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "kind")]))),
    T.StructField("relations", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("from", "to", "type")]))),
])


def external_records(raw: DataFrame, value: str, most: tuple[int, int] = (1000, 4000)) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of JSON records: what is malformed, too large, or names an entity that is not there fails."""
    rec = raw.select(*[c for c in raw.columns if c != value], F.from_json(value, EXTERNAL, {"mode": "FAILFAST"}).alias("r"))
    ids = F.transform("r.entities", lambda e: e["id"])
    ends = F.flatten(F.transform("r.relations", lambda x: F.array(x["from"], x["to"])))
    bad = (F.size("r.entities") > most[0]) | (F.size("r.relations") > most[1]) | (F.size(F.array_distinct(ids)) < F.size(ids)) | (F.size(F.array_except(ends, ids)) > 0)
    ok = rec.withColumn("r", refuse(F.coalesce(bad, F.lit(True)), F.lit("external record is not valid"), F.col("r")))
    keys = [c for c in raw.columns if c != value]
    return ok.select(*keys, F.explode("r.entities").alias("e")).select(*keys, "e.*"), ok.select(*keys, F.explode("r.relations").alias("e")).select(*keys, "e.*")


def write_bounded(df: DataFrame, path: str, most_bytes: int) -> None:
    """Write a table, refusing rows whose JSON would pass the bound."""
    size = df.select(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first().b or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes are over the bound of {most_bytes}")
    df.write.mode("errorifexists").parquet(path)
