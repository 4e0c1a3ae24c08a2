"""Queries of differences and merges of texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import diff
from ..sources.tables import table
from .queries import query


# every word is a line of its own, known by its place; some are changed, some are dropped
@query("""
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, i, length(w) % 5 = 0 AS gone, length(w) % 7 = 0 AND length(w) % 5 <> 0 AS put FROM w),
    c AS (SELECT *, gone OR put AS changed, lag(gone OR put, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
    s AS (SELECT doc_id, count(*) FILTER (changed AND NOT before) AS hunks, count(*) FILTER (changed) AS old_lines, count(*) FILTER (put) AS new_lines, count(*) FILTER (gone) AS gone, min(i) FILTER (changed) AS a, max(i) FILTER (changed) AS b, count(*) AS n FROM c GROUP BY doc_id)
    SELECT doc_id, CASE WHEN old_lines + new_lines > 1024 AND n > gone THEN 1 ELSE hunks END AS hunks, CASE WHEN old_lines + new_lines > 1024 AND n > gone THEN b - a + 1 ELSE old_lines END AS old_lines,
        CASE WHEN old_lines + new_lines > 1024 AND n > gone THEN b - a + 1 - gone ELSE new_lines END AS new_lines, old_lines + new_lines > 1024 AND n > gone AS coarse FROM s
""")
def line_hunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").filter("text is not null")
    lines = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("w"), F.concat(i.cast("string"), F.lit(":"), F.regexp_replace(w, "\n", "_")).alias("line")))
    size = F.length
    new = F.transform(F.filter(lines, lambda x: size(x["w"]) % 5 != 0), lambda x: F.when(size(x["w"]) % 7 == 0, F.concat(x["line"], F.lit("!"))).otherwise(x["line"]))
    both = docs.select("doc_id", F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("old"), F.array_join(new, "\n").alias("new"))
    got = both.select("doc_id", diff.line_diff(F.col("old"), F.col("new")).alias("h"))
    total = lambda name: F.aggregate("h", F.lit(0).cast("long"), lambda x, h: x + h[name])
    return got.select("doc_id", F.size("h").cast("long").alias("hunks"), total("old_count").alias("old_lines"), total("new_count").alias("new_lines"), F.exists("h", lambda h: h["coarse"]).alias("coarse"))


# a note on every page: both sides append, one does, both do the same, both change a line, or each changes one of its own
@query("""
    WITH p AS (SELECT doc_id, doc_id % 6 AS kind, text || chr(10) AS base FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
    SELECT doc_id, kind <> 4 AS clean, sha256(CASE kind WHEN 0 THEN base || 'ours' || chr(10) || 'theirs ' || doc_id || chr(10) WHEN 1 THEN base || 'ours' || chr(10) || chr(10) || '# theirs' || chr(10)
        WHEN 2 THEN base || 'theirs' || chr(10) WHEN 3 THEN base || 'same' || chr(10)
        WHEN 4 THEN '<<<<<<< ours' || chr(10) || 'a' || chr(10) || '||||||| base' || chr(10) || 'head' || chr(10) || '=======' || chr(10) || 'b' || chr(10) || '>>>>>>> theirs' || chr(10) || base
        ELSE 'a' || chr(10) || base || 'b' || chr(10) END) AS merged FROM p
""")
def append_merges(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and doc_id is not null").select("doc_id", (F.col("doc_id") % 6).alias("kind"), F.concat("text", F.lit("\n")).alias("base"))
    kind, base = F.col("kind"), F.col("base")
    with_ = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    sides = docs.select(
        "doc_id",
        F.when(kind < 4, base).otherwise(with_("head\n", base, F.when(kind == 5, "tail\n").otherwise(""))).alias("base"),
        F.when(kind < 2, with_(base, "ours\n")).when(kind == 2, base).when(kind == 3, with_(base, "same\n")).otherwise(with_("a\n", base, F.when(kind == 5, "tail\n").otherwise(""))).alias("ours"),
        F.when(kind == 0, with_(base, "theirs ", F.col("doc_id").cast("string"), "\n")).when(kind == 1, with_(base, "# theirs\n")).when(kind == 2, with_(base, "theirs\n")).when(kind == 3, with_(base, "same\n")).when(kind == 4, with_("b\n", base)).otherwise(with_("head\n", base, "b\n")).alias("theirs"),
    )
    return sides.select("doc_id", diff.append_union("base", "ours", "theirs").alias("m")).select("doc_id", "m.clean", F.sha2("m.text", 256).alias("merged"))
