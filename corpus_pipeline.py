"""A corpus pipeline of four stages: language ID, near duplicates, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. Mixing repeats a row as often as the mix takes it.

Corners, for every stage: columns beyond those of documents, of any name, come through unchanged (encoding returns its own);
an empty table stays empty; a null text is empty. language: null, empty and letterless texts go, of ties the smaller
name wins, repeated rows are judged alike. near_duplicates: texts without words stay, each row of them; a null doc_id is as
good as any. mixing: texts without words are never taken; null sources are one source. encoding: an empty text has no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evergrain.llm import bpe, jaccard, langid, mixture
from evergrain.llm.queries import pattern, tokenizer
from evergrain.llm.shared import keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those of no clear language, go."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked at 0.8 over shingles of five words, one row stays: that with the least doc_id, null
    last, of equal ids that with the least hash. A row is known by a hash of its doc_id and text, so rows that share an
    id, or have none, are decided apart; rows equal in both are one. Where a second hash tells rows of one hash apart, none of
    them is removed."""
    named = (F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    row, check = F.xxhash64(*named), F.xxhash64(F.lit("check"), *named)
    # the columns of docs travel as one, so that none of their names can meet one of ours
    own = docs.select(F.struct("*").alias("_own"), row.alias("_row"), check.alias("_check"))
    found = keep(jaccard.classes(own.select(F.col("_row").alias("doc_id"), F.col("_own.text").alias("text")), width=5, percent=80), "near-classes")
    rows = found.select(F.col("doc_id").alias("_row"), "component_id", "n_shingles").distinct()
    ids = own.groupBy("_row").agg(F.min(F.col("_own.doc_id").cast("long")).alias("doc_id"), (F.min("_check") == F.max("_check")).alias("_sure"))
    ids = keep(ids, "near-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).getField("_row")
    stays = rows.join(ids, "_row").groupBy("component_id").agg(first.alias("_row")).select("_row")
    sure = ids.filter("_sure").select("_row")
    gone = keep(rows.select("_row").join(stays, "_row", "left_anti").join(sure, "_row", "left_semi"), "near-gone")
    kept = own.join(gone, "_row", "left_anti")
    # of rows with words that agree in id and text one stays; only those are moved
    again = keep(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1").join(sure.withColumnRenamed("_row", "_again"), "_again", "left_semi").select("_again"), "near-again")
    if again.isEmpty():
        return kept.select("_own.*")
    like = F.col("_row") == F.col("_again")
    return kept.join(again, like, "left_anti").unionByName(kept.join(again, like, "left_semi").dropDuplicates(["_row"])).select("_own.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, in the order of the output shards."""
    return mixture.emit(docs, numbered=False)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded bytes."""
    return bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express none of the four; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
