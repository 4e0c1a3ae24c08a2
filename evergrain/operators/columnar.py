"""Compressed sparse rows as columns: a block of keyed lists becomes a dictionary, offsets and numbers, and comes back
checked. Parquet stores such arrays by column; a block is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.formats import refuse


def _ends(lists: DataFrame, block: str, key: str) -> DataFrame:
    """lists with ``_end``: how many entries stand up to and with a key's, in the order of keys."""
    upto = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return lists.withColumn("_end", F.sum(F.size("_i")).over(upto).cast("int"))


def encode(rows: DataFrame, block: str, key: str, item: str) -> DataFrame:
    """block, keys, names, offsets, ids of distinct (key, item): keys and names sorted; items of keys[k] are
    names[ids[offsets[k]]] up to, not with, offsets[k + 1]."""
    own = rows.select(block, key, item).distinct().withColumn("_id", F.dense_rank().over(Window.partitionBy(block).orderBy(item)) - 1)
    lists = _ends(own.groupBy(block, key).agg(F.array_sort(F.collect_list("_id")).alias("_i")), block, key)
    blocks = lists.groupBy(block).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_end").alias("e"), F.col("_i").alias("i")))).alias("_b"))
    names = own.groupBy(block).agg(F.array_sort(F.collect_set(item)).alias("names"))
    field = lambda f: F.transform("_b", lambda x: x[f])
    return blocks.join(names, block).select(block, field("k").alias("keys"), "names", F.concat(F.array(F.lit(0)), field("e")).alias("offsets"), F.flatten(field("i")).alias("ids"))


def _owners(keys: str) -> Column:
    """For each entry of a block the key that it stands under."""
    return F.flatten(F.transform(keys, lambda k, i: F.array_repeat(k, F.get("offsets", i + 1) - F.get("offsets", i))))


def _checked(blocks: DataFrame, block: str, bad: Column, note: str) -> DataFrame:
    """blocks; a damaged one fails the query. The check stands on the block's name, so that it runs once a block."""
    return blocks.withColumn(block, refuse(F.coalesce(bad, F.lit(True)), F.lit(note), F.col(block)))


def _steps() -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("offsets") - 1), lambda n: F.get("offsets", n) - F.get("offsets", n - 1))


def decode(blocks: DataFrame, block: str, key: str, item: str) -> DataFrame:
    """The rows again; offsets that do not ascend to the end, or numbers outside the names, fail the query."""
    bad = (F.size("offsets") != F.size("keys") + 1) | (F.get("offsets", F.lit(0)) != 0) | (F.element_at("offsets", -1) != F.size("ids")) | F.exists(_steps(), lambda x: x < 0) | F.exists("ids", lambda x: (x < 0) | (x >= F.size("names")))
    named = F.transform("ids", lambda x: F.get("names", x))
    each = _checked(blocks, block, bad, "a section is damaged").select(block, F.explode(F.arrays_zip(_owners("keys").alias("k"), named.alias("i"))).alias("p"))
    return each.select(block, F.col("p.k").alias(key), F.col("p.i").alias(item))


def encode_terms(postings: DataFrame, block: str) -> DataFrame:
    """block, terms, offsets, sources, counts of postings (term, source, tf), terms sorted."""
    lists = _ends(postings.groupBy(block, "term").agg(F.array_sort(F.collect_list(F.struct("source", "tf"))).alias("_i")), block, "term")
    blocks = lists.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("term", F.col("_end").alias("e"), F.col("_i").alias("i")))).alias("_b"))
    flat = lambda f: F.flatten(F.transform("_b", lambda x: F.transform(x["i"], lambda y: y[f])))
    return blocks.select(block, F.transform("_b", lambda x: x["term"]).alias("terms"), F.concat(F.array(F.lit(0)), F.transform("_b", lambda x: x["e"])).alias("offsets"), flat("source").alias("sources"), flat("tf").alias("counts"))


def view_terms(blocks: DataFrame, block: str) -> DataFrame:
    """term, source, tf again, checked."""
    bad = (F.size("offsets") != F.size("terms") + 1) | (F.element_at("offsets", -1) != F.size("sources")) | (F.size("sources") != F.size("counts")) | (F.array_sort("terms") != F.col("terms")) | F.exists(_steps(), lambda x: x < 0)
    each = _checked(blocks, block, bad, "a term table is damaged").select(block, F.explode(F.arrays_zip(_owners("terms").alias("t"), F.col("sources").alias("s"), F.col("counts").alias("c"))).alias("p"))
    return each.select(F.col("p.t").alias("term"), F.col("p.s").alias("source"), F.col("p.c").alias("tf"))
