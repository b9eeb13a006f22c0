"""A corpus pipeline: quality rules, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Rows are
told apart by id and text: a null id is an id of its own, and rows that repeat id and text share their fate until
exact dedup leaves one. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import common, exact_dedup, packing, quality, repeats, simhash

#: Bytes that a repeated passage has at least. Fifty words with a space after each have 200 if they have three letters on
#: average, so a longer passage that repeats doesn't stay.
WINDOW = 200


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def _kept(docs: DataFrame, kept: DataFrame, ident: Column, text: Column, one: bool = False) -> DataFrame:
    """The rows of docs whose id and text are among kept (id, text); of equal ones the first alone if one is asked for."""
    keys = common.free(docs, "__id", "__text")
    met = docs.withColumns(dict(zip(keys, (ident, text)))).join(kept.toDF(*keys), keys, "left_semi")
    return (met.dropDuplicates(keys) if one else met).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    # Of equal id and text but unlike hosts, one host's verdict holds for all rows.
    return _kept(docs, quality.judge(docs).where("kept").select(_id(), "content"), _id(), quality.content_hash(F.col("text")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the smallest id."""
    kept = exact_dedup.owners(docs).where("kept").select(_id(), F.unhex("text_sha256"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), common.SPACE_CLASS, " ").cast("binary")
    return _kept(docs, kept, _id(), F.unhex(F.sha2(body, 256)), one=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints, of equal ids that with the least hash of its text."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "content")).alias("first")
    kept = simhash.near_duplicates(docs).groupBy("component").agg(first).select(_id("first.doc_id"), "first.content")
    return _kept(docs, kept, _id(), F.xxhash64(F.coalesce("text", F.lit(""))))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated passages, n_chars counted anew."""
    out = repeats.remove(docs, length=WINDOW)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("simhash_dedup", near), ("repeats", passages), ("packing", best_fit)]
ORACLE_SQL = None  # fingerprints, passages and packing can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
