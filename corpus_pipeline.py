"""A training corpus in four stages: language ID, near-dedup, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airside.llm import langid, mixing, neardup, packing
from airside.llm.common import materialise, table


#: A text that costs more than so many times the usual bits a byte of its language is in none that was learned.
STRANGE = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that some learned language codes about as short as its other documents.

    Null and empty texts and texts without a letter go, and texts that cost more than STRANGE
    times the median bits a byte of the documents found to be in the same language (other
    scripts, random characters). A missing language label is filled in. Nothing learned: all go.
    """
    model = langid.train(docs.where(~langid.held_out()))
    found = materialise(langid.identify(docs, model).where("lang_pred <> 'und'"), "languages")
    usual = found.groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", F.lit(0.5), F.lit(1000)).alias("usual"))  # a row for each language
    kept = found.join(F.broadcast(usual), "lang_pred").where(F.col("bits_per_byte") <= STRANGE * F.col("usual"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of (near) copies, each of its rows once.

    Rows that are equal in all columns are one; differing texts of one doc_id are one document
    and stay or go together. Rows without a doc_id are no one's copies, but equal ones are one.
    """
    keepers = neardup.groups(docs).where(F.col("doc_id") == F.col("group_id")).select("doc_id").distinct()
    kept = docs.join(keepers, "doc_id", "left_semi").select(*docs.columns)
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.unionByName(docs.where("doc_id IS NULL")).dropDuplicates()
    else:
        kept = kept.unionByName(docs.where("doc_id IS NULL"))
    return kept


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and forms meet their target weights."""
    return mixing.mix(docs, mixing.form_topic(F.col("text")), mixing.form_targets).where("mix_kept").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), [0], 2048, keep_ids=False)


STAGES = [("language ID", language), ("near-dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Not expressible in SQL: trained language models and a tokenizer. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{n + 1}")
    return docs
