"""A corpus pipeline: toxic documents go, near-duplicates and secrets go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result and reads it again for
the next. All but the last return the columns of documents.

Defined results: null and empty texts pass toxicity by their score, are one class of near-duplicates, hold no secret,
and have size 0, so that the mix takes none; texts of any length are worked on whole; of near-duplicates of one least id
the first row stays; rows that are repeated by the mix are encoded as often; empty tables give empty tables. Further
columns come through all stages but the last, whatever their names; only doc_id, text, source and n_chars are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import bpe_encode
from lodestone.llm.mixing import mix
from lodestone.llm.near_dup import drop_near_duplicates
from lodestone.llm.secrets import redact
from lodestone.llm.toxicity import drop_toxic
from lodestone.session import remove, scratch, shared_path, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model doesn't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: one of its least id."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets of their texts blotted out."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    into = "mix"
    while into in docs.columns:
        into += "_"
    got = mix(docs, 7, into)
    often = F.explode(F.sequence(F.lit(1), F.col(into).copies.cast("int"))).alias(into)
    return got.filter(F.col(into).copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns], often).drop(into)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with its number of ids and the digests of ids and decoding."""
    return bpe_encode(docs, with_ids=False)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("bpe", bpe)]

#: No SQL: trees, signatures, alignment to budgets and BPE can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage works with goes when its result is written, and its input after that."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, at)
        if before:
            remove(spark, before)
        before = at
    return docs
