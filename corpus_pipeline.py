"""A corpus pipeline of five stages, each one operator of ``tessera.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; ``run`` writes every stage as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, neardup, quality, store, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # learning, hashing into classes and Newton steps are beyond SQL; tests compare with brute force


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rule ensemble rejects (score below 0.5). It learns from the rows of ``documents`` outside the held-out fold."""
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(spark, documents, labels, learn=quality.fold() != 1)
    return _columns(quality.scored(docs.select(*COLUMNS), model).where("predicted = 1"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, the one with the smallest id; no id comes before all, and texts without words stay."""
    return neardup.first_of_classes(spark, _columns(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages. A text that loses nothing stays as it is; one that loses all goes."""
    return _columns(substring.cut_documents(spark, docs.select(*COLUMNS)).where("n_words_left > 0 or n_removed = 0"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by the copies that the mix takes."""
    mixed = mixing.mix_sources(spark, docs, keep=COLUMNS)
    copies = mixed.select(*(F.col(f"kept_{c}").alias(c) for c in COLUMNS), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies"))).alias("copy_"))
    return _columns(copies.where("copy_ > 0"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digest of what they decode to."""
    done = bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substring", substring_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.materialise(spark, stage(spark, docs, sf_dir), name)
    return docs
