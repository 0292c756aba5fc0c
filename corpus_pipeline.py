"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.

1. Quality rules: documents that break a rule go.
2. Near-duplicates on five-word shingles: the smallest id of each group stays.
3. Secret scans: secrets are replaced by a mark; a document stays whole otherwise.
4. Mixing: documents of sources below their target repeat, those above it are thinned.
5. Packing: pieces of sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogue_lake.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from dialogue_lake.llm import textual as tx

SHINGLE_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.components_of(docs, words=SHINGLE_WORDS)
    gone = found.filter("id != component_id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Confirming near-duplicates and tokenizing are beyond SQL; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tx.stored(stage(spark, docs, sf_dir), name)
    return docs
