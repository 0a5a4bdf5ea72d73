"""A training corpus from the documents table: filter, dedup, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and
read again as the next stage's documents. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.benchmark_hits import find_hits
from corpusflow.llm.bpe_codec import decode_documents, encode_documents
from corpusflow.llm.near_duplicates import drop_near_duplicates
from corpusflow.llm.quality_rules import judge
from corpusflow.llm.repeated_phrases import remove_repeats
from corpusflow.llm.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged = judge(docs)
    return judged.where(F.col(judged.columns[-1])).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest id stays."""
    return drop_near_duplicates(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first document; texts without any stay as they are."""
    cut = remove_repeats(docs)
    spans, kept = cut.columns[-2:]
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.col(kept))
    changed = {"text": text} | ({"n_chars": F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length(kept).cast("bigint"))} if "n_chars" in docs.columns else {})
    return cut.withColumns(changed).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size(found.columns[-2]) == 0).select(docs.columns)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the token ids, and digest of what they decode to."""
    encoded = encode_documents(docs.select("doc_id", "text")).select("doc_id", "token_ids")
    return decode_documents(encoded).select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe codec", bpe_codec),
]

#: The last stages' results can't be expressed in SQL; tests compare the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
