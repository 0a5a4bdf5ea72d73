"""Constraint reports and embedding guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.vectors import cosine_distance


def _rules() -> dict[str, dict[str, Column]]:
    return {
        "users": {
            "name_not_null": F.col("name").isNotNull(),
            "email_not_null": F.col("email").isNotNull(),
            "auth_method_present": F.col("password_hash").isNotNull() | F.col("google_id").isNotNull(),
        },
        "sessions": {
            "user_id_not_null": F.col("user_id").isNotNull(),
            "expires_at_not_null": F.col("expires_at").isNotNull(),
        },
        "documents": {
            "user_id_not_null": F.col("user_id").isNotNull(),
            "status_known": F.col("status").isin(S.DOCUMENT_STATUSES),
        },
        "chunks": {
            "content_not_null": F.col("content").isNotNull(),
            "embedding_not_null": F.col("embedding").isNotNull(),
            "embedding_model_not_null": F.col("embedding_model").isNotNull(),
        },
        "conversations": {
            "title_not_null": F.col("title").isNotNull(),
            "mode_known": F.col("mode").isin(S.CONVERSATION_MODES),
        },
        "messages": {
            "content_not_null": F.col("content").isNotNull(),
            "role_known": F.col("role").isin(S.MESSAGE_ROLES),
        },
    }


def check_constraints(df: DataFrame, table: str, key: str) -> DataFrame:
    """``(table_name, rule, row_key)`` per violated rule, found in one pass over the table."""
    rules = _rules()[table]
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule")).select(
        F.lit(table).alias("table_name"), "rule", "row_key"
    )


def unique_violations(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """Values of a unique key held by more than one row; null keys do not count."""
    key = [c.alias(f"k{i}") for i, c in enumerate(columns)]
    named = [f"k{i}" for i in range(len(columns))]
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in named])
    grouped = df.select(*key).filter(present).groupBy(*named).agg(F.count("*").alias("holders"))
    return grouped.filter("holders > 1").select(
        F.lit(name).alias("rule"), F.concat_ws("|", *named).alias("row_key"), "holders"
    )


def embedding_guard(chunks: DataFrame, dimension: int | None) -> DataFrame:
    """Per document: vector count, model mix, dimension range and the reasons to reject it.

    Without ``dimension`` the vectors of a document only have to agree with each other.
    """
    report = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.count("embedding").alias("vectors"),
        (F.min("embedding_model") != F.max("embedding_model")).alias("mixed_models"),
        F.min(F.size("embedding")).alias("min_dim"), F.max(F.size("embedding")).alias("max_dim"),
    )
    wrong = F.col("min_dim") != F.col("max_dim")
    if dimension is not None:
        wrong = (F.col("min_dim") != dimension) | (F.col("max_dim") != dimension)
    reason = F.concat_ws(
        ",",
        F.when(F.col("chunks") != F.col("vectors"), "EMBEDDING_MISMATCH"),
        F.when(wrong, "DIMENSION_MISMATCH"),
        F.when(F.col("mixed_models"), "MIXED_MODELS"),
    )
    return report.withColumn("violations", reason)


def space_compatibility(left: DataFrame, right: DataFrame, key: str = "text_id") -> DataFrame:
    """Smallest and mean cosine similarity between two providers' vectors of the same texts."""
    a = left.select(key, F.col("embedding").alias("_a"), F.col("embedding_model").alias("_ma"))
    b = right.select(key, F.col("embedding").alias("_b"), F.col("embedding_model").alias("_mb"))
    similarity = F.lit(1.0) - cosine_distance(F.col("_a"), F.col("_b"))
    return a.join(b, key).agg(
        F.count("*").alias("texts"), F.min(similarity).alias("min_similarity"),
        F.bool_and(F.col("_ma") == F.col("_mb")).alias("same_model"),
    ).withColumn("compatible", F.col("min_similarity") > 0.999)
