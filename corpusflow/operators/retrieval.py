"""Tenant-scoped retrieval: filters, exact k-NN, distance cut-off, citation records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.vectors import relevance, similarity
from corpusflow.operators.chunk_store import ChunkStore
from corpusflow.operators.knn import nearest
from corpusflow.operators.ordered import first_rows
from corpusflow.session import staged


def tenant_scope(df: DataFrame, users: str | DataFrame) -> DataFrame:
    """Rows owned by one user id, or by any user of a key table."""
    if isinstance(users, DataFrame):
        return df.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return df.filter(F.col("user_id") == F.lit(users))


def ready_only(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "ready")


def in_flight(documents: DataFrame) -> DataFrame:
    return documents.filter(~F.col("status").isin(S.TERMINAL_STATUSES))


def document_scope(chunks: DataFrame, scope: list | DataFrame | None) -> DataFrame:
    """Restrict to the listed documents; an absent or empty list means the whole library."""
    if scope is None or (isinstance(scope, list) and not scope):
        return chunks
    if isinstance(scope, DataFrame):
        return chunks.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    return chunks.filter(F.col("document_id").isin(scope))


def same_space(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks whose owner and embedding model occur among the queries."""
    return chunks.join(
        queries.select("user_id", "embedding_model").distinct(),
        ["user_id", "embedding_model"], "left_semi",
    )


def chunks_with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Inner join on the owning document, inside the tenant."""
    names = documents.select(
        "document_id", "user_id", "status", F.col("original_filename").alias("document_name")
    )
    return chunks.join(names, ["document_id", "user_id"])


def distinct_questions(queries: DataFrame, text: str = "query") -> DataFrame:
    """One representative per identical (user, text, scope, weak-match flag) request.

    Adds ``asked_as``: the smallest query id of the same request, to join results back.
    """
    same = [c for c in ("user_id", text, "scope", "allow_weak", "embedding_model") if c in queries.columns]
    firsts = queries.groupBy(*same).agg(F.min("query_id").alias("asked_as"))
    condition = [queries[c].eqNullSafe(firsts[c]) for c in same]
    return queries.join(firsts, condition).select(queries["*"], firsts["asked_as"])


def cosine_knn(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame,
    k: int = S.RETRIEVAL_K, fetch_k: int = S.RETRIEVAL_FETCH_K, metric: str = "cosine", **blocks,
) -> DataFrame:
    """Exact filtered k-NN: the nearest ``max(k, fetch_k)`` chunks of every query."""
    return nearest(queries, chunks, max(k, fetch_k), metric, live=ready_only(documents), **blocks)


def distance_filter(candidates: DataFrame, max_distance: float, allow_weak: Column) -> DataFrame:
    """Keep candidates within ``max_distance``; with none, keep all of them if weak matches may stand in."""
    relevant = F.col("distance") <= max_distance
    any_relevant = F.max(relevant).over(Window.partitionBy("query_id"))
    return (
        candidates.withColumn("_any", any_relevant)
        .filter(relevant | (~F.col("_any") & allow_weak))
        .drop("_any")
    )


def keep_first(candidates: DataFrame, k: int = S.RETRIEVAL_K) -> DataFrame:
    """First ``k`` kept candidates per query, numbered as citations from 1."""
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    return first_rows(candidates, ["query_id"], order, k, out="index")


def citation_records(kept: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Attach content, locators and scores to the few kept chunks only."""
    wanted = chunks.select("chunk_id", "document_id", "chunk_index", "content", "metadata")
    names = documents.select("document_id", "original_filename")
    joined = kept.join(wanted, "chunk_id").join(names, "document_id")
    meta = F.col("metadata")
    name = F.coalesce(F.nullif(meta["documentName"], F.lit("")), F.col("original_filename"))
    return joined.select(
        "query_id", "index", F.lit("document").alias("type"), "chunk_id", "document_id",
        name.alias("document_name"), name.alias("title"),
        meta["page"].alias("page"), meta["slide"].alias("slide"),
        meta["paragraph"].alias("paragraph"), meta["line"].alias("line"),
        meta["table"].alias("table"),
        F.nullif(meta["section"], F.lit("")).alias("section"),
        F.nullif(meta["title"], F.lit("")).alias("slide_title"),
        "chunk_index", "content",
        F.substring("content", 1, S.SNIPPET_CHARS).alias("snippet"),
        similarity(F.col("distance")).alias("score"),
        F.round("distance", 4).alias("distance"),
    )


def retrieve(
    queries: DataFrame, chunks: DataFrame, documents: DataFrame,
    k: int = S.RETRIEVAL_K, fetch_k: int = S.RETRIEVAL_FETCH_K,
    max_distance: float = S.MAX_COSINE_DISTANCE, allow_weak: bool | None = None, **blocks,
) -> DataFrame:
    """Sources per query: k-NN, distance cut-off on the fetched rows, first ``k`` as citations.

    ``allow_weak`` overrides the per-query column of that name; without either, weak matches
    may stand in.
    """
    found = cosine_knn(queries, chunks, documents, k, fetch_k, **blocks)
    if allow_weak is None and "allow_weak" in queries.columns:
        found = found.join(queries.select("query_id", "allow_weak"), "query_id")
        weak = F.col("allow_weak")
    else:
        weak = F.lit(True if allow_weak is None else allow_weak)
    kept = keep_first(distance_filter(found, max_distance, weak), k)
    return citation_records(kept.select("query_id", "chunk_id", "distance", "index"), chunks, documents)


def retrieve_stored(
    queries: DataFrame, store: ChunkStore, documents: DataFrame, k: int = S.RETRIEVAL_K, fetch_k: int = S.RETRIEVAL_FETCH_K,
    max_distance: float = S.MAX_COSINE_DISTANCE, **blocks,
) -> DataFrame:
    """``retrieve`` over a stored chunk table.

    Vectors are read from the partitions of the asking users; content from those of the users with
    citations, where it meets them by chunk id in the buckets it is stored in.
    """
    asked = store.holding(queries)
    found = cosine_knn(queries, asked, documents, k, fetch_k, **blocks)
    kept = staged(keep_first(distance_filter(found, max_distance, F.lit(True)), k).select("query_id", "chunk_id", "distance", "index"), "kept")
    cited = kept.join(queries.select("query_id", "user_id"), "query_id")
    return citation_records(kept, store.holding(cited), documents)


def l2_retrieve(
    queries: DataFrame, chunks: DataFrame,
    k: int = S.RETRIEVAL_K, fetch_k: int = S.RETRIEVAL_FETCH_K,
    max_distance: float = S.MAX_L2_DISTANCE, metric: str = "l2", **blocks,
) -> DataFrame:
    """Older distance-scored search: all fetched rows stand in when none is close enough."""
    found = nearest(queries, chunks, max(k, fetch_k), metric, **blocks)
    kept = keep_first(distance_filter(found, max_distance, F.lit(True)), k)
    return kept.select(
        "query_id", "chunk_id", "index", relevance(F.col("distance")).alias("score"),
        F.round("distance", 4).alias("distance"),
    )


def score_threshold_retrieve(
    queries: DataFrame, chunks: DataFrame, threshold: float = 0.1, k: int = S.RETRIEVAL_K, **blocks
) -> DataFrame:
    """The ``k`` nearest whose similarity reaches the threshold."""
    found = nearest(queries, chunks, k, "cosine", **blocks)
    return found.filter(1.0 - F.col("distance") >= threshold).select(
        "query_id", "chunk_id", F.col("rank").alias("index"),
        similarity(F.col("distance")).alias("score"),
    )


def locators(source: Column) -> Column:
    """Citation locators: page and slide when known, paragraph and line only without either."""
    bare = source["page"].isNull() & source["slide"].isNull()
    return F.array_compact(
        F.array(
            F.concat(F.lit("p. "), source["page"].cast("string")),
            F.concat(F.lit("slide "), source["slide"].cast("string")),
            F.when(bare, F.concat(F.lit("¶ "), source["paragraph"].cast("string"))),
            F.when(bare, F.concat(F.lit("line "), source["line"].cast("string"))),
            F.nullif(source["section"], F.lit("")),
        )
    )


def hybrid_sources(document_sources: DataFrame, web_sources: DataFrame) -> DataFrame:
    """Document sources first, then web sources, renumbered from 1 per query.

    Document sources are numbered without gaps, so a web source only needs the number of
    document sources before it: one small aggregate instead of a window over both.
    """
    counts = document_sources.groupBy("query_id").agg(F.count("*").alias("_before"))
    moved = (
        web_sources.withColumn("type", F.lit("web")).join(counts, "query_id", "left")
        .withColumn("index", (F.col("index") + F.coalesce("_before", F.lit(0))).cast("int"))
        .drop("_before")
    )
    return document_sources.unionByName(moved, allowMissingColumns=True)


def _left_join_nullable(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join by a key that may be null in many rows.

    Rows without a key match nothing, but would all meet in one task. A second key spreads them: the hash of the
    key, or of the whole row where there is none.
    """
    def by(df: DataFrame, fallback: Column) -> DataFrame:
        text = F.col(key).cast("string")
        return df.withColumn("_place", F.when(text.isNull(), fallback).otherwise(F.xxhash64(text)))

    spread = by(left, F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]))
    return spread.join(by(right, F.lit(None).cast("bigint")), [key, "_place"], "left").drop("_place")


def resolved_citations(sources: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Citation to chunk to document by nullable keys; both sides may be gone.

    Citations of web pages have neither key; they are spread over all tasks.
    """
    wanted = chunks.select("chunk_id", "chunk_index", F.col("document_id").alias("chunk_document_id"))
    names = documents.select("document_id", "original_filename")
    return _left_join_nullable(_left_join_nullable(sources, wanted, "chunk_id"), names, "document_id")


def approx_knn(
    queries: DataFrame, chunks: DataFrame, nlist: int = 16, nprobe: int = 4,
    n: int = S.RETRIEVAL_FETCH_K, seed: int = 7, **blocks,
) -> DataFrame:
    """Coarse quantiser: k-means lists, ``nprobe`` lists per query, exact ranking inside them.

    The centroids are ``nlist`` x dimension numbers whatever the table size; vectors are
    normalised first so that Euclidean lists follow the cosine order.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))
    training = chunks.withColumn("_norm", norm).filter("_norm > 0").select(
        array_to_vector(unit).alias("features")
    )
    model = KMeans(k=nlist, seed=seed, maxIter=10, initMode="random").fit(training)
    centres = np.vstack(model.clusterCenters())
    shared = chunks.sparkSession.sparkContext.broadcast(centres)

    def lists(df: DataFrame, probes: int) -> DataFrame:
        @F.pandas_udf("array<int>")
        def closest(vectors: pd.Series) -> pd.Series:
            matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
            scores = (shared.value**2).sum(axis=1)[None, :] - 2.0 * matrix @ shared.value.T
            return pd.Series(list(np.argsort(scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return df.withColumn("list_id", F.explode(closest("embedding")))

    probes = min(nprobe, len(centres))
    probed = lists(queries, probes)
    return nearest(
        probed, lists(chunks, 1), n, "cosine",
        keys=("user_id", "embedding_model", "list_id"), **blocks,
    )
