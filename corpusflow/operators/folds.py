"""Folding event logs into current rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import strip
from corpusflow.operators.context import ordered_concat

TOKEN_SLAB = 1024
# Replies recorded for an answer that ended without content.
EMPTY_RESPONSE = "EMPTY_RESPONSE"


def latest_value(column: str, order: str) -> Column:
    """Aggregate: last non-null value. Merges partially, so a hot key never meets in one task unreduced."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order)))


def latest_per_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Whole latest row per key, as one hash aggregate."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def document_state(events: DataFrame) -> DataFrame:
    """Current state per document from its processing events.

    ``events``: document_id, seq, type (status / chunks / result / error), stage, page, pages,
    ocrPages, block, blocks, count, index, batches, code, message. Counters appear only once
    measured; the chunk total is known when the result event arrives.
    """
    status = F.col("type") == "status"
    frames = F.col("type") == "chunks"
    result = F.col("type") == "result"
    error = F.col("type") == "error"
    measured = {
        name: F.max_by(F.col(name), F.when(status & F.col(name).isNotNull(), F.col("seq"))).alias(name)
        for name in ("page", "pages", "ocrPages", "block", "blocks")
    }
    folded = events.groupBy("document_id").agg(
        *measured.values(),
        F.bool_or(status & (F.col("stage") == "ocr")).alias("_ocr"),
        F.bool_or(frames).alias("_embedding"), F.bool_or(result).alias("_result"),
        F.bool_or(error).alias("_error"),
        F.min_by("code", F.when(error, F.col("seq"))).alias("_code"),
        F.min_by("message", F.when(error, F.col("seq"))).alias("_message"),
        F.coalesce(F.sum(F.when(frames, F.col("count"))), F.lit(0)).alias("_chunks"),
        F.max_by("index", F.when(frames, F.col("seq"))).alias("_batches"),
        F.max(F.when(result, F.col("batches"))).alias("_batches_total"),
    )
    return judged_state(folded)


def judged_state(folded: DataFrame) -> DataFrame:
    """State, outcome and counters of documents from their folded events."""
    nothing = F.col("_result") & (F.col("_chunks") == 0)
    failed = F.col("_error") | nothing
    done = F.col("_result") & ~failed
    state = (
        F.when(failed, "failed").when(done, "ready").when(F.col("_embedding"), "embedding")
        .when(F.col("_ocr"), "ocr").otherwise("extracting")
    )
    total = F.coalesce("_batches_total", "_batches")
    return folded.select(
        "document_id", state.alias("status"),
        F.when(F.col("_error"), F.coalesce("_code", F.lit("EXTRACTION_FAILED")))
        .when(nothing, "NO_TEXT_EXTRACTED").alias("error_code"),
        F.when(F.col("_error"), F.col("_message"))
        .when(nothing, "Could not extract readable text from this document.").alias("error_message"),
        F.when(failed, 0).otherwise(F.col("_chunks")).cast("bigint").alias("chunk_count"),
        F.when(done, F.col("pages")).when(~failed, F.col("page")).alias("page"),
        F.when(~failed, F.col("pages")).alias("pages"),
        F.when(~failed, F.col("ocrPages")).alias("ocr_pages"),
        F.when(~failed & ~done, F.col("block")).alias("block"),
        F.when(~failed & ~done, F.col("blocks")).alias("blocks"),
        F.when(done, total).when(~failed, F.col("_batches")).alias("batches"),
        F.when(done, total).alias("batches_total"),
        F.when(done, F.col("_chunks")).alias("chunks_total"),
    )


def assemble_answers(events: DataFrame) -> DataFrame:
    """Answer, critique and outcome per message from its generation events.

    ``events``: message_id, seq, type (token / critique_token / status / done / error), text,
    finish_reason, code, message, optional aborted flag. Token texts are joined in two steps, by
    slabs of the sequence number, so a very long answer is not sorted in one piece.
    """
    kinds = F.when(F.col("type") == "token", "content").when(F.col("type") == "critique_token", "critique")
    pieces = events.withColumn("_kind", kinds).filter("_kind is not null").withColumn(
        "_slab", F.floor(F.col("seq") / TOKEN_SLAB)
    )
    parts = pieces.groupBy("message_id", "_kind", "_slab").agg(ordered_concat("text", "seq", "").alias("_part"))
    texts = parts.groupBy("message_id", "_kind").agg(ordered_concat("_part", "_slab", "").alias("_text"))
    both = texts.groupBy("message_id").agg(
        F.max(F.when(F.col("_kind") == "content", F.col("_text"))).alias("content"),
        F.max(F.when(F.col("_kind") == "critique", F.col("_text"))).alias("critique"),
    )
    ending = F.col("type").isin("done", "error")
    aborted = F.bool_or(F.col("aborted")) if "aborted" in events.columns else F.lit(False)
    reason = F.when(F.col("type") == "error", "error").otherwise(
        F.coalesce(F.nullif("finish_reason", F.lit("")), F.lit("stop"))
    )
    is_error = F.col("type") == "error"
    outcome = events.groupBy("message_id").agg(
        F.max_by(reason, F.when(ending, F.col("seq"))).alias("_reason"),
        F.max_by(
            F.coalesce(F.nullif("code", F.lit("")), F.lit("RAG_ERROR")), F.when(is_error, F.col("seq"))
        ).alias("_code"),
        aborted.alias("_aborted"), F.count_if(F.col("type") == "token").alias("tokens"),
    )
    joined = outcome.join(both, "message_id", "left")
    content = F.coalesce("content", F.lit(""))
    base = F.coalesce("_reason", F.lit("stop"))
    reached = F.when(F.col("_aborted") & (base != "error"), "aborted").otherwise(base)
    empty = (F.length(strip(content)) == 0) & F.col("_code").isNull() & (reached == "stop")
    critique = F.when(F.length(strip(F.coalesce("critique", F.lit("")))) > 0, F.col("critique"))
    return joined.select(
        "message_id", content.alias("content"), critique.alias("critique"), "tokens",
        F.when(empty, "error").otherwise(reached).alias("finish_reason"),
        F.when(empty, EMPTY_RESPONSE).otherwise(F.col("_code")).alias("error_code"),
    )
