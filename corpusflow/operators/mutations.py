"""Changes to stored tables as (base, changes) -> next snapshot.

Plain Parquet has no row-level update, so each function returns the new version of a
table. Keys of a change set are joined by hash; the victim side is reduced to its keys
first, so wide rows move only when the planner has no broadcast-sized key set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S

# Fixed value: message of documents found unfinished at start.
INTERRUPTED_MESSAGE = "Processing was interrupted. Please upload the document again."


# --- appends -------------------------------------------------------------------


def append_chunks(new_chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk rows to append: the document must still exist for that user and a model must be named."""
    model = F.when(
        F.coalesce(F.length("embedding_model"), F.lit(0)) == 0,
        F.raise_error(F.lit("append_chunks requires embedding_model")),
    ).otherwise(F.col("embedding_model"))
    live = documents.select("document_id", "user_id")
    return new_chunks.join(live, ["document_id", "user_id"], "left_semi").withColumn("embedding_model", model)


def write_chunks(new_chunks: DataFrame, documents: DataFrame, path: str, user_buckets: int = 256) -> None:
    """Append to a chunk table laid out by user bucket and sorted by (user, model).

    Users are hashed into buckets because one directory per user would mean millions of them. The
    rebalance hint lets adaptive execution cut the share of a large tenant into files of ordinary
    size and merge the small ones, so no task writes a whole hot bucket.
    """
    rows = append_chunks(new_chunks, documents).withColumn(
        "user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(user_buckets)).cast("int")
    )
    (
        rows.hint("rebalance", "user_bucket").sortWithinPartitions("user_bucket", "user_id", "embedding_model")
        .write.mode("append").partitionBy("user_bucket").parquet(path)
    )


def append_messages_with_sources(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Message rows and their citation rows; the position is the array index."""
    messages = turns.select("message_id", "conversation_id", "role", "content", "metadata", "created_at")
    exploded = turns.select("message_id", F.posexplode("sources").alias("position", "source"))
    sources = exploded.select(
        "message_id", F.col("source.document_id").alias("document_id"),
        F.col("source.chunk_id").alias("chunk_id"), "position", F.to_json("source").alias("metadata"),
    )
    return messages, sources


def append_documents(uploads: DataFrame, as_of: Column) -> DataFrame:
    """New document rows with their defaults; the key is derived, so a rerun writes the same row."""
    return uploads.select(
        F.sha2(F.concat_ws("|", "user_id", "content_hash"), 256).alias("document_id"),
        "user_id", "name", "original_filename",
        F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"),
        "file_size", "storage_key", "content_hash", F.lit("pending").alias("status"),
        F.lit(0).alias("chunk_count"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )


def append_conversations(requests: DataFrame, as_of: Column) -> DataFrame:
    """New conversations: title ``New chat`` and mode ``document`` unless given."""
    return requests.select(
        "conversation_id", "user_id", F.coalesce("title", F.lit("New chat")).alias("title"),
        F.coalesce("mode", F.lit("document")).alias("mode"), "document_id",
        F.lit(False).alias("pinned"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )


# --- updates -------------------------------------------------------------------


def one_per_key(changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last change of each key, so that a batch with several never multiplies base rows.

    ``order`` names the column that tells the last one; without it (and among equals) the largest
    values win, which is the same choice in every run. Rows with a null key change nothing.
    """
    rest = sorted((c for c in changes.columns if c not in keys), key=lambda c: c != order)
    rank = F.struct(*[F.col(c) for c in rest])
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    folded = changes.filter(present).groupBy(*keys).agg(F.max(rank).alias("_last"))
    return folded.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest])


def apply_document_status(documents: DataFrame, changes: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Apply the last change of each document (by ``order``, a column of the changes).

    Status and error fields are replaced; chunk_count, extraction_info and progress keep their
    value when the change carries null.
    """
    changes = one_per_key(changes, ["document_id"], order)
    changed = changes.select("document_id", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "document_id"])
    joined = documents.join(changed, "document_id", "left")
    hit = F.col("_status").isNotNull()
    have = set(changes.columns)
    updates = {"status": F.coalesce("_status", "status"), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}
    for name in ("error_message", "error_code"):
        new = F.col(f"_{name}") if name in have else F.lit(None).cast("string")
        updates[name] = F.when(hit, new).otherwise(F.col(name))
    for name in ("chunk_count", "extraction_info", "progress"):
        if name in have and name in documents.columns:
            updates[name] = F.coalesce(f"_{name}", name)
    return joined.withColumns(updates).select(*documents.columns)


def apply_progress(documents: DataFrame, changes: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Replace only the progress counters, by the last change of each document."""
    last = one_per_key(changes, ["document_id"], order)
    joined = documents.join(last.select("document_id", F.col("progress").alias("_p")), "document_id", "left")
    hit = F.col("_p").isNotNull()
    return joined.withColumns(
        {"progress": F.coalesce("_p", "progress"), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}
    ).select(*documents.columns)


def fail_stale_documents(documents: DataFrame, as_of: Column) -> DataFrame:
    """Every unfinished document becomes failed / INTERRUPTED."""
    stale = ~F.col("status").isin(S.TERMINAL_STATUSES)
    return documents.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            "error_message": F.when(stale, INTERRUPTED_MESSAGE).otherwise(F.col("error_message")),
            "error_code": F.when(stale, "INTERRUPTED").otherwise(F.col("error_code")),
            "updated_at": F.when(stale, as_of).otherwise(F.col("updated_at")),
        }
    )


def patch_conversations(conversations: DataFrame, patches: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Owned patches, the last of each conversation: title and mode when not null; document_id only
    when the patch contains it."""
    p = one_per_key(patches, ["conversation_id", "user_id"], order).select(
        "conversation_id", "user_id", F.col("title").alias("_title"), F.col("mode").alias("_mode"),
        F.col("document_id").alias("_document_id"), F.col("has_document_id").alias("_has"),
        F.lit(True).alias("_hit"),
    )
    joined = conversations.join(p, ["conversation_id", "user_id"], "left")
    return joined.withColumns(
        {
            "title": F.coalesce("_title", "title"), "mode": F.coalesce("_mode", "mode"),
            "document_id": F.when(F.col("_has"), F.col("_document_id")).otherwise(F.col("document_id")),
            "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")),
        }
    ).select(*conversations.columns)


def touch_conversations(conversations: DataFrame, touched: DataFrame, as_of: Column) -> DataFrame:
    keys = touched.select("conversation_id", "user_id").distinct().withColumn("_hit", F.lit(True))
    joined = conversations.join(keys, ["conversation_id", "user_id"], "left")
    return joined.withColumn(
        "updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))
    ).select(*conversations.columns)


def set_pinned(conversations: DataFrame, pins: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Pin or unpin owned conversations, by the last request of each; the pin time is set or cleared with it."""
    p = one_per_key(pins, ["conversation_id", "user_id"], order).select("conversation_id", "user_id", F.col("pinned").alias("_pin"))
    joined = conversations.join(p, ["conversation_id", "user_id"], "left")
    return joined.withColumns(
        {
            "pinned": F.coalesce("_pin", "pinned"),
            "pinned_at": F.when(F.col("_pin"), as_of).when(~F.col("_pin"), F.lit(None)).otherwise(F.col("pinned_at")),
        }
    ).select(*conversations.columns)


# --- deletes -------------------------------------------------------------------


def delete_using(base: DataFrame, victims: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Survivors and victims of ``DELETE ... USING``."""
    wanted = victims.select(*keys).distinct()
    return base.join(wanted, keys, "left_anti"), base.join(wanted, keys, "left_semi")


def delete_documents(documents: DataFrame, chunks: DataFrame, requests: DataFrame):
    """Delete owned documents with their chunks.

    Returns (documents, chunks, report); the report has the storage key and the deleted chunk count.
    """
    keys = ["document_id", "user_id"]
    kept, gone = delete_using(documents, requests, keys)
    kept_chunks, gone_chunks = delete_using(chunks, gone, keys)
    counts = gone_chunks.groupBy(*keys).agg(F.count("*").alias("n"))
    report = gone.select(*keys, "storage_key").join(counts, keys, "left").select(
        *keys, "storage_key", F.coalesce("n", F.lit(0)).alias("deleted_chunks")
    )
    return kept, kept_chunks, report


def set_null_where_deleted(rows: DataFrame, column: str, victims: DataFrame, victim_key: str) -> DataFrame:
    """``ON DELETE SET NULL``: clear references to the victims, which are far fewer than what lives on.

    Rows without a reference stay out of the join, where they would all meet in one task.
    """
    keys = victims.select(F.col(victim_key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    joined = rows.filter(F.col(column).isNotNull()).join(keys, column, "left")
    cleared = joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*rows.columns)
    return cleared.unionByName(rows.filter(F.col(column).isNull()))


def delete_with_references(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Delete owned documents with their chunks; conversations and citations lose their references.

    ``tables``: documents, chunks, conversations, sources. ``requests``: document_id, user_id.
    """
    keys = ["document_id", "user_id"]
    kept, gone = delete_using(tables["documents"], requests, keys)
    kept_chunks, gone_chunks = delete_using(tables["chunks"], gone, keys)
    sources = set_null_where_deleted(tables["sources"], "chunk_id", gone_chunks, "chunk_id")
    return {
        "documents": kept, "chunks": kept_chunks,
        "conversations": set_null_where_deleted(tables["conversations"], "document_id", gone, "document_id"),
        "sources": set_null_where_deleted(sources, "document_id", gone, "document_id"),
    }


def cascade_delete(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Remove users and everything the foreign keys tie to them.

    ``tables``: users, sessions, documents, chunks, conversations, messages, sources. Tables with
    an owner column are cut by it directly; messages and citations by their deleted parent.
    """
    gone = users.select("user_id").distinct()
    out = {name: tables[name].join(gone, "user_id", "left_anti")
           for name in ("users", "sessions", "documents", "chunks", "conversations")}
    lost = {name: tables[name].join(gone, "user_id", "left_semi") for name in ("documents", "chunks", "conversations")}
    out["conversations"] = set_null_where_deleted(out["conversations"], "document_id", lost["documents"], "document_id")
    out["messages"], lost_messages = delete_using(tables["messages"], lost["conversations"], ["conversation_id"])
    sources = delete_using(tables["sources"], lost_messages, ["message_id"])[0]
    sources = set_null_where_deleted(sources, "chunk_id", lost["chunks"], "chunk_id")
    out["sources"] = set_null_where_deleted(sources, "document_id", lost["documents"], "document_id")
    return out


def delete_conversations(conversations: DataFrame, messages: DataFrame, sources: DataFrame, requests: DataFrame):
    """Delete owned conversations with their messages and citations."""
    kept, gone = delete_using(conversations, requests, ["conversation_id", "user_id"])
    kept_messages, gone_messages = delete_using(messages, gone, ["conversation_id"])
    return kept, kept_messages, delete_using(sources, gone_messages, ["message_id"])[0]


def clear_messages(conversations: DataFrame, messages: DataFrame, requests: DataFrame):
    """Empty owned conversations; returns (messages, deleted count per conversation)."""
    owned = conversations.join(
        requests.select("conversation_id", "user_id").distinct(), ["conversation_id", "user_id"], "left_semi"
    )
    kept, gone = delete_using(messages, owned, ["conversation_id"])
    return kept, gone.groupBy("conversation_id").agg(F.count("*").alias("deleted"))


def purge_expired_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > as_of)


def live_sessions(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") > as_of)


def sessions_with_users(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    profile = users.select("user_id", "name", "email")
    return live_sessions(sessions, as_of).join(profile, "user_id")


def revoke_user_sessions(sessions: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors and the revoked session ids of the given users."""
    kept, gone = delete_using(sessions, users, ["user_id"])
    return kept, gone.select("session_id", "user_id")


def users_by_email(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Users whose address equals a wanted one, ignoring case."""
    wanted = emails.select(F.lower("email").alias("_email")).distinct()
    return users.withColumn("_email", F.lower("email")).join(wanted, "_email").drop("_email")


def rollback_empty_conversations(conversations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Remove new conversations whose first turn ended in an error without an answer.

    ``outcomes``: conversation_id, user_id, is_new, had_messages, has_answer, has_error.
    """
    empty = outcomes.filter("is_new and not had_messages and has_error and not has_answer")
    return delete_using(conversations, empty, ["conversation_id", "user_id"])[0]
