"""Document library: counts, duplicates, upload validation, progress description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.text import file_extension, let
from corpusflow.operators.retrieval import ready_only


def list_documents(documents: DataFrame, user_id: str | None = None) -> DataFrame:
    """A user's library (or everybody's, by user), newest first."""
    rows = documents if user_id is None else documents.filter(F.col("user_id") == user_id)
    return rows.orderBy("user_id", F.col("created_at").desc(), "document_id")


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("user_id").agg(F.count("*").alias("total"))


def count_ready_documents(documents: DataFrame) -> DataFrame:
    return ready_only(documents).groupBy("user_id").agg(F.count("*").alias("total"))


def count_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    owners = conversations.select("conversation_id", "user_id")
    return messages.join(owners, "conversation_id").groupBy("user_id", "conversation_id").agg(
        F.count("*").alias("total")
    )


def usage_stats(users: DataFrame, conversations: DataFrame, documents: DataFrame, chunks: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations, documents, chunks and messages per user; zero where there are none.

    Messages are counted per conversation before the join, so the join carries one row per
    conversation instead of one per message.
    """
    per_conversation = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    talks = conversations.select("conversation_id", "user_id").join(per_conversation, "conversation_id", "left")
    counted = talks.groupBy("user_id").agg(
        F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages")
    )
    docs = documents.groupBy("user_id").agg(F.count("*").alias("documents"))
    vectors = chunks.groupBy("user_id").agg(F.count("*").alias("chunks"))
    out = users.select("user_id")
    for part in (counted, docs, vectors):
        out = out.join(part, "user_id", "left")
    return out.fillna(0, ["conversations", "messages", "documents", "chunks"])


def library_totals(documents: DataFrame) -> DataFrame:
    return documents.groupBy("user_id").agg(
        F.count("*").alias("documents"), F.sum("file_size").alias("total_bytes")
    )


def dedupe_against_library(new_files: DataFrame, documents: DataFrame) -> DataFrame:
    """``action`` per new file by (owner, content hash): reuse, conflict, replace or new.

    The library is reduced to one row per (owner, hash) first: the best status wins, as the
    key is unique there and copies must not multiply the new files.
    """
    order = F.when(F.col("status") == "ready", 0).when(F.col("status") == "failed", 2).otherwise(1)
    known = documents.filter("content_hash is not null").groupBy("user_id", "content_hash").agg(
        F.min(F.struct(order.alias("o"), "document_id")).alias("best")
    )
    action = (
        F.when(F.col("best.o") == 0, "reuse").when(F.col("best.o") == 1, "conflict")
        .when(F.col("best.o") == 2, "replace").otherwise("new")
    )
    joined = new_files.join(known, ["user_id", "content_hash"], "left")
    return joined.select(
        *[new_files[c] for c in new_files.columns if c not in ("user_id", "content_hash")],
        "user_id", "content_hash", action.alias("action"), F.col("best.document_id").alias("existing_id"),
    )


def duplicate_documents(documents: DataFrame) -> DataFrame:
    """Owner and hash pairs stored more than once, with the copy that stays."""
    return documents.groupBy("user_id", "content_hash").agg(
        F.count("*").alias("copies"), F.min("document_id").alias("kept_id")
    ).filter("copies > 1")


def distinct_user_files(documents: DataFrame) -> DataFrame:
    """One row per (owner, content hash): the copy with the smallest id (hash-aggregated)."""
    return documents.groupBy("user_id", "content_hash").agg(F.min("document_id").alias("document_id"))


def catalog_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Listing of several folders, each content once, with index status and chunk count.

    ``files``: path, name, size, content_hash (a path may be listed by several folders).
    ``chunks``: content_hash per chunk.
    """
    best = files.groupBy("content_hash").agg(F.min(F.struct("path", "name", "size")).alias("f"))
    counts = chunks.groupBy("content_hash").agg(F.count("*").alias("chunks"))
    joined = best.join(counts, "content_hash", "left")
    total = F.coalesce("chunks", F.lit(0))
    return joined.select(
        F.col("content_hash").alias("id"), "f.name", "f.path", F.col("f.size").alias("size_bytes"),
        (total > 0).alias("indexed"), total.alias("chunks"),
    )


def unavailable_formats(accepted: DataFrame, supported: DataFrame) -> DataFrame:
    """Accepted extensions that cannot be processed."""
    return accepted.join(supported, "extension", "left_anti")


# Accepted uploads.
ALLOWED_EXTENSIONS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".txt", ".md"]
ALLOWED_MIME_TYPES = [
    "application/pdf", "text/plain", "text/markdown", "text/x-markdown", "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-powerpoint",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
]
# Leading bytes of refused programs and of the document containers.
DANGEROUS_PREFIXES = ["4D5A", "7F454C46", "CFFAEDFE", "CAFEBABE", "2321"]
CONTAINER_PREFIXES = {
    "pdf": ["25504446"],
    "zip": ["504B0304", "504B0506", "504B0708"],
    "ole2": ["D0CF11E0A1B11AE1"],
}
CONTAINER_OF = {
    ".pdf": "pdf", ".docx": "zip", ".pptx": "zip", ".doc": "ole2", ".ppt": "ole2",
    ".txt": "text", ".md": "text",
}
SNIFF_BYTES = 4096


def looks_like_text(content: Column) -> Column:
    """Leading bytes hold no NUL, are valid UTF-8 and have fewer than 5 % control characters.

    A character cut by the sniffed length reads as invalid.
    """
    text = F.try_validate_utf8(F.substring(content, 1, SNIFF_BYTES).cast("string"))

    def plain(t: Column) -> Column:
        control = F.regexp_count(t, F.lit(r"[\x00-\x08\x0E-\x1F]"))
        # A stored replacement character is indistinguishable from a decoding failure.
        bad = F.contains(t, F.lit("\ufffd")) | F.contains(t, F.lit("\x00"))
        return F.coalesce(~bad & (control / F.greatest(F.length(t), F.lit(1)) < 0.05), F.lit(False))

    return let(text, plain)


def container_kind(content: Column) -> Column:
    """executable, pdf, zip, ole2, empty, text or unknown from the leading bytes."""
    def sniffed(head: Column) -> Column:
        def begins(prefixes: list[str]) -> Column:
            out = F.lit(False)
            for prefix in prefixes:
                out = out | F.startswith(head, F.lit(prefix))
            return out

        out = F.when(begins(DANGEROUS_PREFIXES), "executable")
        for kind, prefixes in CONTAINER_PREFIXES.items():
            out = out.when(begins(prefixes), kind)
        return out.when(F.length(content) == 0, "empty").when(looks_like_text(content), "text").otherwise("unknown")

    return let(F.hex(F.substring(content, 1, 8)), sniffed)


def validate_files(files: DataFrame, max_bytes: int = S.UPLOAD_MAX_BYTES) -> DataFrame:
    """Add ``extension``, ``kind``, ``code`` (null when accepted) and ``ok``.

    ``files``: name, length, mime_type (null allowed), content.
    """
    mime = F.lower(F.coalesce("mime_type", F.lit("")))
    mime_ok = mime.isin(ALLOWED_MIME_TYPES) | (mime == "application/octet-stream") | F.startswith(mime, F.lit("text/"))
    containers = F.create_map(*[F.lit(x) for pair in CONTAINER_OF.items() for x in pair])

    def code(v: Column) -> Column:
        expected = F.try_element_at(containers, v["extension"])
        return (
            F.when(~v["extension"].isin(ALLOWED_EXTENSIONS), "UNSUPPORTED_FILE_TYPE")
            .when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
            .when(~mime_ok, "UNSUPPORTED_MIME_TYPE")
            .when(v["kind"] == "executable", "DANGEROUS_FILE")
            .when(v["kind"] == "empty", "EMPTY_FILE")
            .when(v["kind"] != expected, "CONTENT_MISMATCH")
        )

    found = F.struct(
        file_extension(F.col("name")).alias("extension"), container_kind(F.col("content")).alias("kind")
    )
    verdict = let(found, lambda v: F.struct(v["extension"].alias("extension"), v["kind"].alias("kind"), code(v).alias("code")))
    rows = files.drop("extension", "kind", "code", "ok").withColumn("_v", verdict)
    return rows.select("*", "_v.*").drop("_v").withColumn("ok", F.col("code").isNull())


def extractable(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rejection reason per file after extraction; null when text was found.

    ``files``: document_id, name, length. ``chunks``: document_id per chunk.
    """
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    joined = files.join(counts, "document_id", "left")
    reason = (
        F.when(~file_extension(F.col("name")).isin(ALLOWED_EXTENSIONS), "UNSUPPORTED_FORMAT")
        .when(F.col("length") == 0, "EMPTY_DOCUMENT")
        .when(F.coalesce("n_chunks", F.lit(0)) == 0, "NO_TEXT_EXTRACTED")
    )
    return joined.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0))).withColumn("reason", reason)


def batch_counters(chunks: DataFrame, batch_size: int = S.BATCH_SIZE) -> DataFrame:
    """Per document and batch: chunks in it, chunks so far, batch number from 1.

    Chunk numbers are contiguous from 0, so the running total needs no window: every batch
    before the last one is full.
    """
    batch = F.floor(F.col("chunk_index") / batch_size)
    return chunks.groupBy("document_id", batch.alias("_b")).agg(F.count("*").alias("batch_chunks")).select(
        "document_id", (F.col("_b") + 1).cast("int").alias("batch"), "batch_chunks",
        (F.col("_b") * batch_size + F.col("batch_chunks")).alias("chunks_so_far"),
    )


def batch_totals(chunks: DataFrame, batch_size: int = S.BATCH_SIZE) -> DataFrame:
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.ceil(F.count("*") / batch_size).alias("batches")
    )


def progress_ticks(pages: DataFrame, every: int = S.PAGE_TICK) -> DataFrame:
    """Pages at which extraction reports: every tenth, the last, and each recognised page."""
    last = pages.groupBy("document_id").agg(F.max("page").alias("pages"))
    joined = pages.join(last, "document_id")
    return joined.filter((F.col("page") % every == 0) | (F.col("page") == F.col("pages")) | F.col("recognised"))


# --- progress description ------------------------------------------------------

# Stage labels.
STAGE_LABELS = {
    "pending": "Queued",
    "uploading": "Uploading",
    "extracting": "Extracting text",
    "ocr": "Reading scanned pages",
    "chunking": "Splitting into chunks",
    "embedding": "Generating embeddings",
    "ready": "Ready",
    "failed": "Failed",
}
BACKGROUND_DETAIL = "This keeps running in the background - check your Library shortly."


def _plural(count: Column, word: str) -> Column:
    ending = F.when(count == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s"))
    return F.concat(count.cast("string"), ending)


def _clamped(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(value))).cast("int")


def computed_percent(stage: Column, p: Column) -> Column:
    """Whole percent when a measured ratio exists for the stage, else null."""
    def ratio(done: str, total: str) -> Column:
        return _clamped(p[done] / F.nullif(p[total], F.lit(0)) * 100)

    def known(done: str, total: str) -> Column:
        return p[done].isNotNull() & (F.coalesce(p[total], F.lit(0)) != 0)

    return (
        F.when(stage.isin("ocr", "extracting") & known("page", "pages"), ratio("page", "pages"))
        .when((stage == "embedding") & known("batches", "batchesTotal"), ratio("batches", "batchesTotal"))
        .when((stage == "extracting") & known("block", "blocks"), ratio("block", "blocks"))
    )


def _detail(stage: Column, p: Column) -> Column:
    def pair(word: str, done: str, total: str) -> Column:
        return F.concat(F.lit(f"{word} "), p[done].cast("string"), F.lit(" of "), p[total].cast("string"))

    def positive(name: str) -> Column:
        return F.coalesce(p[name], F.lit(0)) != 0

    page_of = p["page"].isNotNull() & positive("pages")
    suffix = F.when(positive("batchesTotal"), F.concat(F.lit(" of "), p["batchesTotal"].cast("string"))).otherwise(F.lit(""))
    return (
        F.when(stage.isin("ocr", "extracting") & page_of, pair("page", "page", "pages"))
        .when((stage == "ocr") & p["ocrPages"].isNotNull(), F.concat(_plural(p["ocrPages"], "page"), F.lit(" so far")))
        .when((stage == "extracting") & p["block"].isNotNull() & positive("blocks"), pair("section", "block", "blocks"))
        .when((stage == "extracting") & positive("blocks"), _plural(p["blocks"], "section"))
        .when((stage == "embedding") & p["batches"].isNotNull(), F.concat(F.lit("batch "), p["batches"].cast("string"), suffix))
        .when((stage == "embedding") & p["chunks"].isNotNull(), F.concat(_plural(p["chunks"], "chunk"), F.lit(" indexed")))
        .when((stage == "chunking") & p["chunks"].isNotNull(), F.concat(_plural(p["chunks"], "chunk"), F.lit(" so far")))
    )


def describe_progress(documents: DataFrame) -> DataFrame:
    """Add stage, label, detail, percent, tone and done.

    ``documents``: status, progress struct, chunk_count, error_message; optional upload_percent
    and backgrounded.
    """
    have = set(documents.columns)
    status = F.coalesce("status", F.lit("pending"))
    p = F.col("progress")
    backgrounded = F.coalesce("backgrounded", F.lit(False)) if "backgrounded" in have else F.lit(False)
    upload = F.col("upload_percent") if "upload_percent" in have else F.lit(None).cast("double")
    failed, ready = status == "failed", status == "ready"
    sending = (status == "uploading") & upload.isNotNull()
    current = F.when(p["stage"].isNotNull() & ~p["stage"].isin("", "failed"), p["stage"]).otherwise(status)
    stage = F.when(backgrounded | failed | ready | sending, status).otherwise(current)
    documents, stage = documents.withColumn("stage", stage), F.col("stage")
    labels = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])
    label = F.when(backgrounded, F.lit("Still processing")).otherwise(
        F.coalesce(F.try_element_at(labels, stage), F.try_element_at(labels, status), F.lit("Processing"))
    )
    count = F.coalesce(F.col("chunk_count").cast("bigint"), p["chunksTotal"])
    indexed = F.when(count != 0, F.concat(F.lit("Indexed "), _plural(count, "chunk")))
    detail = (
        F.when(backgrounded, F.lit(BACKGROUND_DETAIL)).when(failed, F.col("error_message")).when(ready, indexed)
        .when(sending, F.concat(F.round(upload).cast("int").cast("string"), F.lit("%")))
        .otherwise(_detail(stage, p))
    )
    percent = (
        F.when(backgrounded | failed, F.lit(None).cast("int")).when(ready, F.lit(100))
        .when(sending, _clamped(upload)).otherwise(computed_percent(stage, p))
    )
    tone = F.when(backgrounded, "active").when(failed, "error").when(ready, "done").otherwise("active")
    return documents.withColumns(
        {
            "label": label, "detail": detail, "percent": percent, "tone": tone,
            "done": ~backgrounded & (failed | ready),
        }
    )
