"""Batch ingestion: files to searchable chunks.

validate -> compare with the library -> extract by format -> split -> embed -> guard. Each file
carries its own outcome as columns; a bad file never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusflow.functions.text import content_hash, display_name, storage_key
from corpusflow.operators import chunking, constraints, embedding, library, mutations
from corpusflow.session import staged
from corpusflow.sources import office, pages, text_files


# Columns of an extraction report, in the order they are written. Absent measures stay absent.
INFO_COLUMNS = {
    "pageCount": "bigint", "usedOcr": "boolean", "ocrPages": "bigint", "paragraphs": "bigint", "tables": "bigint",
    "slideCount": "bigint", "headings": "bigint", "lines": "bigint",
}


def _info(rows: DataFrame, **measured: str) -> DataFrame:
    """Report rows ``(document_id, measures..., error_code)`` from a format's own counts."""
    error = F.col("error_code") if "error_code" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "document_id", *[F.col(source).alias(name) for name, source in measured.items()], error.alias("error_code")
    )


def _text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    # Report and blocks read the decoded texts; bytes are read and decoded once.
    texts = staged(text_files.decode_text_files(files.select("document_id", "content")), "texts")
    lines = texts.select("document_id", text_files.line_count(F.col("text")).cast("bigint").alias("lines"))
    return text_files.extract_txt_blocks(texts), _info(lines, lines="lines")


def _markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = staged(text_files.decode_text_files(files.select("document_id", "content")), "markdown-texts")
    return text_files.extract_markdown_blocks(texts), _info(
        text_files.markdown_info(texts), headings="headings", lines="lines"
    )


def _word(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    elements = staged(office.docx_elements(files), "word-elements")
    return office.docx_blocks(elements), _info(office.docx_info(elements), paragraphs="paragraphs", tables="tables")


def _slides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    elements = staged(office.pptx_elements(files), "slide-elements")
    return office.pptx_blocks(elements), _info(office.pptx_info(elements), slideCount="slide_count")


# Extractors by extension: (document_id, content) rows to block rows and report rows.
EXTRACTORS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {
    ".txt": _text,
    ".md": _markdown,
    ".docx": _word,
    ".pptx": _slides,
}


def paged_extractor(read_pages: Callable[[DataFrame], DataFrame]) -> Callable:
    """Extractor from a page reader giving (document_id, page, text, recognised_text)."""

    def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = staged(read_pages(files), "pages")
        report = _info(pages.page_info(rows), pageCount="page_count", usedOcr="used_ocr", ocrPages="ocr_pages")
        return pages.page_text_blocks(rows), report

    return extract


def extract_blocks(files: DataFrame, extractors: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks and reports of all files: one branch per format, each over its own files only."""
    blocks, reports = None, None
    for extension, extract in (extractors or EXTRACTORS).items():
        part, report = extract(files.filter(F.col("extension") == extension))
        blocks = part if blocks is None else blocks.unionByName(part)
        reports = report if reports is None else reports.unionByName(report, allowMissingColumns=True)
    return blocks, reports


def extraction_info(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """One JSON report per document with what its format measured, plus chunk count and model."""
    counts = chunks.groupBy("document_id").agg(
        F.count("*").cast("int").alias("chunk_count"), F.max("embedding_model").alias("embedding_model")
    )
    measured = [
        (F.col(name) if name in reports.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in INFO_COLUMNS.items()
    ]
    joined = reports.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
    info = F.struct(*measured, F.col("chunk_count").alias("chunks"), F.col("embedding_model").alias("embeddingModel"))
    return joined.select(
        "document_id", "error_code", "chunk_count", "embedding_model", F.to_json(info).alias("extraction_info")
    )


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows with a row counter that is filled by whatever action runs over them."""
    counter = Observation(name)
    return rows.observe(counter, F.count(F.lit(1)).alias("rows")), counter


def report_progress(counter: Observation, callback: Callable[[dict], None]) -> None:
    """Hand the counted rows to a listener; a failing listener never breaks the job."""
    try:
        callback(counter.get)
    except Exception:  # noqa: BLE001
        pass


def keyed_files(files: DataFrame) -> DataFrame:
    """Files with ``file_key``: the path where there is one, else owner, name and content.

    Without a path two equal rows cannot be told apart, so they are one file.
    """
    if "file_key" in files.columns:
        return files
    if "path" in files.columns:
        return files.withColumn("file_key", F.col("path"))
    return files.withColumn("file_key", F.sha2(F.concat_ws("|", "user_id", "name", content_hash(F.col("content"))), 256))


def judge_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Verdict, hash, library action and document id per file, without the bytes.

    ``files``: user_id, name, mime_type, length, content and optionally file_key or path. Copies of
    one content uploaded together by a user are taken once: the copy with the smallest (name, key).
    The bytes are read once, for the checks and the hash.
    """
    checked = library.validate_files(keyed_files(files)).withColumn("content_hash", content_hash(F.col("content")))
    narrow = staged(checked.drop("content"), "judged-files").dropDuplicates(["user_id", "file_key"])
    firsts = narrow.filter("ok").groupBy("user_id", "content_hash").agg(F.min(F.struct("name", "file_key")).alias("_first"))
    known = library.dedupe_against_library(
        firsts, documents.select("user_id", "content_hash", "status", "document_id")
    ).select("user_id", "content_hash", "_first", "action", "existing_id")
    judged = narrow.join(known, ["user_id", "content_hash"], "left")
    action = (
        F.when(~F.col("ok"), "reject").when(F.col("file_key") != F.col("_first.file_key"), "reuse").otherwise(F.col("action"))
    )
    return judged.withColumn("action", action).withColumn(
        "document_id", F.sha2(F.concat_ws("|", "user_id", "content_hash"), 256)
    ).drop("_first")


def ingest_documents(
    files: DataFrame,
    documents: DataFrame,
    embed: Callable[[DataFrame], DataFrame] = embedding.hashing_embeddings,
    extractors: dict[str, Callable] | None = None,
) -> dict[str, DataFrame]:
    """``verdicts`` (per file), ``chunks`` (searchable rows), ``documents`` (new states) and ``replaced``.

    ``embed`` adds embedding and embedding_model to rows with a content column. ``replaced``
    (document_id, user_id) are the failed documents whose place a new upload takes: they and
    their chunks go. A document whose vectors break the guard (missing, of several dimensions or
    models) fails as a whole. What several outputs read is written once to the shared folder.
    """
    branches = extractors or EXTRACTORS
    verdicts = staged(judge_files(files, documents), "verdicts")
    wanted = verdicts.filter("action in ('new', 'replace')").select(
        "document_id", "user_id", "file_key", "name", "extension", "content_hash", "length", "mime_type"
    )
    readable = wanted.filter(F.col("extension").isin(list(branches))).select("document_id", "user_id", "file_key", "extension")
    taken = keyed_files(files).select("user_id", "file_key", "content").join(readable, ["user_id", "file_key"])
    if "path" not in files.columns and "file_key" not in files.columns:
        taken = taken.dropDuplicates(["document_id"])
    # Each format reads only its own folder of the written bytes.
    blocks, reports = extract_blocks(staged(taken.drop("user_id", "file_key"), "bytes", "extension"), branches)
    reports = staged(reports, "reports")
    # A document that failed part-way contributes no chunks.
    broken = reports.filter("error_code is not null").select("document_id")
    pieces = embedding.drop_blank_texts(chunking.chunk_blocks(blocks.join(broken, "document_id", "left_anti")))
    owned = pieces.join(wanted.select("document_id", "user_id", "name"), "document_id")
    rows = owned.select(
        F.sha2(F.concat_ws("|", "document_id", F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        "document_id", "user_id", "chunk_index", "content",
        chunking.sparse_metadata(F.col("metadata"), F.lit(None).cast("string"), F.col("name")).alias("metadata"),
    )
    embedded = staged(embed(rows), "embedded-chunks")
    guard = staged(constraints.embedding_guard(embedded, None).filter("violations != ''").select("document_id", "violations"), "guard")
    chunks = mutations.append_chunks(embedded.join(guard.select("document_id"), "document_id", "left_anti"), wanted)
    info = extraction_info(reports, chunks).join(guard, "document_id", "left")
    count = F.coalesce("chunk_count", F.lit(0))
    known_format = F.col("extension").isin(list(branches))
    states = wanted.join(info, "document_id", "left").select(
        "document_id", "user_id", display_name(F.col("name")).alias("name"), F.col("name").alias("original_filename"),
        "mime_type", F.col("length").alias("file_size"),
        storage_key(F.col("user_id"), F.col("name"), F.col("content_hash")).alias("storage_key"), "content_hash",
        F.when(count > 0, "ready").otherwise("failed").alias("status"),
        F.when(~known_format, "UNSUPPORTED_FORMAT").when(F.col("error_code").isNotNull(), F.col("error_code"))
        .when(F.col("violations").isNotNull(), F.col("violations"))
        .when(count == 0, "NO_TEXT_EXTRACTED").alias("error_code"),
        count.alias("chunk_count"), "embedding_model", F.when(count > 0, F.col("extraction_info")).alias("extraction_info"),
    )
    replaced = verdicts.filter("action = 'replace'").select(F.col("existing_id").alias("document_id"), "user_id")
    return {"verdicts": verdicts, "chunks": chunks, "documents": states, "replaced": replaced}
