"""Page text of paged documents, with recognised text for scanned pages.

The page table ``(document_id, page, text, recognised_text)`` comes from any page reader plugged
in as a ``mapInPandas`` stage. ``recognised_text`` is null where no recognition was possible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.text import strip
from corpusflow.sources.text_files import location


def _judged(pages: DataFrame, threshold: int) -> DataFrame:
    text = strip(F.coalesce("text", F.lit("")))
    scanned = F.length(text) < threshold
    replaced = scanned & (F.length(F.coalesce("recognised_text", F.lit(""))) > 0)
    return pages.select(
        "document_id", "page", F.when(replaced, F.col("recognised_text")).otherwise(text).alias("text"),
        scanned.alias("scanned"), replaced.alias("recognised"),
        (scanned & F.col("recognised_text").isNull()).alias("unreadable"),
    )


def page_text_blocks(pages: DataFrame, threshold: int = S.OCR_CHAR_THRESHOLD) -> DataFrame:
    """One block per non-blank page (page numbers from 1)."""
    kept = _judged(pages, threshold).filter(F.length(strip(F.col("text"))) > 0)
    return kept.select(
        "document_id", F.col("page").cast("int").alias("block_no"), "text",
        location(page=F.col("page")).alias("metadata"),
    )


def page_info(pages: DataFrame, threshold: int = S.OCR_CHAR_THRESHOLD) -> DataFrame:
    """Page count and recognition use per document; ``error_code`` when a scanned page stayed unread."""
    return _judged(pages, threshold).groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.bool_or("recognised").alias("used_ocr"),
        F.count_if("recognised").alias("ocr_pages"),
        F.when(F.bool_or("unreadable"), "OCR_UNAVAILABLE").alias("error_code"),
    )


def pages_with_recognition(pages: DataFrame, threshold: int = S.OCR_CHAR_THRESHOLD) -> DataFrame:
    """Pages with the flag the progress ticks need."""
    return _judged(pages, threshold).select("document_id", "page", F.col("scanned").alias("recognised"))
