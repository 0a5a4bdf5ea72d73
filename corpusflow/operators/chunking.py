"""Splitting blocks into overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.text import strip
from corpusflow.operators.ordered import slab_running_sum
from corpusflow.session import staged

# Separators in order of preference; single characters come after them.
SEPARATORS = ["\n\n", "\n", " "]
BLOCK_SLAB = 4096


def _cuts(text: str, lo: int, hi: int, separator: str) -> list[int]:
    """Piece boundaries: each piece begins with the separator that precedes it."""
    bounds, at = [lo], text.find(separator, lo, hi)
    while at != -1:
        if at > bounds[-1]:
            bounds.append(at)
        at = text.find(separator, at + len(separator), hi)
    return [*bounds, hi]


def _windows(bounds: list[int], size: int, overlap: int):
    """Spans over neighbouring pieces: as long as fits, stepping back at most ``overlap``."""
    first = 0
    for i in range(len(bounds) - 1):
        start, end = bounds[i], bounds[i + 1]
        if end - bounds[first] > size and i > first:
            yield bounds[first], start
            while first < i and (start - bounds[first] > overlap or end - bounds[first] > size):
                first += 1
    yield bounds[first], bounds[-1]


def _spans(text: str, lo: int, hi: int, level: int, size: int, overlap: int):
    while level < len(SEPARATORS) and text.find(SEPARATORS[level], lo, hi) == -1:
        level += 1
    if level == len(SEPARATORS):
        while hi - lo > size:
            yield lo, lo + size
            lo += size - overlap
        yield lo, hi
        return
    bounds = _cuts(text, lo, hi, SEPARATORS[level])
    run = [bounds[0]]
    for start, end in zip(bounds, bounds[1:]):
        if end - start < size:
            run.append(end)
            continue
        if len(run) > 1:
            yield from _windows(run, size, overlap)
        yield from _spans(text, start, end, level + 1, size, overlap)
        run = [end]
    if len(run) > 1:
        yield from _windows(run, size, overlap)


def split_text(text: str, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most ``size`` characters at the coarsest separator that allows it."""
    if not text:
        return []
    pieces = (text[a:b].strip() for a, b in _spans(text, 0, len(text), 0, size, overlap))
    return [piece for piece in pieces if piece]


def split_column(text: Column, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> Column:
    """Array of pieces. Texts that fit in one piece never enter Python."""

    @F.pandas_udf("array<string>")
    def pieces(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: split_text(t, size, overlap), na_action="ignore")

    short = F.length(text) < size
    whole = F.filter(F.array(strip(text)), lambda t: F.length(t) > 0)
    return F.when(short, whole).otherwise(pieces(F.when(~short, text)))


def chunk_blocks(blocks: DataFrame, size: int = S.CHUNK_SIZE, overlap: int = S.CHUNK_OVERLAP) -> DataFrame:
    """Chunks per block with contiguous numbers per document; overlap never crosses a block.

    Chunk numbers need only the piece counts of earlier blocks, which are accumulated by slabs of
    the block number, so a document with very many blocks is not gathered in one task.
    """
    # Totals and rows both read the pieces: they are split once and written.
    pieces = staged(blocks.withColumn("_pieces", split_column(F.col("text"), size, overlap)).drop("text"), "pieces")
    counted = slab_running_sum(
        pieces, ["document_id"], F.floor(F.col("block_no") / BLOCK_SLAB), [F.col("block_no")],
        F.size("_pieces"), "_before", inclusive=False,
    )
    rest = [c for c in blocks.columns if c not in ("text", "document_id", "block_no")]
    return counted.select(
        "document_id", "block_no", *rest, "_before", F.posexplode("_pieces").alias("_piece", "content")
    ).withColumn("chunk_index", (F.col("_before") + F.col("_piece")).cast("int")).drop("_before", "_piece")


def sparse_metadata(metadata: Column, document_name: Column, fallback_name: Column) -> Column:
    """JSON with only the keys that exist: numbers when not null, texts when not empty."""
    return F.to_json(
        F.struct(
            F.coalesce(document_name, fallback_name).alias("documentName"),
            *[metadata[n].alias(n) for n in ("page", "slide", "paragraph", "line")],
            *[F.nullif(metadata[n], F.lit("")).alias(n) for n in ("section", "title")],
            metadata["table"].alias("table"),
        )
    )
