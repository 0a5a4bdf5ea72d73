"""Plain text and Markdown: decoding and located blocks.

A document is one text cell, so line numbers, fences and sections are one fold over
that cell: Arrow batches go through Python once, and nothing is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusflow.functions.text import SPACE_CHARS

# Encodings tried in this order once UTF-8 has failed; the first that decodes wins.
FALLBACK_ENCODINGS = ["utf-16", "cp1252", "latin-1"]


@F.pandas_udf(T.StringType())
def _decode_fallback(content: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        for encoding in FALLBACK_ENCODINGS:
            try:
                # Lone surrogates cannot be stored; such a decoding counts as failed.
                return bytes(raw).decode(encoding).encode("utf-8").decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
        return None

    return content.map(one)


def decode_text(content: Column) -> Column:
    """Bytes to text. Valid UTF-8 (with or without mark) stays in the JVM; the rest is decoded in Arrow batches."""
    as_text = content.cast("string")
    valid = F.is_valid_utf8(as_text)
    plain = F.when(F.startswith(as_text, F.lit("﻿")), F.substr(as_text, F.lit(2))).otherwise(as_text)
    return F.when(valid, plain).otherwise(_decode_fallback(F.when(~valid, content)))


def decode_text_files(files: DataFrame) -> DataFrame:
    return files.withColumn("text", decode_text(F.col("content"))).drop("content")


def location(**known: Column) -> Column:
    """Locator struct with nulls for what a format does not have."""
    kinds = {"page": "int", "slide": "int", "paragraph": "int", "line": "int", "table": "int",
             "section": "string", "title": "string"}
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def _rows_of(documents: DataFrame, fold: Callable[[str], Iterator[tuple]], columns: str) -> DataFrame:
    """Rows ``(document_id, *columns)`` that ``fold`` makes of each text; null texts have none."""
    added = T.StructType.fromDDL(columns)
    schema = T.StructType([documents.schema["document_id"], *added.fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, found = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                rows = [] if text is None else list(fold(text))
                owners.extend([at] * len(rows))
                found.extend(rows)
            values = list(zip(*found, strict=True)) if found else [()] * len(added)
            yield pa.RecordBatch.from_arrays(
                [batch.column("document_id").take(pa.array(owners, pa.int64())),
                 *(pa.array(list(v), kinds.field(f.name).type) for v, f in zip(values, added, strict=True))],
                schema=kinds,
            )

    return documents.select("document_id", "text").mapInArrow(run, schema)


def _txt_blocks(text: str) -> Iterator[tuple]:
    line, number = 1, 0
    for piece in text.split("\n\n"):
        body = piece.strip(SPACE_CHARS)
        if body:
            yield number, body, line
            number += 1
        line += piece.count("\n") + 2


def extract_txt_blocks(documents: DataFrame) -> DataFrame:
    """Blocks at blank lines with the line each starts on. ``documents``: document_id, text."""
    return _rows_of(documents, _txt_blocks, "block_no int, text string, line int").select(
        "document_id", "block_no", "text", location(line=F.col("line")).alias("metadata")
    )


def _markdown_lines(text: str) -> Iterator[tuple]:
    """(pos, line, is_fence, in_fence, is_heading, block, section) of each line."""
    inside, block, section = False, 0, None
    for pos, line in enumerate(text.split("\n")):
        lead = line.lstrip(SPACE_CHARS)
        fence = lead.startswith("```")
        heading = not fence and not inside and lead.startswith("#")
        if heading:
            block += 1
            # The heading test ignores leading blanks, the section text does not; a bare mark keeps the section.
            section = line.lstrip("#").strip(SPACE_CHARS) or section
        yield pos, line, fence, inside, heading, block, section
        inside ^= fence


def _markdown_blocks(text: str) -> Iterator[tuple]:
    for block, lines in groupby(_markdown_lines(text), key=lambda row: row[5]):
        held = list(lines)
        body = "\n".join(row[1] for row in held).strip(SPACE_CHARS)
        if body:
            yield block, body, held[0][0] + 1, held[-1][6]


def _markdown_counts(text: str) -> Iterator[tuple]:
    rows = list(_markdown_lines(text))
    yield sum(row[4] for row in rows), len(rows)


def markdown_lines(documents: DataFrame) -> DataFrame:
    """Lines with fence state, heading flag, block number and section in force."""
    return _rows_of(
        documents, _markdown_lines,
        "pos int, line string, is_fence boolean, in_fence boolean, is_heading boolean, block bigint, section string",
    )


def extract_markdown_blocks(documents: DataFrame) -> DataFrame:
    """Blocks cut at headings outside code fences; each keeps its heading line and section."""
    return _rows_of(documents, _markdown_blocks, "block_no int, text string, line int, section string").select(
        "document_id", "block_no", "text", location(line=F.col("line"), section=F.col("section")).alias("metadata")
    )


def markdown_info(documents: DataFrame) -> DataFrame:
    return _rows_of(documents, _markdown_counts, "headings bigint, lines bigint")
