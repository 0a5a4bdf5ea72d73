"""Word and slide packages: one row per element, assembled by Spark expressions.

The Python stage only opens the package and lists its elements; headings, sections, bullets,
numbering and table layout are columns, windows and aggregates.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import strip
from corpusflow.session import bounded_batches
from corpusflow.sources.text_files import location

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Bytes that the parts of a package may take unpacked, and columns that one merged cell may cover. A package beyond
#: either is reported as unreadable: a small file could otherwise fill a worker.
MAX_UNPACKED = 256 << 20
MAX_SPAN = 1024

#: Elements that a worker holds as Python objects before it hands them on.
FRAME_ROWS = 2000

ELEMENTS = (
    "document_id string, seq int, part int, kind string, style string, level int, text string, cells array<string>"
)


def _open(content: bytes) -> zipfile.ZipFile:
    """The package, if the sizes that it states are in bounds; reading a part never gives more than it states."""
    package = zipfile.ZipFile(io.BytesIO(content))
    if sum(part.file_size for part in package.infolist()) > MAX_UNPACKED:
        raise ValueError("package too large unpacked")
    return package


def _word_text(node) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    pieces = []
    for run in node.iter(f"{W}r"):
        for child in run:
            pieces.append(child.text or "" if child.tag == f"{W}t" else marks.get(child.tag, ""))
    return "".join(pieces)


def _word_cells(row, above: list[str]) -> list[str]:
    cells: list[str] = []
    for cell in row.findall(f"{W}tc"):
        text = "\n".join(_word_text(p) for p in cell.findall(f"{W}p"))
        props = cell.find(f"{W}tcPr")
        span, merge = (None, None) if props is None else (props.find(f"{W}gridSpan"), props.find(f"{W}vMerge"))
        continued = merge is not None and merge.get(f"{W}val", "continue") == "continue"
        width = 1 if span is None else int(span.get(f"{W}val"))
        if width > MAX_SPAN:
            raise ValueError("merged cell too wide")
        # A merged cell repeats in every column and row it covers.
        for _ in range(width):
            cells.append(above[len(cells)] if continued and len(cells) < len(above) else text)
    return cells


def word_elements(content: bytes) -> Iterator[dict]:
    """Paragraphs and table rows of the document body."""
    package = _open(content)
    names = {}
    if "word/styles.xml" in package.namelist():
        for style in ElementTree.fromstring(package.read("word/styles.xml")).findall(f"{W}style"):
            label = style.find(f"{W}name")
            if label is not None:
                names[style.get(f"{W}styleId")] = label.get(f"{W}val")
    tables = 0
    for node in ElementTree.fromstring(package.read("word/document.xml")).find(f"{W}body"):
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            key = None if style is None else style.get(f"{W}val")
            name = names.get(key, key or "Normal")
            # Stored heading names are lower case; they are shown capitalised.
            yield {"kind": "paragraph", "text": _word_text(node), "style": name[:1].upper() + name[1:]}
        elif node.tag == f"{W}tbl":
            tables += 1
            yield {"kind": "table", "part": tables}
            above: list[str] = []
            for row in node.findall(f"{W}tr"):
                above = _word_cells(row, above)
                yield {"kind": "row", "part": tables, "cells": above}


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in package.namelist():
        return {}
    return {
        r.get("Id"): (r.get("Type", ""), posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/"))
        for r in ElementTree.fromstring(package.read(path))
    }


def _slide_lines(body) -> list[tuple[int, str]]:
    lines = []
    for paragraph in body.findall(f"{A}p"):
        props = paragraph.find(f"{A}pPr")
        level = 0 if props is None else int(props.get("lvl", 0))
        lines.append((level, "".join(t.text or "" for t in paragraph.findall(f"{A}r/{A}t"))))
    return lines


def _placeholder(shape):
    return shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")


def slide_elements(content: bytes) -> Iterator[dict]:
    """Titles, text lines, table rows and notes of every slide, in presentation order."""
    package = _open(content)
    root = ElementTree.fromstring(package.read("ppt/presentation.xml"))
    targets = _relations(package, "ppt/presentation.xml")
    for number, entry in enumerate(root.iter(f"{P}sldId"), 1):
        path = targets[entry.get(REL_ID)][1]
        yield {"kind": "slide", "part": number}
        titled = False
        for shape in ElementTree.fromstring(package.read(path)).find(f"{P}cSld/{P}spTree"):
            if shape.tag == f"{P}sp":
                body, mark = shape.find(f"{P}txBody"), _placeholder(shape)
                if body is None:
                    continue
                if not titled and mark is not None and mark.get("type") in ("title", "ctrTitle"):
                    titled = True
                    yield {"kind": "title", "part": number, "text": "\n".join(t for _, t in _slide_lines(body))}
                    continue
                for level, text in _slide_lines(body):
                    yield {"kind": "line", "part": number, "level": level, "text": text}
            elif shape.tag == f"{P}graphicFrame":
                for row in shape.iter(f"{A}tr"):
                    cells = [
                        "\n".join(t for _, t in _slide_lines(cell.find(f"{A}txBody")))
                        for cell in row.findall(f"{A}tc")
                    ]
                    yield {"kind": "row", "part": number, "cells": cells}
        for kind, target in _relations(package, path).values():
            if kind.endswith("/notesSlide"):
                for shape in ElementTree.fromstring(package.read(target)).iter(f"{P}sp"):
                    mark, body = _placeholder(shape), shape.find(f"{P}txBody")
                    if mark is not None and body is not None and mark.get("type") == "body":
                        text = "\n".join(t for _, t in _slide_lines(body))
                        yield {"kind": "notes", "part": number, "text": text}


def _elements(files: DataFrame, reader) -> DataFrame:
    names = [field.split(" ")[0] for field in ELEMENTS.split(", ")]

    def frame(rows):
        made = pd.DataFrame({n: pd.Series([row.get(n) for row in rows], dtype=object) for n in names})
        for name in ("seq", "part", "level"):
            made[name] = made[name].astype("Int32")
        return made

    def read(batches):
        rows = []
        for pdf in batches:
            for key, content in zip(pdf["document_id"], pdf["content"]):
                try:
                    found = list(reader(bytes(content)))
                except Exception:  # noqa: BLE001 - one bad file must not fail the job
                    found = [{"kind": "error", "text": "PARSE_FAILED"}]
                for i, element in enumerate(found):
                    rows.append({"document_id": key, "seq": i, **element})
                    if len(rows) == FRAME_ROWS:
                        yield frame(rows)
                        rows = []
        if rows:
            yield frame(rows)

    bounded_batches(files.sparkSession)
    return files.select(F.col("document_id").cast("string"), "content").mapInPandas(read, ELEMENTS)


def docx_elements(files: DataFrame) -> DataFrame:
    return _elements(files, word_elements)


def pptx_elements(files: DataFrame) -> DataFrame:
    return _elements(files, slide_elements)


def _row_text():
    cells = F.transform("cells", lambda c: strip(F.coalesce(c, F.lit(""))))
    return F.when(F.exists(cells, lambda c: F.length(c) > 0), F.array_join(cells, " | "))


def _joined(value: str):
    pairs = F.array_sort(F.collect_list(F.struct("seq", F.col(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), "\n")


def docx_blocks(elements: DataFrame) -> DataFrame:
    """Paragraph blocks with their running section, then table blocks carrying the last section."""
    kept = elements.filter("kind = 'paragraph'").withColumn("text", strip(F.col("text"))).filter(F.length("text") > 0)
    here = Window.partitionBy("document_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    title = F.col("style") == "Title"
    kept = kept.withColumn("heading", F.startswith("style", F.lit("Heading")) | title)
    prefix = (
        F.when(title, "# ").when(F.col("heading"), "## ")
        .when(F.contains("style", F.lit("List")), "- ").otherwise("")
    )
    numbered = kept.select(
        "document_id", "seq", F.count("*").over(here).alias("number"),
        F.last(F.when(F.col("heading"), F.col("text")), ignorenulls=True).over(here).alias("section"),
        F.concat(prefix, F.col("text")).alias("text"),
    )
    paragraphs = numbered.select(
        "document_id", F.col("number").cast("int").alias("block_no"), "text",
        location(paragraph=F.col("number"), section=F.col("section")).alias("metadata"),
    )
    last = kept.groupBy("document_id").agg(
        F.max_by("text", F.when(F.col("heading"), F.col("seq"))).alias("section")
    )
    rows = elements.filter("kind = 'row'").withColumn("line", _row_text()).filter("line is not null")
    tables = rows.groupBy("document_id", "part").agg(_joined("line").alias("text")).join(last, "document_id", "left")
    # Tables follow every paragraph; paragraph numbers stay below this offset.
    return paragraphs.unionByName(
        tables.select(
            "document_id", (F.col("part") + 1_000_000_000).alias("block_no"), "text",
            location(table=F.col("part"), section=F.col("section")).alias("metadata"),
        )
    )


def docx_info(elements: DataFrame) -> DataFrame:
    filled = (F.col("kind") == "paragraph") & (F.length(strip(F.coalesce("text", F.lit("")))) > 0)
    return elements.groupBy("document_id").agg(
        F.count_if(filled).alias("paragraphs"), F.count_if(F.col("kind") == "table").alias("tables"),
        F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error_code"),
    )


def pptx_blocks(elements: DataFrame) -> DataFrame:
    """One block per slide that has text: title, bullets and table rows, speaker notes."""
    text = strip(F.coalesce("text", F.lit("")))
    bullet = F.when(
        (F.col("kind") == "line") & (F.length(text) > 0),
        F.concat(F.repeat(F.lit("  "), F.coalesce("level", F.lit(0))), F.lit("- "), text),
    )
    shaped = elements.filter("part is not null").withColumn(
        "piece", F.when(F.col("kind") == "row", _row_text()).otherwise(bullet)
    )
    slides = shaped.groupBy("document_id", "part").agg(
        strip(_joined("piece")).alias("body"),
        F.max(F.when(F.col("kind") == "title", text)).alias("title"),
        F.max(F.when(F.col("kind") == "notes", text)).alias("notes"),
    )
    title, body, notes = (F.nullif(n, F.lit("")) for n in ("title", "body", "notes"))
    full = F.concat_ws("\n", F.concat(F.lit("# "), title), body, F.concat(F.lit("Speaker notes: "), notes))
    return slides.filter(F.coalesce(title, body, notes).isNotNull()).select(
        "document_id", F.col("part").alias("block_no"), full.alias("text"),
        location(slide=F.col("part"), title=title).alias("metadata"),
    )


def pptx_info(elements: DataFrame) -> DataFrame:
    return elements.groupBy("document_id").agg(
        F.count_if(F.col("kind") == "slide").alias("slide_count"),
        F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error_code"),
    )
