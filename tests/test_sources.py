import io
import random
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow import views
from corpusflow.operators import library
from corpusflow.sources import event_logs, files, office, pages, text_files, web
from tests.conftest import rows

TXT = (
    "Quarterly Report\n\nRevenue grew by 14 percent\nthis quarter.\n\n\n\nOperating costs stayed flat.\n\n  \n\n"
    "The board approved a dividend.\n"
)
MD = (
    "# Vector Databases\n\nA vector database.\n\n## Indexing strategies\n\n- HNSW\n\n## Example query\n\n```sql\n# not a heading\n"
    "SELECT 1;\n```\n\nText\n  ## Indented\n#\ntail\n"
)


def text_df(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, text string")


def naive_txt(text):
    out, line = [], 1
    for part in text.split("\n\n"):
        if part.strip():
            out.append((part.strip(), line))
        line += part.count("\n") + 2
    return out


def test_txt_blocks(spark):
    got = text_files.extract_txt_blocks(text_df(spark, TXT)).orderBy("block_no")
    assert rows(got, "text", "metadata.line") == naive_txt(TXT)
    assert [r[0] for r in rows(got, "block_no")] == [0, 1, 2, 3]
    generator = random.Random(5)
    texts = ["".join(generator.choice(["a", "\n", " ", "\n\n", "bc"]) for _ in range(60)) for _ in range(30)]
    blocks = text_files.extract_txt_blocks(text_df(spark, *texts))
    got = {}
    for key, number, text, line in rows(blocks, "document_id", "block_no", "text", "metadata.line"):
        got.setdefault(int(key), []).append((number, text, line))
    for i, text in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(i, []))] == naive_txt(text)


def test_markdown_blocks(spark):
    got = rows(text_files.extract_markdown_blocks(text_df(spark, MD)).orderBy("block_no"), "text", "metadata.line", "metadata.section")
    assert got == [
        ("# Vector Databases\n\nA vector database.", 1, "Vector Databases"),
        ("## Indexing strategies\n\n- HNSW", 5, "Indexing strategies"),
        ("## Example query\n\n```sql\n# not a heading\nSELECT 1;\n```\n\nText", 9, "Example query"),
        # The heading test ignores leading blanks, the section text keeps its marks.
        ("## Indented", 17, "## Indented"),
        ("#\ntail", 18, "## Indented"),
    ]
    assert rows(text_files.markdown_info(text_df(spark, MD)), "headings", "lines") == [(5, MD.count("\n") + 1)]
    plain = rows(text_files.extract_markdown_blocks(text_df(spark, "\nno heading\n")), "text", "metadata.line", "metadata.section")
    assert plain == [("no heading", 1, None)]


@pytest.mark.parametrize("raw", [
    b"\xef\xbb\xbfmarked", "café".encode(), "wide é".encode("utf-16"), b"odd \xe9", b"even\xe9 ", b"a\x81\x8d", b"", b"\xff\xfe",
    b"\x00\xd8a",
])
def test_decoding_order(spark, raw):
    want = None
    for encoding in ("utf-8-sig", "utf-8", "utf-16", "cp1252", "latin-1"):
        try:
            want = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    df = spark.createDataFrame([(bytearray(raw),)], "content binary")
    assert df.select(text_files.decode_text(F.col("content"))).first()[0] == want


def test_page_blocks(spark):
    data = [("d", 1, "x" * 39, "SCAN"), ("d", 2, "x" * 40, "SCAN"), ("d", 3, "short", ""), ("d", 4, " ", ""), ("d", 5, "", " R "), ("e", 1, "short", None)]
    df = spark.createDataFrame(data, "document_id string, page int, text string, recognised_text string")
    got = rows(pages.page_text_blocks(df).filter("document_id = 'd'").orderBy("block_no"), "text", "metadata.page")
    assert got == [("SCAN", 1), ("x" * 40, 2), ("short", 3), (" R ", 5)]
    info = {r[0]: r[1:] for r in rows(pages.page_info(df))}
    assert info == {"d": (5, True, 2, None), "e": (1, False, 0, "OCR_UNAVAILABLE")}
    many = spark.createDataFrame([("d", p, p == 13) for p in range(1, 26)], "document_id string, page int, recognised boolean")
    assert sorted(r[0] for r in rows(library.progress_ticks(many), "page")) == [10, 13, 20, 25]


def test_docx(spark):
    package = views.word_package(["Overview", "Supervised learning", "", "plain", "bullet & one", "Common algorithms", "text"])
    df = spark.createDataFrame([("d", bytearray(package)), ("bad", bytearray(b"PK\x03\x04junk"))], "document_id string, content binary")
    elements = office.docx_elements(df)
    got = rows(office.docx_blocks(elements).orderBy("block_no"), "text", "metadata.paragraph", "metadata.table", "metadata.section")
    assert got == [
        ("# Overview", 1, None, "Overview"), ("Supervised learning", 2, None, "Overview"), ("plain", 3, None, "Overview"),
        ("- bullet & one", 4, None, "Overview"), ("## Common algorithms", 5, None, "Common algorithms"),
        ("text", 6, None, "Common algorithms"), ("Overview | Supervised learning", None, 1, "Common algorithms"),
    ]
    assert {r[0]: r[1:] for r in rows(office.docx_info(elements))} == {"d": (6, 1, None), "bad": (0, 0, "PARSE_FAILED")}


def test_packages_out_of_bounds_are_unreadable(spark, monkeypatch):
    package = views.word_package(["Overview", "text", "a", "b", "c", "d", "e"])
    slides = views.slide_package([{"title": "Only title"}])
    wide = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(wide, "w") as new:
        for name in old.namelist():
            span = b'<w:tc><w:tcPr><w:gridSpan w:val="2000000000"/></w:tcPr>'
            new.writestr(name, old.read(name).replace(b"<w:tc>", span, 1))
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as new:
        new.writestr("word/document.xml", b" " * (2 << 20))
    assert list(office.word_elements(package)) and list(office.slide_elements(slides))
    with pytest.raises(ValueError):
        list(office.word_elements(wide.getvalue()))
    monkeypatch.setattr(office, "MAX_UNPACKED", 1 << 20)
    for read in (office.word_elements, office.slide_elements):
        with pytest.raises(ValueError):
            list(read(bomb.getvalue()))
    df = spark.createDataFrame([("wide", bytearray(wide.getvalue()))], "document_id string, content binary")
    assert rows(office.docx_elements(df), "kind", "text") == [("error", "PARSE_FAILED")]


def test_pptx(spark):
    package = views.slide_package([
        {"title": "RAG", "lines": [(0, "Retrieve"), (1, "Ground"), (0, " ")], "notes": "Mention accuracy."},
        {"title": ""}, {"title": "Only title"}, {"rows": [["a", ""], ["", " "]]},
    ])
    df = spark.createDataFrame([("d", bytearray(package))], "document_id string, content binary")
    elements = office.pptx_elements(df)
    got = rows(office.pptx_blocks(elements).orderBy("block_no"), "text", "metadata.slide", "metadata.title")
    assert got == [
        ("# RAG\n- Retrieve\n  - Ground\nSpeaker notes: Mention accuracy.", 1, "RAG"), ("# Only title", 3, "Only title"), ("a |", 4, None),
    ]
    assert rows(office.pptx_info(elements), "slide_count") == [(4,)]


def test_file_validation(spark):
    cut = "x" * 4095 + "é"
    data = [
        ("a.sh", "text/plain", b"echo"), ("a.txt", "image/png", b"hi"), ("fake.pdf", "application/pdf", b"#!/bin/sh"),
        ("a.txt", "text/x", b""), ("a.pdf", "application/pdf", b"hello"), ("a.docx", "application/octet-stream", b"PK\x03\x04zz"),
        ("a.md", "text/markdown", b"# hi"), ("a.txt", "text/plain", b"a\x00b"), ("a.txt", "text/plain", cut.encode()),
        ("a.txt", "text/plain", b"\x01" * 5 + b"x" * 95), ("a.txt", "text/plain", b"\x01" * 4 + b"x" * 96),
        ("a.doc", "application/msword", bytes.fromhex("D0CF11E0A1B11AE1")), ("noext", "text/plain", b"hi"), ("a.exe.txt", "", b"hi"),
    ]
    df = spark.createDataFrame(
        [(i, n, m, len(c), bytearray(c)) for i, (n, m, c) in enumerate(data)], "i int, name string, mime_type string, length long, content binary"
    )
    got = [r[0] for r in rows(library.validate_files(df).orderBy("i"), "code")]
    assert got == [
        "UNSUPPORTED_FILE_TYPE", "UNSUPPORTED_MIME_TYPE", "DANGEROUS_FILE", "EMPTY_FILE", "CONTENT_MISMATCH", None, None,
        "CONTENT_MISMATCH", "CONTENT_MISMATCH", "CONTENT_MISMATCH", None, None, "UNSUPPORTED_FILE_TYPE", "UNSUPPORTED_MIME_TYPE",
    ]
    assert rows(library.validate_files(df, max_bytes=3).filter("i = 6"), "code") == [("FILE_TOO_LARGE",)]


def test_html(spark):
    page = (
        "<html><!-- c > x --><head><style>p{}</style><script>var t='</p>';</script></head><body><p>Fish &amp; chips</p>"
        "<p>a&nbsp;b &copy 5 &lt; 6 &amp;copy;</p><noscript>no</noscript>\n x </body></html>"
    )
    df = spark.createDataFrame([(page,), ("plain  text",), ("y" * 8001,), (None,)], "h string")
    got = [r[0] for r in rows(df.select(web.strip_html(F.col("h"))))]
    assert got == ["Fish & chips a b © 5 < 6 &copy; x", "plain text", "y" * 8000 + web.TRUNCATED, None]


def test_web_results(spark):
    data = [("q", r, "" if r == 1 else f"T{r}", f"u{r}", "c" * 700, 0.98765 if r % 2 else None) for r in range(1, 8)]
    df = spark.createDataFrame(data, "query_id string, rank int, title string, url string, content string, score double")
    read = spark.createDataFrame([("u1", "text"), ("u2", "text")], "url string, text string")
    got = rows(web.normalise_web_results(df, scraped=read).orderBy("index"), "index", "title", "score", "scraped")
    assert got == [(1, "u1", 0.9877, True), (2, "T2", None, False), (3, "T3", 0.9877, False), (4, "T4", None, False), (5, "T5", 0.9877, False)]
    texts = web.normalise_web_results(df.withColumn("score", F.col("score").cast("string")))
    assert {r[0] for r in rows(texts, "score")} == {None}


def test_event_log_and_sse(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.ndjson").write_text('{"type":"status","page":3}\n\n{"type":"chunks","page":"x"}\nnot json\n{"type":"res')
    got = rows(event_logs.parse_event_log(event_logs.read_lines(spark, str(log)), "type string, page long"))
    assert sorted(got, key=str) == sorted([("status", 3), ("chunks", None)], key=str)
    sse = tmp_path / "sse"
    sse.mkdir()
    (sse / "b.txt").write_text(': ping\n\nevent: token\ndata: {"text":"a"}\n\ndata: {"x":\ndata: 1}\n\nevent: bad\ndata: {oops\n\nevent: e\n\n')
    got = rows(event_logs.read_sse(spark, str(sse)), "event", "data")
    assert sorted(got) == [("message", '{"x":\n1}'), ("token", '{"text":"a"}')]


def test_raw_files_and_catalogue(spark, tmp_path):
    for folder, name, body in (("a", "x.pdf", b"one"), ("a", "y.pdf", b"two"), ("b", "z.pdf", b"one")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(body)
    both = files.scan_raw_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), glob="*.pdf")
    listing = files.list_files(both)
    again = files.union_directories(listing, listing)
    assert again.count() == 3
    chunks = listing.filter("name = 'y.pdf'").select("content_hash").union(listing.filter("name = 'y.pdf'").select("content_hash"))
    got = sorted(rows(library.catalog_files(again, chunks), "name", "indexed", "chunks"))
    assert got == [("x.pdf", False, 0), ("y.pdf", True, 2)]


def test_packages_leave_in_frames_of_bounded_size(spark):
    """A batch of packages is handed on piece by piece, an element's number still counting within its package."""
    built = views.slide_package([{"title": f"T{i}", "lines": [(0, "a"), (1, "b")]} for i in range(100)])
    held = []

    class Files:
        sparkSession = spark  # noqa: N815

        def select(self, *columns):
            return self

        def mapInPandas(self, read, schema):  # noqa: N802
            batch = pd.DataFrame({"document_id": [str(i) for i in range(30)], "content": [built] * 29 + [b"junk"]})
            held.extend(read([batch]))

    office.pptx_elements(Files())
    assert len(held) > 1 and max(map(len, held)) <= office.FRAME_ROWS
    every = pd.concat(held)
    assert len(every) == 29 * 400 + 1 and (every["kind"] == "error").sum() == 1
    assert every.groupby("document_id")["seq"].agg(lambda s: list(s) == list(range(len(s)))).all()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
