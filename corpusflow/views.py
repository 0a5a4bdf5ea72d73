"""The model tables, derived from the stored test tables.

Each function returns one table of the data model. Time columns are built from
row numbers, so the same definition can be written in any SQL engine.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.ordered import slab_running_sum
from corpusflow.session import bounded_batches

BASE = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to the session's number of shuffle partitions, which is set by the size of the data.

    For work that costs far more than moving its input, such as parsing every text.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts, ready for work that costs far more than reading them."""
    return spread(table(spark, folder, "documents"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "pages"))


def _minutes(expression: str):
    # Seconds as a decimal: minutes as an int would overflow on large ids.
    return F.expr(f"{BASE} + make_dt_interval(0, 0, 0, cast({expression} as decimal(18, 0)) * 60)")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Library documents; unlabelled ones are ready, bad ones failed, toxic ones still in flight."""
    labels = table(spark, folder, "labels")
    return (
        table(spark, folder, "documents").join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"),
            F.expr("concat('doc_', doc_id)").alias("name"),
            F.expr("concat('doc_', doc_id, '.txt')").alias("original_filename"),
            F.lit("text/plain").alias("mime_type"), F.col("n_chars").alias("file_size"),
            F.expr("concat('users/', source, '/', doc_id, '.txt')").alias("storage_key"),
            F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
            F.expr(
                "case when quality = 0 then 'failed' when toxic = 1 then 'extracting' else 'ready' end"
            ).alias("status"),
            F.expr("case when quality = 0 then 'No readable text' end").alias("error_message"),
            F.expr("case when quality = 0 then 'NO_TEXT_EXTRACTED' end").alias("error_code"),
            F.lit(0).alias("chunk_count"), "text",
            _minutes("doc_id").alias("created_at"), _minutes("doc_id").alias("updated_at"),
        )
    )


#: Chunks of a document, while the stored vectors last.
CHUNKS_EACH = 3


def rows_in(spark: SparkSession, folder: str, name: str) -> Column:
    """Number of rows of a stored table, as a scalar subquery."""
    return table(spark, folder, name).agg(F.count(F.lit(1))).scalar()


def document_of(spark: SparkSession, folder: str, vector: Column) -> tuple[Column, Column]:
    """(document, number in it) of a stored vector: the vectors are dealt over documents of the whole id range."""
    documents = rows_in(spark, folder, "documents")
    held = F.greatest(F.least(documents, F.ceil(rows_in(spark, folder, "embeddings") / CHUNKS_EACH)), F.lit(1).cast("bigint"))
    step = F.greatest(F.floor(documents / held), F.lit(1).cast("bigint"))
    place = vector % held
    return place * step + place % step, F.floor(vector / held)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a chunk of a document."""
    owners = documents(spark, folder).select("document_id", "user_id", F.col("text").alias("content"))
    document, number = document_of(spark, folder, F.col("vec_id"))
    placed = table(spark, folder, "embeddings").withColumns({"_document": document, "_number": number.cast("int")})
    position = "_number"
    metadata = F.expr(
        "named_struct("
        "'documentName', concat('doc_', _document, '.txt'),"
        f"'page', case when vec_id % 3 = 0 then {position} + 1 end,"
        f"'slide', case when vec_id % 3 = 1 then {position} + 1 end,"
        f"'paragraph', case when vec_id % 2 = 0 then {position} + 1 end,"
        f"'line', case when vec_id % 3 = 2 then {position} + 1 end,"
        "'table', cast(null as int),"
        "'section', case when vec_id % 5 = 0 then '' when vec_id % 5 = 1 then concat('Section ', label) end,"
        "'title', case when vec_id % 3 = 1 then concat('Slide ', label) end)"
    )
    return (
        placed.select(
            F.col("vec_id").alias("chunk_id"), F.col("_document").alias("document_id"),
            F.col("_number").alias("chunk_index"), metadata.alias("metadata"), "embedding",
            F.expr("concat('m', label % 2)").alias("embedding_model"),
        )
        .join(owners, "document_id")
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector asked as a question by the owner of its document."""
    owners = documents(spark, folder).select("document_id", "user_id")
    scoped = [document_of(spark, folder, F.col("vec_id") + i)[0] for i in (0, 20, 40)]
    return (
        table(spark, folder, "embeddings")
        .select(
            F.col("vec_id").alias("query_id"), scoped[0].alias("document_id"),
            "embedding", F.expr("concat('m', label % 2)").alias("embedding_model"),
            F.expr("vec_id % 2 = 0").alias("allow_weak"),
            F.when(F.col("vec_id") % 3 == 0, F.array(*scoped)).alias("scope"),
        )
        .join(owners, "document_id").drop("document_id")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """One user per document source; sources ending in 7 have no sign-in method."""
    return (
        table(spark, folder, "documents").groupBy(F.col("source").alias("user_id"))
        .agg(F.min("doc_id").alias("first_doc"))
        .select(
            "user_id", F.col("user_id").alias("name"),
            F.expr("concat(upper(user_id), '@Example.com')").alias("email"),
            F.expr("case when user_id not like '%7' and first_doc % 2 = 0 then 'hash' end").alias("password_hash"),
            F.expr("case when user_id not like '%7' and first_doc % 2 = 1 then user_id end").alias("google_id"),
            _minutes("first_doc").alias("created_at"),
        )
    )


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.expr("concat('s', event_id)").alias("session_id"),
        F.expr("concat('src', user_id % 20)").alias("user_id"),
        F.col("ts").alias("created_at"),
        F.expr("ts + make_dt_interval(14, 0, 0, 0)").alias("expires_at"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    """All stored turns, including roles the message table does not allow."""
    stored = table(spark, folder, "conversations")
    return turn_rows(stored, stored.agg(F.max("turn") + 2).scalar())


def turn_rows(stored: DataFrame, ids: Column) -> DataFrame:
    """Turns as messages; a conversation has `ids` message ids, more than it has turns, so no two share one."""
    return stored.select(
        (F.col("conv_id") * ids + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"),
        F.col("turn").alias("position"),
        _minutes("conv_id * 100 + turn").alias("created_at"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return turns(spark, folder).filter(F.col("role").isin("user", "assistant"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per conversation; the title is its earliest user text."""
    per = turns(spark, folder).groupBy("conversation_id").agg(
        F.expr("min_by(content, position) filter (where role = 'user')").alias("title"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
    )
    return per.select(
        "conversation_id", F.expr("concat('src', conversation_id % 20)").alias("user_id"),
        F.expr("coalesce(title, 'New chat')").alias("title"),
        F.expr("element_at(array('auto', 'document', 'web', 'hybrid'), cast(conversation_id % 4 as int) + 1)").alias("mode"),
        F.when(F.col("conversation_id") % 3 == 0, F.col("conversation_id") % rows_in(spark, folder, "documents")).alias("document_id"),
        F.expr("conversation_id % 7 = 0").alias("pinned"),
        F.expr("case when conversation_id % 14 = 0 then updated_at end").alias("pinned_at"),
        "created_at", "updated_at",
    )


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Three citations per assistant message; the last of every second message is a web page."""
    answers = messages(spark, folder).filter("role = 'assistant'")
    placed = answers.select("message_id", F.explode(F.expr("array(0, 1, 2)")).alias("position"))
    web = (F.col("position") == 2) & (F.col("message_id") % 2 == 1)
    chunk = (F.col("message_id") * 7 + F.col("position") * 13) % rows_in(spark, folder, "embeddings")
    cited = placed.withColumn("chunk_id", F.when(~web, chunk))
    return cited.select(
        "message_id", "position", F.when(web, "web").otherwise("document").alias("type"), "chunk_id",
        document_of(spark, folder, F.col("chunk_id"))[0].alias("document_id"),
        F.expr("concat('{\"index\":', position + 1, '}')").alias("metadata"),
    )


def web_results(spark: SparkSession, folder: str) -> DataFrame:
    """Crawled pages as search results of a query per host, best page first by id."""
    return pages(spark, folder).select(
        "page_id", "url", "html",
        F.expr("nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')").alias("title"),
        F.expr("case when page_id % 3 != 0 then (page_id % 97) / 97.0D end").alias("score"),
        F.expr("regexp_extract(url, '^[a-z]+://(?:www\\\\.)?([^/:?#]+)', 1)").alias("query_id"),
    )


def as_of() -> Column:
    """The fixed "now" of every query that needs one."""
    return F.expr("timestamp_ntz'2024-03-01 12:00:00'")


def session_time() -> Column:
    return F.expr("timestamp_ntz'2024-01-29 00:00:00'")


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts as uploaded files of several kinds, some of them mislabelled."""
    return texts(spark, folder).select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"),
        F.expr(
            "concat('folder.v1/doc.', doc_id, element_at(array('.txt', '.md', '.pdf', '.docx', '.exe', '.TXT', ''),"
            " cast(doc_id % 7 as int) + 1))"
        ).alias("name"),
        F.expr(
            "case when doc_id % 13 = 0 then concat(encode('#!', 'UTF-8'), encode(text, 'UTF-8'))"
            " when doc_id % 14 = 2 then concat(encode('%PDF', 'UTF-8'), encode(text, 'UTF-8'))"
            " when doc_id % 14 = 3 then concat(unhex('504B0304'), encode(text, 'UTF-8'))"
            " when doc_id % 17 = 0 then unhex('')"
            " else encode(text, 'UTF-8') end"
        ).alias("content"),
        F.expr("case when doc_id % 11 = 0 then 'image/png' when doc_id % 11 = 1 then 'application/octet-stream' else 'text/plain' end").alias("mime_type"),
    ).withColumn("length", F.length("content").cast("bigint"))


def processing(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in every processing status, with counters taken from their sizes."""
    number = "cast(doc_id % 10 as bigint)"
    stage = "element_at(array('uploading', 'extracting', 'ocr', 'chunking', 'embedding', 'failed'), cast(doc_id % 6 as int) + 1)"
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.expr(
            "element_at(array('pending', 'uploading', 'extracting', 'ocr', 'chunking', 'embedding', 'processing',"
            " 'ready', 'failed'), cast(doc_id % 9 as int) + 1)"
        ).alias("status"),
        F.expr(
            "named_struct("
            f"'stage', case when doc_id % 5 != 0 then {stage} end,"
            f"'page', case when doc_id % 2 = 0 then {number} end,"
            "'pages', case when doc_id % 4 = 0 then n_chars end,"
            f"'ocrPages', case when doc_id % 7 = 0 then {number} end,"
            f"'block', case when doc_id % 3 = 0 then {number} end,"
            "'blocks', case when doc_id % 3 != 1 then n_chars end,"
            f"'batches', case when doc_id % 4 != 1 then {number} end,"
            "'batchesTotal', case when doc_id % 8 < 4 then n_chars end,"
            "'chunks', n_chars, 'chunksTotal', n_chars)"
        ).alias("progress"),
        F.expr("cast(case when doc_id % 6 = 0 then 0 when doc_id % 6 = 1 then 1 when doc_id % 6 = 2 then n_chars end as int)").alias("chunk_count"),
        F.expr("case when doc_id % 2 = 0 then 'boom' end").alias("error_message"),
        F.expr("case when doc_id % 4 = 1 then cast(doc_id % 150 as double) + 0.25D - 10 end").alias("upload_percent"),
        (F.col("doc_id") % 23 == 0).alias("backgrounded"),
    )


def page_table(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the stored texts as pages; short ones have recognised text or a blank one."""
    return texts(spark, folder).select(
        F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")
    ).select(
        "document_id", (F.col("pos") + 1).alias("page"), "text",
        F.expr("case when document_id % 10 = 3 and pos = 0 then null when pos % 3 = 0 then '' else concat('Scan ', text) end").alias("recognised_text"),
    )


def search_terms(spark: SparkSession, folder: str) -> DataFrame:
    """One search per user: a word of the user's own questions, and one with a wildcard."""
    asked = messages(spark, folder).filter("role = 'user'").select(
        F.expr("concat('src', conversation_id % 20)").alias("user_id"),
        F.expr("lower(regexp_extract(content, '^([^ .,]+)', 1))").alias("word"),
    )
    words = asked.groupBy("user_id").agg(F.max("word").alias("word"))
    return words.select(
        "user_id", F.explode(F.expr("array(concat(' ', word), concat(substr(word, 1, 2), '_', substr(word, 4)), 'x')")).alias("term")
    )


def message_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of every answer with the cited chunk's text: context input per answer."""
    cited = sources(spark, folder).join(
        chunks(spark, folder).select("chunk_id", F.col("content"), F.col("metadata.page").alias("page"),
                                     F.col("metadata.documentName").alias("document_name")),
        "chunk_id", "left",
    )
    return cited.select(
        F.col("message_id").alias("query_id"), (F.col("position") + 1).alias("index"), "type", "document_id", "chunk_id",
        F.expr("if(type = 'web', concat('Page ', message_id), document_name)").alias("title"),
        F.expr("if(type = 'web', concat('https://example.com/', message_id), null)").alias("url"),
        "document_name", "page", "content",
        F.expr("if(type = 'web', concat('Snippet ', message_id), substr(content, 1, 600))").alias("snippet"),
    )


PHRASES = [
    "What is the latest news about ", "Summarize my document: ", "Compare my report with the latest research on ",
    "hello", "explain ", "", "According to the report on page 4, ", "box office collection of ", "In 2025, ",
    "Please tell me about the ", "I uploaded a contract - ", "thanks!", "since 2026 ", "```code``` # Can you please describe the ",
    "What does it say? How does this work",
]


ROUTE_ANSWERS = ["web", "The route is DOCUMENTS.", "llm", "Hybrid", "no idea", "", "documents or web"]


def questions_asked(spark: SparkSession, folder: str) -> DataFrame:
    """User messages behind phrases that carry routing signals, with the flags of their turn."""
    phrases = ", ".join("'" + p + "'" for p in PHRASES)
    ready = documents(spark, folder).filter("status = 'ready'").groupBy("user_id").agg(F.count("*").alias("ready"))
    asked = spread(messages(spark, folder)).filter("role = 'user'").select(
        "message_id", "conversation_id", F.expr("concat('src', conversation_id % 20)").alias("user_id"), "position",
        F.expr(f"element_at(array({phrases}), cast((message_id div 3) % {len(PHRASES)} as int) + 1)").alias("phrase"),
        "content",
    )
    return asked.join(ready, "user_id", "left").select(
        "message_id", "conversation_id", "user_id", "position",
        F.expr("case when phrase in ('hello', 'thanks!') then phrase else concat(phrase, content) end").alias("message"),
        F.expr("coalesce(ready, 0) > 0 and conversation_id % 4 != 1").alias("has_documents"),
        F.expr("message_id % 10 = 7").alias("has_attachment"),
        F.expr("conversation_id % 5 != 2").alias("web_enabled"),
        F.expr("message_id % 9 = 4").alias("force_web"),
    )


def route_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a classifier to three of four messages, some of them in a sentence or without a route."""
    answers = ", ".join("'" + a + "'" for a in ROUTE_ANSWERS)
    return messages(spark, folder).filter("message_id % 4 != 0").select(
        "message_id", F.expr(f"element_at(array({answers}), cast(message_id % {len(ROUTE_ANSWERS)} as int) + 1)").alias("label"),
    )


MODEL_PATH = (
    "element_at(array("
    "concat('C:\\\\hub\\\\models--org--model-', label, '\\\\snapshots\\\\', vec_id),"
    "concat('/cache/models--a--b', label, '/snapshots/x'), concat('/models/local-', label, '/'),"
    "concat('org/model-', label), concat('D:\\\\m\\\\plain', label), ''), cast(vec_id % 6 as int) + 1)"
)
ERROR_TEXT = (
    "concat('Upstream status ', 404 + cast(get_json_object(props, '$.k') as int),"
    " case event_type when 'error' then ' Unauthorized' when 'view' then ' Request timed out'"
    " when 'click' then ' Rate Limit' else '' end)"
)


def paragraph_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts with every line as a paragraph of its own; every fifth has wider gaps."""
    return texts(spark, folder).select(
        F.col("doc_id").alias("document_id"),
        F.expr("replace(text, '\\n', if(doc_id % 5 = 0, '\\n\\n \\n\\n', '\\n\\n'))").alias("text"),
    )


#: Top folders of written files: above Spark's threshold (32), so that one distributed job lists them.
RAW_SLICES = 64
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_raw_files(rows: DataFrame, path: str) -> None:
    """Texts (document_id, user_id, text) as files: one folder per user and document, the text and a line end in it.

    Rows of one user and document share a file. On mounted folders the tasks write the files themselves,
    because Hadoop's local file system starts several processes for each folder and file.
    """
    spark = rows.sparkSession
    slice_of = F.pmod(F.hash("document_id"), F.lit(RAW_SLICES)).alias("slice")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(slice_of, F.nullif("user_id", F.lit("")).alias("user_id"), "document_id", "text").repartition(tasks, "document_id")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file":
        dealt.write.mode("append").partitionBy("slice", "user_id", "document_id").option("compression", "none").text(path)
        return
    base, name = system.makeQualified(place).toUri().getPath(), f"part-{uuid.uuid4().hex}.txt"
    bounded_batches(spark)
    columns = [F.col(c).cast("string") for c in ("slice", "user_id", "document_id", "text")]
    ordered = dealt.sortWithinPartitions("user_id", "document_id").select(*columns)
    ordered.mapInArrow(lambda batches: _written_files(batches, base, name), "files bigint").agg(F.sum("files")).collect()


def _folder(column: str, value: str | None) -> str:
    """Folder of a partition value, named as Spark names it."""
    escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
    return f"{column}={escaped or NO_VALUE}"


def _written_files(batches: Iterator[pa.RecordBatch], base: str, name: str) -> Iterator[pa.RecordBatch]:
    """One file per run of rows of the same user and document; the number of files."""
    last, out, files = None, None, 0
    try:
        for batch in batches:
            for place, user, document, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (user, document) != last:
                    if out:
                        out.close()
                    folder = os.path.join(base, f"slice={place}", _folder("user_id", user), _folder("document_id", document))
                    os.makedirs(folder, exist_ok=True)
                    out, last, files = open(os.path.join(folder, name), "wb"), (user, document), files + 1
                out.write((text or "").encode() + b"\n")
    finally:
        if out:
            out.close()
    yield pa.RecordBatch.from_pydict({"files": [files]})


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    owners = table(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"))
    return paragraph_texts(spark, folder).join(owners, "document_id")


def owner_of(path: Column) -> Column:
    return F.regexp_extract(path, "user_id=([^/]+)/", 1)


def markdown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored texts as Markdown: some lines become headings, some open or close a code fence."""
    text = "regexp_replace(regexp_replace(regexp_replace(text, '(?m)^(E[a-z])', '## $1'), '(?m)^(Th[a-f])', '```$1'), '(?m)^(An?[a-z])', ' # $1')"
    return texts(spark, folder).select(
        F.col("doc_id").alias("document_id"), F.expr(text).alias("text")
    )


def _package(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, body in parts.items():
            package.writestr(name, body)
    return buffer.getvalue()


def word_package(lines: list[str]) -> bytes:
    """A Word package: first line as title, every fifth as heading, every fourth as list item,
    and a table of the first two lines."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def paragraph(text: str, style: str | None) -> str:
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{props}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    body = []
    for i, line in enumerate(lines):
        style = "Title" if i == 0 else "H1" if i % 5 == 0 else "ListBullet" if i % 4 == 0 else None
        body.append(paragraph(line, style))
    cells = "".join(f"<w:tc>{paragraph(line, None)}</w:tc>" for line in lines[:2])
    body.append(f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>")
    styles = "".join(
        f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
        for i, n in (("Title", "Title"), ("H1", "heading 1"), ("ListBullet", "List Bullet"))
    )
    return _package({
        "word/document.xml": f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>",
        "word/styles.xml": f"<w:styles {w}>{styles}</w:styles>",
    })


def slide_package(slides: list[dict]) -> bytes:
    """A slide package from dicts with title, lines [(level, text)], rows and notes."""
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    p = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'

    def line(text: str, level: int = 0) -> str:
        return f'<a:p><a:pPr lvl="{level}"/><a:r><a:t>{escape(text)}</a:t></a:r></a:p>'

    def shape(kind: str | None, body: str) -> str:
        mark = f'<p:ph type="{kind}"/>' if kind else ""
        return f"<p:sp><p:nvSpPr><p:nvPr>{mark}</p:nvPr></p:nvSpPr><p:txBody>{body}</p:txBody></p:sp>"

    parts, ids, links = {}, [], []
    for number, slide in enumerate(slides, 1):
        shapes = shape("title", line(slide["title"])) if slide.get("title") else ""
        shapes += shape(None, "".join(line(t, lvl) for lvl, t in slide.get("lines", [])))
        for row in slide.get("rows", []):
            cells = "".join(f"<a:tc><a:txBody>{line(c)}</a:txBody></a:tc>" for c in row)
            shapes += f"<p:graphicFrame><a:tbl><a:tr>{cells}</a:tr></a:tbl></p:graphicFrame>"
        parts[f"ppt/slides/slide{number}.xml"] = f"<p:sld {a} {p}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        if slide.get("notes"):
            parts[f"ppt/slides/_rels/slide{number}.xml.rels"] = (
                f'<Relationships {rels}><Relationship Id="rId1" Type="{rel}/notesSlide" '
                f'Target="../notesSlides/notesSlide{number}.xml"/></Relationships>'
            )
            notes = shape("body", line(slide["notes"]))
            parts[f"ppt/notesSlides/notesSlide{number}.xml"] = f"<p:notes {a} {p}><p:cSld><p:spTree>{notes}</p:spTree></p:cSld></p:notes>"
        ids.append(f'<p:sldId id="{255 + number}" r:id="rId{number}"/>')
        links.append(f'<Relationship Id="rId{number}" Type="{rel}/slide" Target="slides/slide{number}.xml"/>')
    parts["ppt/presentation.xml"] = f"<p:presentation {p} {r}><p:sldIdLst>{''.join(ids)}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = f"<Relationships {rels}>{''.join(links)}</Relationships>"
    return _package(parts)


def _packaged(spark: SparkSession, folder: str, build) -> DataFrame:
    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame(
                {"document_id": pdf["doc_id"], "content": [build(t.split("\n")) for t in pdf["text"]]}
            )

    bounded_batches(spark)
    return texts(spark, folder).select("doc_id", "text").mapInPandas(
        pack, "document_id bigint, content binary"
    )


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored text packed as a Word file."""
    return _packaged(spark, folder, word_package)


def pptx_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored text packed as slides: one per line, with bullets, a table and notes."""

    def build(lines):
        return slide_package([
            {
                "title": line if i % 3 != 2 else "", "lines": [(0, line), (i % 3, line)] if i % 2 == 0 else [],
                "rows": [["row", line]] if i % 4 == 1 else [], "notes": line if i % 5 == 0 else "",
            }
            for i, line in enumerate(lines)
        ])

    return _packaged(spark, folder, build)


LOG_SCHEMA = "event_id long, type string, stage string, page long"


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events as JSON lines, some of them cut off."""
    line = "concat('{\"event_id\":', event_id, ',\"type\":\"status\",\"stage\":\"', event_type, '\",\"page\":', get_json_object(props, '$.k'), '}')"
    return table(spark, folder, "events").select(
        F.expr(f"case when event_id % 13 = 0 then substr({line}, 1, 20) when event_id % 19 = 0 then concat('  ', {line}, ' ') else {line} end").alias("value")
    )


def sse_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Events as server-sent frames: heartbeats, unnamed, split and broken ones among them."""
    return table(spark, folder, "events").select(
        "event_id",
        F.expr(
            "case when event_id % 10 = 0 then ': ping'"
            " when event_id % 10 = 1 then concat('data: ', props)"
            " when event_id % 10 = 2 then concat(': note\\nevent: ', event_type, '\\ndata: {\"k\":\\ndata: 1}')"
            " when event_id % 10 = 3 then concat('event: ', event_type, '\\ndata: {bad')"
            " else concat('event: ', event_type, '\\ndata: ', props) end"
        ).alias("value"),
    )


def processing_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events read as processing events of one document per user."""
    return processing_rows(requests(spark, folder))


def processing_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("key").alias("document_id"), F.col("request_id").alias("seq"), "event_type",
        F.col("k").cast("bigint").alias("k"),
    ).selectExpr(
        "document_id", "seq",
        "case when event_type = 'click' then 'chunks' when event_type = 'purchase' and k < 4 then 'result'"
        " when event_type = 'error' and k >= 97 then 'error' else 'status' end as type",
        "case when event_type = 'signup' and k < 10 then 'ocr' else 'extracting' end as stage",
        "case when event_type != 'click' and k % 2 = 0 then k end as page",
        "case when event_type != 'click' and k % 5 = 0 then k + 100 end as pages",
        "case when event_type = 'signup' then k end as ocrPages",
        "case when event_type = 'view' and k % 3 = 0 then k end as block",
        "case when event_type = 'view' and k % 7 = 0 then k + 50 end as blocks",
        "k % 64 as count", "seq as index", "k + 1 as batches",
        "case when k = 98 then null else concat('E', k) end as code", "concat('failed at ', k) as message",
    )


def processing_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Processing events by run: a document's next event after its end begins a document of its own."""
    asked = requests(spark, folder)
    rows = processing_rows(asked).join(asked.select(F.col("request_id").alias("seq"), "at"), "seq")
    ends = F.col("type").isin("result", "error").cast("int")
    numbered = slab_running_sum(
        rows, ["document_id"], F.floor(F.col("at") / 86_400_000_000), [F.col("at"), F.col("seq")], ends, "run", inclusive=False
    )
    return numbered.withColumn("document_id", F.concat_ws("-", "document_id", "run")).drop("run")


def answer_events(spark: SparkSession, folder: str) -> DataFrame:
    """Answers replayed as token events, word by word, each ended by a done or an error event."""
    return token_rows(messages(spark, folder))


def token_rows(said: DataFrame) -> DataFrame:
    answers = said.filter("role = 'assistant'")
    # A token a millisecond, from the time of the message.
    said_at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', created_at)")
    words = answers.select("message_id", "created_at", F.posexplode(F.split("content", " ", -1)).alias("seq", "word"))
    tokens = words.select(
        "message_id", F.col("seq").cast("bigint").alias("seq"),
        F.expr("case when message_id % 5 = 0 and seq % 10 = 9 then 'critique_token' else 'token' end").alias("type"),
        F.expr("case when message_id % 13 = 0 then ' ' else concat(word, ' ') end").alias("text"),
        F.lit(None).cast("string").alias("finish_reason"), F.lit(None).cast("string").alias("code"),
        F.lit(False).alias("aborted"), (said_at + F.col("seq") * 1000).alias("at"),
    )
    ends = answers.select(
        # Behind the last token, however long the answer is.
        "message_id", F.size(F.split("content", " ", -1)).cast("bigint").alias("seq"),
        F.expr("if(message_id % 11 = 0, 'error', 'done')").alias("type"), F.lit(None).cast("string").alias("text"),
        F.expr("if(message_id % 3 = 0, 'stop', null)").alias("finish_reason"),
        F.expr("if(message_id % 22 = 0, 'LLM_TIMEOUT', null)").alias("code"),
        F.expr("message_id % 7 = 0").alias("aborted"), (said_at + F.size(F.split("content", " ", -1)) * 1000).alias("at"),
    )
    return tokens.unionByName(ends)


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Stored events as a request log; time in microseconds since 1970."""
    return request_rows(table(spark, folder, "events"))


def request_rows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "event_type",
        F.expr("cast(get_json_object(props, '$.k') as int)").alias("k"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("at"),
    )
