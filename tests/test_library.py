from datetime import datetime

from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.operators import conversations, library, mutations
from tests.conftest import rows

# status, progress, upload percent, backgrounded, chunk count, error -> label, detail, percent, tone, done
PROGRESS = [
    (("uploading", {}, 35.0, False, None, None), ("Uploading", "35%", 35, "active", False)),
    (("uploading", {}, 34.6, False, None, None), ("Uploading", "35%", 35, "active", False)),
    (("uploading", {}, -5.0, False, None, None), ("Uploading", "-5%", 0, "active", False)),
    (("uploading", {}, 140.0, False, None, None), ("Uploading", "140%", 100, "active", False)),
    (("uploading", {}, None, False, None, None), ("Uploading", None, None, "active", False)),
    (("extracting", {"stage": "extracting", "page": 140, "pages": 560}, None, False, None, None), ("Extracting text", "page 140 of 560", 25, "active", False)),
    (("extracting", {"stage": "extracting", "block": 3, "blocks": 7}, None, False, None, None), ("Extracting text", "section 3 of 7", 43, "active", False)),
    (("extracting", {"blocks": 1}, None, False, None, None), ("Extracting text", "1 section", None, "active", False)),
    (("extracting", {"stage": "extracting"}, None, False, None, None), ("Extracting text", None, None, "active", False)),
    (("ocr", {"stage": "ocr", "page": 42, "pages": 180, "ocrPages": 7}, None, False, None, None), ("Reading scanned pages", "page 42 of 180", 23, "active", False)),
    (("ocr", {"stage": "ocr", "ocrPages": 3}, None, False, None, None), ("Reading scanned pages", "3 pages so far", None, "active", False)),
    (("ocr", {"stage": "ocr", "ocrPages": 1}, None, False, None, None), ("Reading scanned pages", "1 page so far", None, "active", False)),
    (("embedding", {"stage": "embedding", "batches": 8, "batchesTotal": 32, "chunks": 512}, None, False, None, None), ("Generating embeddings", "batch 8 of 32", 25, "active", False)),
    (("embedding", {"stage": "embedding", "batches": 8, "chunks": 512}, None, False, None, None), ("Generating embeddings", "batch 8", None, "active", False)),
    (("embedding", {"stage": "embedding", "chunks": 64}, None, False, None, None), ("Generating embeddings", "64 chunks indexed", None, "active", False)),
    (("chunking", {"chunks": 1}, None, False, None, None), ("Splitting into chunks", "1 chunk so far", None, "active", False)),
    (("ready", {}, None, False, 1120, None), ("Ready", "Indexed 1120 chunks", 100, "done", True)),
    (("ready", {"chunksTotal": 1}, None, False, None, None), ("Ready", "Indexed 1 chunk", 100, "done", True)),
    (("failed", {"stage": "embedding", "batches": 4, "batchesTotal": 32}, None, False, None, "boom"), ("Failed", "boom", None, "error", True)),
    (("embedding", {"stage": "embedding", "batches": 8}, None, True, None, None), ("Still processing", library.BACKGROUND_DETAIL, None, "active", False)),
    (("extracting", {"stage": "ocr", "page": 2, "pages": 4}, None, False, None, None), ("Reading scanned pages", "page 2 of 4", 50, "active", False)),
    ((None, {}, None, False, None, None), ("Queued", None, None, "active", False)),
]


def test_progress_table(spark):
    names = [f.name for f in S.PROGRESS.fields]
    data = [
        (i, status, tuple(p.get(n) for n in names), up, back, count, error)
        for i, ((status, p, up, back, count, error), _) in enumerate(PROGRESS)
    ]
    schema = f"i int, status string, progress {S.PROGRESS.simpleString()}, upload_percent double, backgrounded boolean, chunk_count int, error_message string"
    got = rows(library.describe_progress(spark.createDataFrame(data, schema)).orderBy("i"), "label", "detail", "percent", "tone", "done")
    assert got == [want for _, want in PROGRESS]


NOW = datetime(2024, 5, 1)
OLD = datetime(2024, 1, 1)


def test_patch_distinguishes_absent_from_null(spark):
    base = spark.createDataFrame([(i, "u", f"t{i}", "auto", 7, OLD) for i in range(5)], "conversation_id int, user_id string, title string, mode string, document_id int, updated_at timestamp")
    patches = spark.createDataFrame(
        [(0, "u", None, "web", None, False), (1, "u", "new", None, None, True), (2, "u", None, None, 9, True), (3, "other", "x", "web", 1, True)],
        "conversation_id int, user_id string, title string, mode string, document_id int, has_document_id boolean",
    )
    got = rows(mutations.patch_conversations(base, patches, F.lit(NOW)).orderBy("conversation_id"), "title", "mode", "document_id", "updated_at")
    assert got == [("t0", "web", 7, NOW), ("new", "auto", None, NOW), ("t2", "auto", 9, NOW), ("t3", "auto", 7, OLD), ("t4", "auto", 7, OLD)]


def test_pinning(spark):
    base = spark.createDataFrame([(1, "u", False, None), (2, "u", True, OLD), (3, "u", True, OLD)], "conversation_id int, user_id string, pinned boolean, pinned_at timestamp")
    pins = spark.createDataFrame([(1, "u", True), (2, "u", False), (3, "v", False)], "conversation_id int, user_id string, pinned boolean")
    got = rows(mutations.set_pinned(base, pins, F.lit(NOW)).orderBy("conversation_id"), "pinned", "pinned_at")
    assert got == [(True, NOW), (False, None), (True, OLD)]


def test_status_change_keeps_counters(spark):
    docs = spark.createDataFrame([(1, "extracting", "e", "C", 5, "p", OLD), (2, "ready", None, None, 1, "q", OLD)], "document_id int, status string, error_message string, error_code string, chunk_count int, progress string, updated_at timestamp")
    change = spark.createDataFrame([(1, "embedding", None, "r")], "document_id int, status string, chunk_count int, progress string")
    got = rows(mutations.apply_document_status(docs, change, F.lit(NOW)).orderBy("document_id"))
    assert got == [(1, "embedding", None, None, 5, "r", NOW), (2, "ready", None, None, 1, "q", OLD)]


def test_append_requires_a_model(spark, tmp_path):
    docs = spark.createDataFrame([("d", "u")], "document_id string, user_id string")
    rows_ = spark.createDataFrame([("c1", "d", "u", "m"), ("c2", "d", "v", "m"), ("c3", "x", "u", "m")], "chunk_id string, document_id string, user_id string, embedding_model string")
    assert rows(mutations.append_chunks(rows_, docs), "chunk_id") == [("c1",)]
    mutations.write_chunks(rows_, docs, str(tmp_path / "chunks"))
    mutations.write_chunks(rows_, docs, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 2
    try:
        mutations.append_chunks(rows_.withColumn("embedding_model", F.lit("")), docs).collect()
        raise AssertionError("a chunk without model was accepted")
    except Exception as error:  # noqa: BLE001
        assert "embedding_model" in str(error)


def test_search_terms_and_ranks(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    talks = spark.createDataFrame(
        [(1, "u", "About Foxes", None, False, t[0]), (2, "u", "Other", None, False, t[5]), (3, "u", "x", None, True, t[1]), (4, "v", "foxes", None, False, t[2])],
        "conversation_id int, user_id string, title string, document_id int, pinned boolean, updated_at timestamp",
    )
    said = spark.createDataFrame(
        [(1, 2, "a FOX ran", t[0]), (2, 2, "the fox slept", t[1]), (3, 3, "no animals", t[2]), (4, 4, "fox", t[3]), (5, 3, "firefox", t[4])],
        "message_id int, conversation_id int, content string, created_at timestamp",
    )
    docs = spark.createDataFrame([], "document_id int, user_id string, name string")
    terms = spark.createDataFrame([("u", " fox "), ("u", "f"), ("u", "zzz"), ("v", "f_x")], "user_id string, term string")
    got = rows(conversations.search_conversations(terms, talks, said, docs).orderBy("user_id", "position"), "user_id", "conversation_id", "match_source", "snippet", "message_count")
    assert got == [("u", 3, "message", "firefox", 2), ("u", 1, "title", None, 0), ("u", 2, "message", "the fox slept", 2), ("v", 4, "title", "fox", 1)]


def test_dedupe_actions(spark):
    docs = spark.createDataFrame([(1, "u", "h1", "failed"), (2, "u", "h1", "ready"), (3, "u", "h2", "ocr"), (4, "u", "h3", "failed"), (5, "v", "h4", "ready")], "document_id int, user_id string, content_hash string, status string")
    new = spark.createDataFrame([("a", "u", "h1"), ("b", "u", "h2"), ("c", "u", "h3"), ("d", "u", "h4")], "name string, user_id string, content_hash string")
    got = sorted(rows(library.dedupe_against_library(new, docs), "name", "action"))
    assert got == [("a", "reuse"), ("b", "conflict"), ("c", "replace"), ("d", "new")]


def test_changes_of_one_key_are_folded(spark):
    base = spark.createDataFrame([(1, "u", False, None)], "conversation_id int, user_id string, pinned boolean, pinned_at timestamp_ntz")
    pins = spark.createDataFrame([(1, "u", True, 1), (1, "u", False, 2), (None, "u", True, 3)], "conversation_id int, user_id string, pinned boolean, at int")
    now = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    assert rows(mutations.set_pinned(base, pins, now, order="at"), "conversation_id", "pinned") == [(1, False)]
    documents = spark.createDataFrame([(1, "ready", None, None, None)], "document_id int, status string, error_message string, error_code string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "ocr"), (1, "ready")], "document_id int, status string")
    assert rows(mutations.apply_document_status(documents, changes, now), "status") == [("ready",)]


def test_deleted_documents_leave_no_references(spark):
    tables = {
        "documents": spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "document_id int, user_id string"),
        "chunks": spark.createDataFrame([(10, 1, "u"), (20, 2, "u"), (30, 3, "v")], "chunk_id int, document_id int, user_id string"),
        "conversations": spark.createDataFrame([(5, 1), (6, 2), (7, None)], "conversation_id int, document_id int"),
        "sources": spark.createDataFrame([(8, 1, 10), (9, 3, 30), (10, None, None)], "message_id int, document_id int, chunk_id int"),
    }
    requests = spark.createDataFrame([(1, "u"), (3, "u")], "document_id int, user_id string")
    out = mutations.delete_with_references(tables, requests)
    assert sorted(rows(out["documents"], "document_id")) == [(2,), (3,)] and sorted(rows(out["chunks"], "chunk_id")) == [(20,), (30,)]
    assert sorted(rows(out["conversations"], "conversation_id", "document_id"), key=str) == [(5, None), (6, 2), (7, None)]
    assert sorted(rows(out["sources"]), key=str) == [(10, None, None), (8, None, None), (9, 3, 30)]
