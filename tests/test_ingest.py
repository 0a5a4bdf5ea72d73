import os

import pytest
from pyspark.sql import functions as F

from corpusflow import views
from corpusflow.operators import retrieval
from corpusflow.plans import ingest
from corpusflow.sources import files, mounted
from corpusflow.streaming import jobs
from tests.conftest import rows

UPLOADS = [
    ("u", "a.txt", b"First paragraph.\n\nSecond one about foxes."), ("u", "copy.txt", b"First paragraph.\n\nSecond one about foxes."),
    ("u", "b.md", b"# Title\n\nBody about whales."), ("u", "c.docx", views.word_package(["Head", "Text about owls"])),
    ("u", "d.pptx", views.slide_package([{"title": "Slide", "lines": [(0, "bears")]}])), ("u", "bad.docx", b"PK\x03\x04junk"),
    ("u", "blank.txt", b" \n\t "), ("u", "e.pdf", b"%PDF-1.4"), ("u", "f.sh", b"ls"), ("v", "g.txt", b"known text"),
    ("v", "h.txt", b"failed before"), ("v", "i.txt", b"still running"),
]


def upload_rows(spark):
    return spark.createDataFrame(
        [(u, n, "text/plain", len(c), bytearray(c)) for u, n, c in UPLOADS],
        "user_id string, name string, mime_type string, length long, content binary",
    )


def library_rows(spark):
    known = [("v", b"known text", "ready"), ("v", b"failed before", "failed"), ("v", b"still running", "ocr")]
    df = spark.createDataFrame([(u, bytearray(c), s) for u, c, s in known], "user_id string, content binary, status string")
    return df.select("user_id", F.sha2("content", 256).alias("content_hash"), "status", F.lit("x").alias("document_id"))


def test_ingestion(spark):
    out = ingest.ingest_documents(upload_rows(spark), library_rows(spark))
    actions = dict(rows(out["verdicts"], "name", "action"))
    assert actions == {
        "a.txt": "new", "copy.txt": "reuse", "b.md": "new", "c.docx": "new", "d.pptx": "new", "bad.docx": "new", "blank.txt": "new",
        "e.pdf": "new", "f.sh": "reject", "g.txt": "reuse", "h.txt": "replace", "i.txt": "conflict",
    }
    states = {r[0]: r[1:] for r in rows(out["documents"], "original_filename", "status", "error_code", "chunk_count")}
    assert states == {
        "a.txt": ("ready", None, 2), "b.md": ("ready", None, 1), "c.docx": ("ready", None, 3), "d.pptx": ("ready", None, 1),
        "bad.docx": ("failed", "PARSE_FAILED", 0), "blank.txt": ("failed", "NO_TEXT_EXTRACTED", 0),
        "e.pdf": ("failed", "UNSUPPORTED_FORMAT", 0), "h.txt": ("ready", None, 1),
    }
    infos = dict(rows(out["documents"], "original_filename", "extraction_info"))
    assert infos["b.md"] == '{"headings":1,"lines":3,"chunks":1,"embeddingModel":"hashing-tf-768"}'
    assert infos["c.docx"].startswith('{"paragraphs":2,"tables":1,') and infos["bad.docx"] is None
    first = sorted(rows(out["chunks"].filter("content like '%foxes%'"), "chunk_index", "metadata"))
    assert first == [(1, '{"documentName":"a.txt","line":3}')]

    # What was ingested can be searched: each chunk is nearest to itself.
    chunks = out["chunks"].withColumn("metadata", F.from_json("metadata", views_metadata()))
    documents = out["documents"]
    asked = chunks.select(F.col("chunk_id").alias("query_id"), "user_id", "embedding", "embedding_model")
    found = retrieval.retrieve(asked, chunks, documents, k=1)
    assert all(q == c and d == 0 for q, c, d in rows(found, "query_id", "chunk_id", "distance"))
    assert found.count() == out["chunks"].count()


def views_metadata():
    return "documentName string, page int, slide int, paragraph int, line int, table int, section string, title string"


def test_page_reader_plugs_in(spark):
    def read_pages(pdfs):
        return pdfs.select(
            "document_id", F.lit(1).alias("page"), F.lit("a page of text that is long enough to keep").alias("text"),
            F.lit(None).cast("string").alias("recognised_text"),
        )

    extractors = {**ingest.EXTRACTORS, ".pdf": ingest.paged_extractor(read_pages)}
    out = ingest.ingest_documents(upload_rows(spark).filter("name = 'e.pdf'"), library_rows(spark), extractors=extractors)
    assert rows(out["documents"], "status", "chunk_count") == [("ready", 1)]


def test_unread_scan_fails_the_document(spark):
    def read_pages(pdfs):
        return pdfs.select(
            "document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"),
            F.lit("a page of text that is long enough to keep").alias("text"), F.lit(None).cast("string").alias("recognised_text"),
        ).withColumn("text", F.when(F.col("page") == 1, F.col("text")).otherwise("scan"))

    extractors = {".pdf": ingest.paged_extractor(read_pages)}
    out = ingest.ingest_documents(upload_rows(spark).filter("name = 'e.pdf'"), library_rows(spark), extractors=extractors)
    assert rows(out["documents"], "status", "error_code", "chunk_count") == [("failed", "OCR_UNAVAILABLE", 0)]
    assert out["chunks"].count() == 0


def test_a_failing_listener_is_harmless(spark):
    counted, counter = ingest.observed(spark.range(7), "rows-read")
    counted.count()
    seen = []
    ingest.report_progress(counter, seen.append)
    ingest.report_progress(counter, lambda event: 1 / 0)
    assert seen == [{"rows": 7}]


def test_incremental_ingestion(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    (source / "u1").mkdir(parents=True)

    def run():
        stream = files.scan_raw_files(jobs.stream_session(spark, 2), str(source), stream=True, max_files=10)
        owner = lambda path: F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
        jobs.incremental_ingest(stream, target, str(tmp_path / "cp"), user_of=owner).awaitTermination()
        return spark.read.parquet(f"{target}/documents"), spark.read.parquet(f"{target}/chunks")

    (source / "u1" / "a.txt").write_text("one\n\ntwo")
    documents, chunks = run()
    assert rows(documents, "user_id", "status", "chunk_count") == [("u1", "ready", 2)] and chunks.count() == 2
    (source / "u1" / "again.txt").write_text("one\n\ntwo")
    (source / "u1" / "b.txt").write_text("three")
    documents, chunks = run()
    assert sorted(rows(documents, "original_filename")) == [("a.txt",), ("b.txt",)] and chunks.count() == 3
    assert run()[1].count() == 3


def files_at(spark, entries):
    return spark.createDataFrame(
        [(p, u, p.rsplit("/", 1)[-1], "text/plain", len(c), bytearray(c)) for p, u, c in entries],
        "path string, user_id string, name string, mime_type string, length long, content binary",
    )


def test_equal_names_stay_apart(spark):
    uploads = files_at(spark, [
        ("/one/a.txt", "u", b"first text"), ("/two/a.txt", "u", b"second text"), ("/three/a.txt", "u", b"second text"),
        ("/one/a.txt#v", "v", b"first text"),
    ]).withColumn("name", F.lit("a.txt"))
    out = ingest.ingest_documents(uploads, library_rows(spark))
    assert sorted(rows(out["verdicts"], "path", "action")) == [
        ("/one/a.txt", "new"), ("/one/a.txt#v", "new"), ("/three/a.txt", "new"), ("/two/a.txt", "reuse"),
    ]
    assert sorted(rows(out["chunks"], "user_id", "content")) == [("u", "first text"), ("u", "second text"), ("v", "first text")]
    assert sorted(rows(out["documents"], "user_id", "chunk_count")) == [("u", 1), ("u", 1), ("v", 1)]


def test_equal_rows_without_a_path_are_one_file(spark):
    twice = upload_rows(spark).filter("name = 'a.txt'")
    out = ingest.ingest_documents(twice.union(twice), library_rows(spark))
    assert out["verdicts"].count() == out["documents"].count() == 1 and out["chunks"].count() == 2


def test_a_failed_upload_is_replaced(spark):
    out = ingest.ingest_documents(upload_rows(spark).filter("name in ('h.txt', 'g.txt')"), library_rows(spark))
    assert rows(out["replaced"], "document_id", "user_id") == [("x", "v")]


def test_mixed_vectors_fail_the_document(spark):
    def embed(df):
        return df.withColumns({
            "embedding": F.when(F.col("chunk_index") == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))),
            "embedding_model": F.lit("m"),
        })

    out = ingest.ingest_documents(upload_rows(spark).filter("name in ('a.txt', 'b.md')"), library_rows(spark), embed)
    assert sorted(rows(out["documents"], "original_filename", "status", "error_code", "chunk_count")) == [
        ("a.txt", "failed", "DIMENSION_MISMATCH", 0), ("b.md", "ready", None, 1),
    ]
    assert out["chunks"].count() == 1


def test_streams_read_every_folder_and_skip_large_bytes(spark, tmp_path):
    for folder, text in (("x", "short"), ("y", "far too long for the limit")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.txt").write_text(text)
    folders = [str(tmp_path / f) for f in ("x", "y")]
    batch = files.scan_raw_files(spark, *folders, max_bytes=10)
    assert sorted((n, c is not None) for n, c in rows(batch, "length", "content")) == [(5, True), (26, False)]
    stream = files.scan_raw_files(spark, *folders, stream=True)
    seen = jobs.drain(stream.select("path", "length"), spark, "two-folders")
    assert sorted(r[0] for r in rows(seen, "length")) == [5, 26]


def test_listing_starts_few_tasks(spark, tmp_path):
    """Hundreds of folders are listed by a few tasks a core, not by one each."""
    for i in range(300):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "f.txt").write_text(str(i))
    before = spark.conf.get(files.LISTING_TASKS_CONF)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        found = files.scan_raw_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) <= int(files.listing_tasks(spark)) < 300
    assert found.count() == 300 and spark.conf.get(files.LISTING_TASKS_CONF) == before


def test_written_raw_files(spark, tmp_path):
    """A file per user and document, in slices that one job lists; rows of one document share it, odd names are escaped."""
    texts = [("u", 1, "a\nb"), ("u", 1, "c"), ("u", 2, None), ("v/w=x", 1, "é"), (None, 3, "n"), ("", 3, "e")]
    views.write_raw_files(spark.createDataFrame(texts, "user_id string, document_id long, text string"), str(tmp_path / "raw"))
    written = {}
    for file in (tmp_path / "raw").rglob("*.txt"):
        top, user, document, _ = file.relative_to(tmp_path / "raw").parts
        assert top.startswith("slice=")
        assert (user, document) not in written
        written[user, document] = sorted(file.read_bytes().decode().splitlines())
    assert written == {
        ("user_id=u", "document_id=1"): ["a", "b", "c"], ("user_id=u", "document_id=2"): [""],
        ("user_id=v%2Fw%3Dx", "document_id=1"): ["é"], ("user_id=__HIVE_DEFAULT_PARTITION__", "document_id=3"): ["e", "n"],
    }
    views.write_raw_files(spark.range(300).selectExpr("'u' as user_id", "id as document_id", "'t' as text"), str(tmp_path / "many"))
    assert 32 < len(list((tmp_path / "many").iterdir())) <= views.RAW_SLICES
    assert files.scan_raw_files(spark, str(tmp_path / "many"), glob="*.txt").select("path").distinct().count() == 300


def test_mounted_folders_are_listed_by_tasks(spark, tmp_path):
    """The rows are those of Spark's own source, but the plan holds no list of files."""
    names = (
        "a.txt", "b c/d%2Fe.txt", "é#/[z]{1}.txt", "k=v/_k=1.txt", "deep/er/still/x.txt", "_hidden.txt", ".dot.txt",
        "_skipped/x.txt", "_metadata", "_metadata_kept/x.txt", "y._COPYING_", "n/a.csv", "n/UP.TXT",
    )
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty.txt").touch()
    (tmp_path / "large.txt").write_text("x" * 100)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "broken.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "linked").symlink_to(tmp_path / "n")
    for glob in ("*", "*.txt", "{a,x}.txt", "[!a]*.txt", "?.csv"):
        for folders in ([tmp_path], [tmp_path / "deep", tmp_path / "deep" / "er", tmp_path / "a.txt"], [tmp_path / "_skipped"]):
            found = files.scan_raw_files(spark, *map(str, folders), glob=glob, max_bytes=50)
            by_spark = files._scanned_by_spark(spark, tuple(map(str, folders)), glob, False, None, 50)
            assert found.inputFiles() == []
            assert sorted(rows(found, *by_spark.columns), key=str) == sorted(rows(by_spark), key=str)
    assert files.scan_raw_files(spark, f"{tmp_path}/dee[p]").count() == 1


def test_folders_are_dealt_before_they_are_walked():
    """More folders on a level than are looked for: every one is found once, those beyond are handed on as they come."""
    inside = {"/r": [(f"/r/{i}", True) for i in range(2500)]}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mounted, "_entries", lambda folder: iter(inside[folder]))
        patch.setattr(mounted.os.path, "isdir", lambda path: True)
        got = list(mounted._dealt(["/r"], ".*"))
    assert sorted(got) == sorted((path, None, True) for path, _ in inside["/r"])


@pytest.mark.parametrize("max_files", [None, 4])
def test_streams_of_mounted_folders_log_no_files(spark, tmp_path, max_files):
    """Each path once per checkpoint, at most max_files a micro-batch; the driver's logs of a stream name no file."""
    source, checkpoint = tmp_path / "in", tmp_path / "cp"
    source.mkdir()

    def run():
        batches = []
        stream = files.scan_raw_files(jobs.stream_session(spark, 2), str(source), glob="*.txt", stream=True, max_files=max_files)
        query = stream.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).foreachBatch(
            lambda batch, number: batches.append(sorted((n, bytes(c)) for n, c in rows(batch, "name", "content")))
        ).start()
        query.awaitTermination()
        assert max(map(len, batches)) <= (max_files or 11)
        return [row for batch in batches for row in batch]

    names = [f"file-{i:02d}.txt" for i in range(11)]
    for i, name in enumerate(names):
        (source / name).write_text(name)
        os.utime(source / name, (10**9 - 10**7 * i, 10**9 - 10**7 * i))
    got = run()
    assert sorted(got) == [(name, name.encode()) for name in names]
    if max_files:
        assert {name for name, _ in got[:3]} <= set(names[-max_files:])
    (source / names[0]).write_text("seen before")
    (source / "older.txt").write_text("late")
    os.utime(source / "older.txt", (10**6, 10**6))
    assert run() == [("older.txt", b"late")]
    assert run() == []
    for log in (p for p in checkpoint.rglob("*") if p.is_file() and p.relative_to(checkpoint).parts[0] in ("sources", "offsets")):
        assert b"file-" not in log.read_bytes()


def test_runs_without_arrivals_ingest_nothing(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "u").mkdir(parents=True)
    (source / "u" / "a.txt").write_text("one")
    for _ in range(3):
        stream = files.scan_raw_files(jobs.stream_session(spark, 2), str(source), stream=True).withColumn("user_id", F.lit("u"))
        jobs.incremental_ingest(stream, str(target), str(tmp_path / "cp")).awaitTermination()
    assert [p.name for p in (target / "documents").iterdir() if p.is_dir()] == ["batch=0"]
