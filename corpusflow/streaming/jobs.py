"""Streaming forms of the event operators and incremental ingestion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators import embedding, folds
from corpusflow.plans import ingest
from corpusflow.session import shared_dir, staged
from corpusflow.sources.files import LISTING_TASKS_CONF, listing_tasks
from corpusflow.streaming import processors

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session on the same context whose streams keep their state in RocksDB.

    The number of state partitions is fixed for the life of a stream's checkpoint, so it is set
    here once instead of being taken from whatever batch jobs use.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # A stream of many files lists them in every micro-batch.
    session.conf.set(LISTING_TASKS_CONF, listing_tasks(spark))
    if partitions:
        session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


#: How far events may lag behind the newest one, in seconds; later ones are dropped.
LATE_SECONDS = 600
#: Life time of an unfinished answer and of an unfinished document without events, in seconds.
ANSWER_LIFE_SECONDS = 3600
DOCUMENT_LIFE_SECONDS = 86_400


def _timed(events: DataFrame, late_seconds: int) -> DataFrame:
    """Events with a watermark on ``at`` (microseconds), or on the time they are read where they have none."""
    at = F.timestamp_micros("at") if "at" in events.columns else F.current_timestamp()
    timed = events.withColumn("event_time", at).withWatermark("event_time", f"{late_seconds} seconds")
    return timed.withColumn("event_ms", F.unix_millis("event_time"))


def rate_limit_stream(requests: DataFrame, points: int, window_seconds: int, late_seconds: int = LATE_SECONDS) -> DataFrame:
    """Decision per request. ``requests``: key, request_id, at (microseconds)."""
    return _timed(requests, late_seconds).groupBy("key").transformWithStateInPandas(
        processors.FixedWindow(points, window_seconds),
        "request_id bigint, used bigint, allowed boolean, remaining bigint, reset_seconds bigint",
        "append", "EventTime",
    )


def ttl_memo_stream(events: DataFrame, ttl_seconds: int, state_ttl_ms: int | None = None) -> DataFrame:
    """Hit or miss per request. ``events``: owner, key, request_id, at, storable, clears."""
    return events.groupBy("owner").transformWithStateInPandas(
        processors.MemoCache(ttl_seconds, state_ttl_ms), "request_id bigint, hit boolean", "append",
        "ProcessingTime" if state_ttl_ms else "None",
    )


def progress_throttle_stream(events: DataFrame, interval_ms: int, late_seconds: int = LATE_SECONDS) -> DataFrame:
    """Written flag per event. ``events``: document_id, request_id, at, stage_change."""
    return _timed(events, late_seconds).groupBy("document_id").transformWithStateInPandas(
        processors.Throttle(interval_ms), "request_id bigint, written boolean", "append", "EventTime"
    )


def ingest_progress_stream(events: DataFrame) -> DataFrame:
    """Current state per document, updated as events arrive: the batch fold as a streaming aggregate."""
    return folds.document_state(events)


def document_progress_stream(
    events: DataFrame, late_seconds: int = LATE_SECONDS, life_seconds: int = DOCUMENT_LIFE_SECONDS
) -> DataFrame:
    """Current state per document, updated as events arrive; documents that have ended leave the state.

    ``events``: those of ``folds.document_state`` and at (microseconds).
    """
    folded = _timed(events, late_seconds).withColumn("document_id", F.col("document_id").cast("string")).groupBy("document_id")
    return folds.judged_state(folded.transformWithStateInPandas(
        processors.DocumentFold(late_seconds * 1000, life_seconds * 1000), processors.FOLDED, "update", "EventTime"
    ))


def token_stream_assembly(
    events: DataFrame, late_seconds: int = LATE_SECONDS, life_seconds: int = ANSWER_LIFE_SECONDS
) -> DataFrame:
    """Finished answers. ``events``: message_id, seq, type, text, finish_reason, code, aborted and optionally at."""
    return _timed(events, late_seconds).groupBy("message_id").transformWithStateInPandas(
        processors.AnswerAssembly(late_seconds * 1000, life_seconds * 1000),
        "message_id bigint, content string, critique string, tokens bigint, finish_reason string, error_code string",
        "append", "EventTime",
    )


#: Rows of one micro-batch of a replay for each state partition, and the least number of micro-batches. The number of
#: calls is that of keys times micro-batches, so micro-batches grow with the partitions that share them.
REPLAY_ROWS = 1_000_000
REPLAY_BATCHES = 4


def replay(rows: DataFrame, time: str, label: str, session: SparkSession | None = None) -> DataFrame:
    """Stored rows as a stream in the order of ``time``: files of bounded size, one a micro-batch.

    The rows are dealt to slices of time once; the slices are then written one after the other,
    because a file source reads files in the order of their writing. Rows of one time share a file.
    """
    spark = rows.sparkSession
    session = session or stream_session(spark, spark.sparkContext.defaultParallelism)
    total = rows.count()
    batches = max(REPLAY_BATCHES, -(-total // (REPLAY_ROWS * int(session.conf.get("spark.sql.shuffle.partitions")))))
    found = rows.agg(F.percentile_approx(time, [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    cuts = sorted(set(found))
    number = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col(time))) if cuts else F.lit(0)
    sliced = staged(rows.withColumn("_slice", number).repartition("_slice"), f"{label}-slices", "_slice")
    path = f"{shared_dir(spark)}/corpusflow/{label}-{uuid.uuid4().hex}"
    for i in range(len(cuts) + 1):
        sliced.filter(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(path)
    return session.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(
    stream: DataFrame, spark: SparkSession, label: str, mode: str = "append", key: str | None = None,
    progress: list | None = None,
) -> DataFrame:
    """Run a stream over what is available now and return its sink table.

    ``progress`` receives the progress report of every micro-batch.

    In update mode each micro-batch is written with its number and the latest row per ``key`` wins.
    A micro-batch that is run again replaces its own folder.
    """
    base = f"{shared_dir(spark)}/corpusflow/{label}-{uuid.uuid4().hex}"
    sink, checkpoint = f"{base}/table", f"{base}/checkpoint"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    table = spark.read.schema(stream.schema.add("batch", "long")).parquet(sink)
    if mode == "append":
        return table.drop("batch")
    return folds.latest_per_key(table, [key], "batch").drop("batch")


def incremental_ingest(
    files: DataFrame,
    target: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame] = embedding.hashing_embeddings,
    user_of: Callable | None = None,
):
    """Ingest newly arrived files once.

    ``files`` is a streaming scan of raw files with a user_id column (or ``user_of`` derives it from
    the path). Document ids come from owner and content, so copies that arrive later are recognised;
    a micro-batch that is run again replaces its own folders.
    """
    named = files if user_of is None else files.withColumn("user_id", user_of(F.col("path")))
    if "mime_type" not in named.columns:
        named = named.withColumn("mime_type", F.lit("application/octet-stream"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The files are read once; every step of ingestion reads the written bytes.
        arrived = staged(batch, "arrived-files")
        if arrived.isEmpty() and not _exists(spark, f"{target}/chunks/batch={number}"):
            return
        known = current_documents(spark, target).filter(F.col("batch") != number)
        out = ingest.ingest_documents(arrived, known, embed)
        out["chunks"].write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        out["documents"].write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        out["replaced"].write.mode("overwrite").parquet(f"{target}/replaced/batch={number}")

    return (
        named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


DOCUMENT_COLUMNS = (
    "document_id string, user_id string, name string, original_filename string, mime_type string, file_size bigint, "
    "storage_key string, content_hash string, status string, error_code string, chunk_count int, "
    "embedding_model string, extraction_info string, batch bigint"
)


def current_documents(spark: SparkSession, target: str) -> DataFrame:
    """One row per ingested document: the latest, as a later batch may have replaced a failed one."""
    return folds.latest_per_key(existing_documents(spark, target), ["document_id"], "batch")


def existing_documents(spark: SparkSession, target: str) -> DataFrame:
    """Document rows of all batches; empty before the first."""
    if not _exists(spark, f"{target}/documents"):
        return spark.createDataFrame([], DOCUMENT_COLUMNS)
    return spark.read.schema(DOCUMENT_COLUMNS).parquet(f"{target}/documents")


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
