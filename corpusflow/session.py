"""Session construction and shared-folder staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "corpusflow", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here is written against."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of an Arrow batch at most where rows are whole files or texts: a worker holds a batch in several forms at once.
FILE_BATCH_ROWS = 500
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for whole files."""
    rows = int(spark.conf.get(BATCH_CONF, "10000"))
    if rows <= 0 or rows > FILE_BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(FILE_BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read; only a local master may fall back to a temporary one."""
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="corpusflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame, label: str, *partitions: str) -> DataFrame:
    """Write a stage once to the shared folder and read it back.

    Used where several outputs branch off one expensive Python stage: the table
    survives executor loss and the stage is not evaluated once per branch. ``partitions`` are columns
    that get a folder per value.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusflow/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
