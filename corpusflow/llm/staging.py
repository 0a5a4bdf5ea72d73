"""Tables written to the shared folder, and the sizing that partitions and buckets are derived from."""

from __future__ import annotations

import contextlib
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import shared_dir

#: Spark drops the shuffle files of a finished query at once while this is on.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffle_cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to spark.checkpoint.dir and read it back.

    The table cuts the lineage, survives lost executors, and its size is known to
    the planner. Shuffle files of the written plan are dropped when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusflow-llm/{label}-{uuid.uuid4().hex}"
    with _shuffle_cleanup(spark):
        df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of the texts: two numbers, from one aggregation."""
    found = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    return int(found[0]), int(found[1])


def parts_for(total: int, each: int) -> int:
    """How many parts of about `each` make up `total`; grows with the input, without a ceiling."""
    return max(1, math.ceil(total / each))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name
