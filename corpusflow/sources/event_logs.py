"""Newline-delimited JSON logs and server-sent event text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, stream: bool = False, line_sep: str | None = None) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path)


def parse_event_log(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Events of JSON lines; malformed lines and a cut-off last line are dropped.

    Validity is judged on the JSON alone: a field of the wrong type becomes null, its event stays.
    """
    text = F.trim(F.col(column))
    kept = lines.filter(F.try_parse_json(text).isNotNull())
    rest = [c for c in lines.columns if c != column]
    return kept.select(*rest, F.from_json(text, schema).alias("_e")).select(*rest, "_e.*")


def parse_sse_frames(frames: DataFrame, column: str = "value") -> DataFrame:
    """``event`` and JSON ``data`` of server-sent frames (one frame per row).

    Comment lines are ignored, several data lines are joined, frames without valid JSON dropped.
    """
    lines = F.filter(F.split(F.col(column), "\n", -1), lambda x: ~F.startswith(x, F.lit(":")))
    named = F.filter(lines, lambda x: F.startswith(x, F.lit("event:")))
    data = F.filter(lines, lambda x: F.startswith(x, F.lit("data:")))
    event = F.coalesce(F.trim(F.substr(F.try_element_at(named, F.lit(-1)), F.lit(7))), F.lit("message"))
    body = F.array_join(F.transform(data, lambda x: F.trim(F.substr(x, F.lit(6)))), "\n")
    rest = [c for c in frames.columns if c != column]
    return (
        frames.filter(F.size(data) > 0).select(*rest, event.alias("event"), body.alias("data"))
        .filter(F.try_parse_json("data").isNotNull())
    )


def read_sse(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_sse_frames(read_lines(spark, path, stream, "\n\n"))
