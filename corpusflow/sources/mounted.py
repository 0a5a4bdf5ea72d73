"""Files of mounted folders, listed and read by the tasks: the driver holds no row per file.

Which files there are, and their columns, are those of Spark's own binary file source.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import FILE_BATCH_ROWS

#: Folders that one task looks for before they are dealt to all; then each is walked to its end by the task that got it.
DEALT_FOLDERS = 1000
#: Bytes of files in an Arrow batch, after which it is handed on.
BATCH_BYTES = 16 << 20
#: Characters by which Spark takes a path for a pattern.
WILDCARDS = frozenset("{}[]*?\\")


def mounted_root(spark: SparkSession, folder: str) -> str | None:
    """Where tasks find the folder (or file); None if only Hadoop's file systems can list and read it."""
    if WILDCARDS & set(folder):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getScheme() != "file" or not system.exists(place):
        return None
    return system.makeQualified(place).toUri().getPath()


def name_pattern(spark: SparkSession, glob: str) -> str:
    """Hadoop's glob as a regular expression for whole names."""
    return spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()


def listed_files(start: DataFrame, roots: list[str], pattern: str, tasks: int) -> DataFrame:
    """Files below the roots (path, modified in milliseconds), listed once for each row of ``start``."""
    found = start.mapInArrow(partial(_found, roots, pattern), f"{LISTED}, folder boolean")
    return found.repartition(tasks, "path").mapInArrow(partial(_walked, pattern), LISTED)


def read_files(spark: SparkSession, listed: DataFrame, max_bytes: int) -> DataFrame:
    """Rows as of Spark's binary file source; above ``max_bytes`` the bytes are null and not read."""
    missing_ok = spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"
    return listed.select("path").mapInArrow(partial(_read, max_bytes, missing_ok), READ).select(
        "path", F.timestamp_millis("modified").alias("modificationTime"), "length", "content"
    )


LISTED = "path string, modified bigint"
READ = "path string, modified bigint, length bigint, content binary"
_READ = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
_LISTED = pa.schema([("path", pa.string()), ("modified", pa.int64())])
_FOUND = _LISTED.append(pa.field("folder", pa.bool_()))
#: Rows of a batch of paths.
PATHS = 5000


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == PATHS:
            yield _batch(held, schema)
            held = []
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark leaves out; of those with statistics (_metadata) only the files."""
    if name.startswith("_") and "=" not in name:
        return not (folder and name.startswith(("_metadata", "_common_metadata")))
    return name.startswith(".") or name.endswith("._COPYING_")


def _entry(path: str, pattern: str) -> Iterator[tuple]:
    """The row of a file, if its name is wanted; entries that lead nowhere and empty files have none, as in Spark."""
    if re.fullmatch(pattern, os.path.basename(path), re.DOTALL):
        try:
            status = os.stat(path)
        except FileNotFoundError:
            return
        if status.st_size:
            yield f"file:{path}", status.st_mtime_ns // 1_000_000


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """Entries of a folder (path, whether a folder) that Spark would list."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                entry.name.encode()
            except UnicodeEncodeError:  # no text: Hadoop does not find such an entry either
                continue
            inside = entry.is_dir()
            if not _hidden(entry.name, inside):
                yield entry.path, inside


def _found(roots: list[str], pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _ in range(batch.num_rows):
            yield from _batches(_dealt(roots, pattern), _FOUND)


def _dealt(roots: list[str], pattern: str) -> Iterator[tuple]:
    """Level by level, the files met and, once there are enough, the folders still to be walked."""
    level = [root for root in roots if os.path.isdir(root)]
    for root in roots:
        if not os.path.isdir(root) and not _hidden(os.path.basename(root), False):
            yield from ((*file, False) for file in _entry(root, pattern))
    while level and len(level) < DEALT_FOLDERS:
        below = []
        for folder in level:
            for path, inside in _entries(folder):
                if not inside:
                    yield from ((*file, False) for file in _entry(path, pattern))
                elif len(below) < DEALT_FOLDERS:
                    below.append(path)
                else:
                    yield path, None, True
        level = below
    for folder in level:
        yield folder, None, True


def _walked(pattern: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for path, modified, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if folder:
                    yield from _below(path, pattern)
                else:
                    yield path, modified

    return _batches(rows(), _LISTED)


def _below(folder: str, pattern: str) -> Iterator[tuple]:
    """Files of a folder and all folders in it; one open folder per level is all that is held."""
    levels = [_entries(folder)]
    while levels:
        path, inside = next(levels[-1], (None, False))
        if path is None:
            levels.pop()
        elif inside:
            levels.append(_entries(path))
        else:
            yield from _entry(path, pattern)


def _read(max_bytes: int, missing_ok: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for name in batch.column(0).to_pylist():
            path, content = name.removeprefix("file:"), None
            try:
                status = os.stat(path)
                if status.st_size <= max_bytes:
                    with open(path, "rb") as file:
                        content = file.read()
            except FileNotFoundError:
                if missing_ok:
                    continue
                raise
            held.append((name, status.st_mtime_ns // 1_000_000, status.st_size, content))
            size += len(content or b"")
            if size >= BATCH_BYTES or len(held) == FILE_BATCH_ROWS:
                yield _batch(held, _READ)
                held, size = [], 0
    yield _batch(held, _READ)
