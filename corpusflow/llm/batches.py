"""Arrow batches of texts, cut into pieces of bounded size, and the words in them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

#: Bytes of text that one numpy step holds at a time.
SLICE_BYTES = 2 << 20
#: Entries of each of the two generations of a per-worker memo.
MEMO_ENTRIES = 60_000
#: Rows of an Arrow batch at most: a batch of whole texts is held on both sides at once.
BATCH_ROWS = 2000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SEPARATORS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else (c + 32 if 0x41 <= c <= 0x5A else 0x20)
    for c in range(256)
)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about `most` bytes of text, one row at least."""
    sizes = np.array(batch.column(column).cast(pa.binary()).fill_null(b"").to_numpy(zero_copy_only=False))
    lengths = np.fromiter(map(len, sizes), np.int64, len(sizes)) + 1
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give freed memory back to the system: reused workers would keep the most that any task has needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+`."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`."""
    return text.translate(_SEPARATORS).split()


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small enough for whole texts."""
    rows = int(spark.conf.get(BATCH_CONF, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


class Memo(dict):
    """Remembered results of `make`, in two generations: what the older one held and nobody asked for again goes."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multiplier of the window hash (fixed value).
_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k words (given as hashes)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out *= _STEP
            out ^= out >> np.uint64(29)
            out += words[j:j + n]
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
