"""Random-indexing word vectors: fixed sparse index vectors, summed over neighbours in the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.batches import Memo, bounded_batches, slices, space_words, text_of
from corpusflow.llm.staging import staged

#: Hashed vocabulary: letters of a word, and its shape (case, digits, marks) with a repeat flag.
BODIES, SHAPES = 1 << 14, 1 << 10
ROWS = BODIES + 2 * SHAPES
DIMENSIONS = 32
#: Places of an index vector that are not zero.
NONZERO = 4
#: Neighbours to each side.
REACH = 2
#: Vector rows in one message of partial sums.
BLOCK = 256
#: Partial sums that meet in one task.
FAN_IN = 64
#: Entries of each generation of the memo of words.
MEMO_ROWS = 200_000
#: Text bytes whose token vectors are held at once.
POOL_BYTES = 1 << 18

_LETTERS = re.compile(r"[^\W_]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every row's index vector, from a fixed seed."""
    rng = np.random.default_rng(20_240_117)
    places = np.argsort(rng.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (ROWS, NONZERO))


def _rows(word: bytes) -> int:
    """Rows of a word's body and its shape, packed into one number."""
    text = word.decode()
    letters = "".join(_LETTERS.findall(text))
    marks = "".join(sorted(set(_LETTERS.sub("", text))))
    case = (letters.islower(), letters.isupper(), letters.istitle(), any(map(str.isdigit, letters)), bool(letters))
    body = xxhash.xxh3_64_intdigest(letters.lower()) % BODIES
    shape = xxhash.xxh3_64_intdigest(f"{case} {marks}") % SHAPES
    return body << 32 | (BODIES + 2 * shape)


_ROWS = Memo(_rows, MEMO_ROWS)


def token_rows(words: list[bytes]) -> np.ndarray:
    """Body and shape rows of each word in turn; the shape's row differs where a word repeats the one before."""
    packed = np.fromiter(map(_ROWS.__getitem__, words), np.int64, len(words))
    out = np.empty(2 * len(words), np.int64)
    out[0::2], out[1::2] = packed >> 32, packed & 0xFFFFFFFF
    out[3::2] += packed[1:] == packed[:-1]
    return out


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, used = np.zeros(ROWS * DIMENSIONS), False
    for whole in batches:
        for batch in slices(whole, "text", 1 << 20):
            rows, text = [], []
            for i, t in enumerate(text_of(batch, "text")):
                own = token_rows(space_words(t))
                rows.append(own)
                text.append(np.full(len(own), i))
            row, owner = np.concatenate(rows), np.concatenate(text)
            for step in range(1, REACH + 1):
                near = owner[step:] == owner[:-step]
                left, right = row[:-step][near], row[step:][near]
                used = used or bool(len(left))
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMENSIONS + places[b, k], weights=signs[b, k], minlength=len(total))
    if used:
        parts = total.astype(np.float64).reshape(-1, BLOCK * DIMENSIONS)
        key = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(len(parts)), pa.int64()), pa.array(np.full(len(parts), key), pa.int64()),
            pa.array([p.tobytes() for p in parts], pa.binary()),
        ], names=["block", "source", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the messages of each block as they stream by; a task holds one sum per block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(data, np.float64)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        key = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int64()), pa.array([key] * len(sums), pa.int64()),
            pa.array([s.tobytes() for s in sums.values()], pa.binary()),
        ], names=["block", "source", "sums"])


_MESSAGE = "block bigint, source bigint, sums binary"


def train_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit-length vectors (ROWS x DIMENSIONS) summed over all texts of `docs`.

    Each task sends its partial sums once, in blocks; blocks are added up in a tree whose
    nodes take about FAN_IN messages each, so no task grows with the corpus. The result has a
    fixed size, whatever the vocabulary.
    """
    bounded_batches(docs.sparkSession)
    sums = staged(docs.select(F.col(text_col).alias("text")).mapInArrow(_accumulate, _MESSAGE), "vector-sums")
    blocks = ROWS // BLOCK
    left = sums.count() // blocks
    while left > 1:
        left = -(-left // FAN_IN)
        sums = staged(
            sums.repartition(left * 8, F.pmod(F.col("block"), F.lit(8)), F.pmod(F.xxhash64("source"), F.lit(left)))
            .mapInArrow(_add, _MESSAGE), "vector-sums",
        )
        if left == 1:
            break
    total = np.zeros((ROWS // BLOCK, BLOCK * DIMENSIONS))
    for row in sums.select("block", "sums").toArrow().to_pylist():
        total[row["block"]] += np.frombuffer(row["sums"], np.float64)
    vectors = total.reshape(ROWS, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


def pooled(vectors: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch with the mean vectors of bodies and of shapes of each text (zero without words)."""
    for piece in slices(batch, "text", POOL_BYTES):
        out = np.zeros((piece.num_rows, 2 * DIMENSIONS), np.float32)
        for i, text in enumerate(text_of(piece, "text")):
            rows = token_rows(space_words(text))
            for at in range(0, len(rows), 1 << 18):
                part = rows[at:at + (1 << 18)]
                out[i, :DIMENSIONS] += vectors[part[0::2]].sum(axis=0)
                out[i, DIMENSIONS:] += vectors[part[1::2]].sum(axis=0)
            out[i] /= max(1, len(rows) // 2)
        yield piece, out
