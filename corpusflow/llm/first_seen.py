"""Which keys of a document were seen in a document with a smaller id.

Keys are 64-bit hashes of windows, billions of them; as rows they would cost several times
their size. Each slice of texts keeps one key per distinct value (that of its smallest
document), packs the keys of one hash range into a binary, and sends it to the range's
task. A value in a third of all documents so reaches its task once per slice, not once per
document. The answer names, per document, the keys that have a smaller owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.batches import bounded_batches, mixed, release_memory, slices, text_of
from corpusflow.llm.staging import parts_for, staged, text_bytes

#: Text bytes whose keys share one task.
RANGE_BYTES = 12 << 20

#: Stretches in which the keys of a range are sorted, by their lowest bits.
STRETCHES = 8

_SENT = "part bigint, local boolean, ids binary, owner binary, keys binary"
_SENT_ARROW = pa.schema([
    ("part", pa.int64()), ("local", pa.bool_()), ("ids", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary()),
])
#: Findings about one block of owners: rows of 64-bit numbers, the owner first.
PACKED = "block bigint, rows binary"
_PACKED_ARROW = pa.schema([("block", pa.int64()), ("rows", pa.binary())])
_FOUND = "doc_id bigint, seen_keys binary"


def pack_by_block(rows: np.ndarray, blocks: int) -> pa.Table:
    """One message per block of owners (first column), so that messages don't multiply with ranges and owners."""
    block = (mixed(rows[:, 0].astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    rows, block = rows[order], block[order]
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    return pa.table([
        pa.array(block[heads], pa.int64()),
        pa.array([r.tobytes() for r in np.split(rows, heads[1:])] if len(heads) else [], pa.binary()),
    ], schema=_PACKED_ARROW)


def unpacked(group: pa.Table, columns: int, owner_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of all messages of a block, sorted, and where each owner's rows begin (with the end)."""
    rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.int64).reshape(-1, columns)
    if not len(rows):
        return rows, np.zeros(1, np.int64)
    rows = rows[np.lexsort(rows.T[::-1])]
    changed = rows[1:] != rows[:-1]
    rows = rows[np.append(True, changed.any(axis=1))]
    owner = np.append(True, (rows[1:, :owner_columns] != rows[:-1, :owner_columns]).any(axis=1))
    return rows, np.append(np.flatnonzero(owner), len(rows))


def _split_seen(ids: np.ndarray, keys: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, id), and which entries to report.

    Those of a larger id than their key's smallest; with `both` all of keys that two ids own.
    """
    order = np.lexsort((ids, keys))
    own_keys, own_ids = keys[order], ids[order]
    head = np.append(True, own_keys[1:] != own_keys[:-1])
    group = np.cumsum(head) - 1
    if both:
        last = own_ids[np.append(np.flatnonzero(head)[1:] - 1, len(own_ids) - 1)]
        return order, (last > own_ids[head])[group]
    return order, own_ids > own_ids[head][group]


def _packed_keys(part: int, local: bool, owners: np.ndarray, keys: np.ndarray) -> tuple:
    table, at = np.unique(owners, return_inverse=True)
    kind = np.uint16 if len(table) <= 0xFFFF else np.uint32
    return part, local, table.tobytes(), at.astype(kind).tobytes(), keys.tobytes()


def _sender(keys_of: Callable, parts: int, both: bool) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                owner_ids = batch.column("doc_id")
                known = np.array(owner_ids.is_valid().to_numpy(zero_copy_only=False), bool)
                ids = np.array(owner_ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)[known]
                texts = [t for t, k in zip(text_of(batch, "text"), known, strict=True) if k]
                keys, counts = keys_of(texts)
                if not len(keys):
                    continue
                owners = np.repeat(ids, counts)
                order, report = _split_seen(owners, keys, both)
                keys, owners = keys[order], owners[order]
                rows = []
                if report.any():
                    rows.append(_packed_keys(int(ids[0]) % parts, True, owners[report], keys[report]))
                head = np.append(True, keys[1:] != keys[:-1])
                keys, owners = keys[head], owners[head]
                # Ranges of the hash follow its order, so each range is one stretch.
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for start, stop in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                    rows.append(_packed_keys(int(part[start]), False, owners[start:stop], keys[start:stop]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)],
                    schema=_SENT_ARROW,
                )
            release_memory()

    return send


def _values(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """All values of a column of packed numbers, one row behind the other; not copied where it is one chunk."""
    pieces = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        if ends[-1] > ends[0]:
            pieces.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind))
    return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.empty(0, kind)


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, keys) of all entries of some messages. Only the ids are made; the keys stay where they arrived."""
    keys = _values(rows.column("keys"), np.uint64)
    ids, at = np.empty(len(keys), np.int64), 0
    for batch in rows.select(["ids", "owner", "keys"]).to_batches():
        for table, owner, own in zip(*(batch.column(i) for i in range(3)), strict=True):
            n = len(own.as_buffer()) // 8
            places = np.frombuffer(owner.as_buffer(), np.uint16 if len(owner.as_buffer()) == 2 * n else np.uint32)
            ids[at:at + n] = np.frombuffer(table.as_buffer(), np.int64)[places]
            at += n
    return ids, keys


def _answerer(both: bool, blocks: int) -> Callable:
    def answer(group: pa.Table) -> pa.Table:
        """Of one hash range: passed-on findings, and the entries to report."""
        local = group.column("local")
        ids, keys = _entries(group.filter(local))
        found = [np.stack([ids, keys.view(np.int64)], axis=1)]
        ids, keys = _entries(group.filter(pc.invert(local)))
        # Sorted stretch by stretch of the hash: the copies that sorting needs are those of a stretch.
        stretch = keys.view(np.uint8)[::8] % STRETCHES
        for number in range(STRETCHES):
            at = np.flatnonzero(stretch == number)
            if not len(at):
                continue
            part_ids, part_keys = ids[at], keys[at]
            order, report = _split_seen(part_ids, part_keys, both)
            order = order[report]
            found.append(np.stack([part_ids[order], part_keys[order].view(np.int64)], axis=1))
        del ids, keys, stretch
        packed = pack_by_block(np.concatenate(found), blocks)
        release_memory()
        return packed

    return answer


def _per_document(group: pa.Table) -> pa.Table:
    rows, cuts = unpacked(group, 2, 1)
    made = pa.table({
        "doc_id": pa.array(rows[cuts[:-1], 0], pa.int64()),
        "seen_keys": pa.array([rows[a:b, 1].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    })
    del rows
    release_memory()
    return made


def seen_before(
    docs: DataFrame, keys_of: Callable, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES,
    both: bool = False,
) -> DataFrame:
    """(doc_id, seen_keys): per document its keys (packed 64-bit) that a document with a smaller id has too.

    With `both`, the keys that any other document has too. keys_of takes a list of texts (bytes)
    and gives their keys, one behind the other, and the number of keys of each text. Rows
    without id own no keys; rows with equal ids are one document. One row per document that
    has such keys, as a written table.
    """
    bounded_batches(docs.sparkSession)
    parts = parts_for(text_bytes(docs, text_col)[1], range_bytes)
    sent = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _sender(keys_of, parts, both), _SENT,
    )
    # As many tasks as ranges and as blocks, however few partitions the session shuffles into.
    answered = sent.repartition(parts, "part").groupBy("part").applyInArrow(_answerer(both, parts), PACKED)
    return staged(answered.repartition(parts, "block").groupBy("block").applyInArrow(_per_document, _FOUND), "seen-keys")


def with_seen(docs: DataFrame, seen: DataFrame, id_col: str, seen_col: str) -> DataFrame:
    """`docs` and their seen keys; rows without id stay apart so that they don't meet in one task."""
    named = seen.select(F.col("doc_id").alias("_seen_id"), F.col("seen_keys").alias(seen_col))
    known = docs.where(F.col(id_col).isNotNull())
    joined = known.join(named, known[id_col] == named["_seen_id"], "left").drop("_seen_id")
    unknown = docs.where(F.col(id_col).isNull()).withColumn(seen_col, F.lit(None).cast("binary"))
    return joined.unionByName(unknown)


def runs_of(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true values, as a two-column array."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
