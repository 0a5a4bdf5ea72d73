"""Byte-level repeats over 50 bytes with a run-length index.

A window of 50 bytes is keyed by the smallest hash of the 32-byte strings in it; equal
windows have equal keys, and neighbours mostly share one. A stretch is a run of windows with
one key. First only names (hashes) of stretches meet by key: a stretch that a smaller document
has as well is settled by that. Where a key has several different stretches, the bytes of each
travel once, from its first owner, to the key's range. There a run-compressed Burrows-Wheeler
index of them is built and every stretch is streamed against it: a window that still matches
elsewhere after 50 bytes is named by the place that the sampled run ends give, and the smallest
owner at that place keeps it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.batches import bounded_batches, mixed, release_memory, slices, text_of
from corpusflow.llm.first_seen import PACKED, pack_by_block, unpacked
from corpusflow.llm.run_index import SEPARATOR, RunIndex
from corpusflow.llm.staging import free_name, parts_for, staged, text_bytes

WIDTH = 50
CORE = 32
#: Bytes that are hashed in one numpy step.
STEP_BYTES = 1 << 18
#: Text bytes whose stretches share one task.
RANGE_BYTES = 8 << 20
#: Bytes of stretches in one index, so that it fits a core's cache; a key is never cut.
INDEX_BYTES = 1 << 17
#: Different stretches of one key that one index takes; the windows of hotter keys are spread by their own hashes.
HOT_KINDS = 2048
#: Low bits of a stretch's name, free for what is to be done about it.
_NEEDED, _HOT = 1, 2
_MARKS = np.uint64(3)
_UPPER = np.uint64(0xFFFFFFFF << 32)

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _core_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all CORE-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        out, step = _BYTES[data], np.uint64(0x9E3779B97F4A7C15)
        width = 1
        while width < CORE:
            out = out[:-width] * step + out[width:]
            step = step * step
            width *= 2
    return mixed(out)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


_STEP = 0x9E3779B97F4A7C15
_UNSTEP = pow(_STEP, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(count, base, np.uint64))


class Stretches:
    """Runs of windows with one key, of all given texts, one text behind the other.

    keys, names (a hash of the stretch's bytes and its key, low bits 0), starts and ends in bytes of the
    text, and counts: how many each text has. Texts shorter than a window have none.
    """

    def __init__(self, texts: list[bytes], width: int = WIDTH):
        found: list[tuple] = []
        self.counts = np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (held == 0 or held + len(texts[stop]) <= STEP_BYTES):
                held += len(texts[stop])
                stop += 1
            if held >= width:
                found.append(self._of_some(texts[at:stop], width, self.counts[at:stop]))
            at = stop
        self.keys, self.names = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.uint64) for i in (0, 1))
        self.starts, self.ends = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (2, 3))

    @staticmethod
    def _of_some(texts: list[bytes], width: int, counts: np.ndarray) -> tuple:
        cores = _core_hashes(np.frombuffer(b"".join(texts), np.uint8))
        # Minima are small numbers; mixed again they spread evenly over the key ranges.
        keys = mixed(_sliding_min(cores, width - CORE + 1))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        stop = begin + np.maximum(0, sizes - width + 1)
        # A stretch begins where the key changes and where a text does; behind a text's last window is none.
        border = np.append(True, keys[1:] != keys[:-1])
        border[begin[begin < len(keys)]] = True
        border[stop[stop < len(keys)]] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(keys))
        text = np.searchsorted(begin, starts, side="right") - 1
        inside = starts < stop[text]
        starts, ends, text = starts[inside], ends[inside], text[inside]
        counts[:] = np.bincount(text, minlength=len(texts))
        with np.errstate(over="ignore"):
            sums = np.append(np.uint64(0), np.cumsum(cores * _powers(_STEP, len(cores))))
            back = _powers(_UNSTEP, len(cores))
            names = mixed((sums[ends + (width - CORE)] - sums[starts]) * back[starts] + keys[starts]) & ~_MARKS
        return keys[starts], names, starts - begin[text], ends - begin[text] + (width - 1)

    def bounds(self) -> np.ndarray:
        """Where each text's stretches begin, with the end."""
        return np.append(0, np.cumsum(self.counts))


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash follow its order, so each range is one stretch of sorted keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


_NAMED = "part bigint, local boolean, ids binary, owner binary, keys binary, names binary"
_NAMED_ARROW = pa.schema([
    ("part", pa.int64()), ("local", pa.bool_()), ("ids", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary()), ("names", pa.binary()),
])


def _named(part: int, local: bool, owners: np.ndarray, keys: np.ndarray, names: np.ndarray) -> tuple:
    table, at = np.unique(owners, return_inverse=True)
    kind = np.uint16 if len(table) <= 0xFFFF else np.uint32
    # Inside a range the low half of a key is enough: what meets by accident differs by name.
    return part, local, table.tobytes(), at.astype(kind).tobytes(), keys.astype(np.uint32).tobytes(), names.tobytes()


def _name_sender(parts: int, width: int):
    """Names of all stretches; of equal ones in a slice only the smallest owner's meets the others, the rest is settled."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = np.array(batch.column("doc_id").to_numpy(zero_copy_only=False), np.int64)
                found = Stretches(text_of(batch, "text"), width)
                if not len(found.keys):
                    continue
                owners = np.repeat(ids, found.counts)
                # By the upper halves: should different names interleave, each piece of a group sends its owner.
                order = np.argsort((found.keys & _UPPER) | (found.names >> np.uint64(32)))
                keys, names, owners = found.keys[order], found.names[order], owners[order]
                head = np.append(True, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
                smallest = np.minimum.reduceat(owners, np.flatnonzero(head))
                settled = owners > smallest[np.cumsum(head) - 1]
                rows = []
                if settled.any():
                    rows.append(_named(int(ids[0]) % parts, True, owners[settled], np.empty(0, np.uint64), names[settled]))
                keys, names, owners = keys[head], names[head], smallest
                part = _part_of(keys, parts)
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                    rows.append(_named(int(part[a]), False, owners[a:b], keys[a:b], names[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NAMED_ARROW, strict=True)], schema=_NAMED_ARROW,
                )
            release_memory()

    return send


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, keys, names) of all entries of some messages."""
    ids, keys, names = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.uint64)]
    for batch in rows.to_batches():
        for table, owner, key, name in zip(*(batch.column(c) for c in ("ids", "owner", "keys", "names")), strict=True):
            n = len(name.as_buffer()) // 8
            places = np.frombuffer(owner.as_buffer(), np.uint16 if len(owner.as_buffer()) == 2 * n else np.uint32)
            ids.append(np.frombuffer(table.as_buffer(), np.int64)[places])
            keys.append(np.frombuffer(key.as_buffer(), np.uint32))
            names.append(np.frombuffer(name.as_buffer(), np.uint64))
    return np.concatenate(ids), np.concatenate(keys), np.concatenate(names)


def _name_answerer(blocks: int, hot_kinds: int):
    def answer(group: pa.Table) -> pa.Table:
        """Of one key range: names with a smaller owner, and, marked, first owners' names whose windows must be compared."""
        local = group.column("local")
        ids, _, names = _entries(group.filter(local))
        told = [np.stack([ids, names.view(np.int64)], axis=1)]
        ids, keys, names = _entries(group.filter(pc.invert(local)))
        if len(keys):
            # By key and the upper half of the name: should different names interleave, each piece of a group has its owner.
            order = np.argsort((keys.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
            ids, keys, names = ids[order], keys[order], names[order]
            del order
            key_head = np.append(True, keys[1:] != keys[:-1])
            name_head = key_head | np.append(True, names[1:] != names[:-1])
            key, heads = np.cumsum(key_head) - 1, np.flatnonzero(key_head)
            settled = ids > np.minimum.reduceat(ids, np.flatnonzero(name_head))[np.cumsum(name_head) - 1]
            kinds = np.bincount(key[name_head])
            several = (kinds > 1) & (np.maximum.reduceat(ids, heads) > np.minimum.reduceat(ids, heads))
            needed = ~settled & several[key]
            marks = np.where(kinds > hot_kinds, _NEEDED | _HOT, _NEEDED).astype(np.uint64)
            told.append(np.stack([ids[settled], names[settled].view(np.int64)], axis=1))
            told.append(np.stack([ids[needed], (names[needed] | marks[key[needed]]).view(np.int64)], axis=1))
        del ids, keys, names
        packed = pack_by_block(np.concatenate(told), blocks)
        release_memory()
        return packed

    return answer


_TOLD = "doc_id bigint, settled binary, needed binary"


def _names_per_document(group: pa.Table) -> pa.Table:
    rows, cuts = unpacked(group, 2, 1)
    names = rows[:, 1].view(np.uint64) if len(rows) else np.empty(0, np.uint64)
    settled, needed = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        marked = (names[a:b] & _MARKS) != 0
        settled.append(names[a:b][~marked].tobytes() or None)
        needed.append(names[a:b][marked].tobytes() or None)
    made = pa.table({
        "doc_id": pa.array(rows[cuts[:-1], 0], pa.int64()), "settled": pa.array(settled, pa.binary()), "needed": pa.array(needed, pa.binary()),
    })
    release_memory()
    return made


#: owners: rows of (id, name of the stretch, place of the piece in it).
_SENT = "part bigint, owners binary, keys binary, sizes binary, data binary"
_SENT_ARROW = pa.schema([
    ("part", pa.int64()), ("owners", pa.binary()), ("keys", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()),
])


def _first_of(found: Stretches, asked: list[np.ndarray]) -> np.ndarray:
    """In their order, the first stretch of each text with each of the names that are asked for of it."""
    with np.errstate(over="ignore"):
        # One look for all texts: a name is taken together with the number of its text.
        salt = mixed(np.arange(1, len(asked) + 1, dtype=np.uint64))
        own = found.names ^ np.repeat(salt, found.counts)
        wanted = (np.concatenate(asked) & ~_MARKS) ^ np.repeat(salt, list(map(len, asked)))
    at = np.flatnonzero(np.isin(own, wanted))
    return np.sort(at[np.unique(own[at], return_index=True)[1]])


def _piece_sender(parts: int, width: int):
    """The bytes of needed stretches, once per document; those of hot keys window by window, keyed by the window."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, ids = text_of(batch, "text"), batch.column("doc_id").to_pylist()
                found = Stretches(texts, width)
                bounds = found.bounds()
                travel: dict[int, list[tuple[int, int, int, int, bytes]]] = defaultdict(list)
                asked = [np.frombuffer(packed, np.uint64) for packed in batch.column("needed").to_pylist()]
                first = _first_of(found, asked)
                cuts = np.searchsorted(first, bounds)
                for text, owner, needed, a, b in zip(texts, ids, asked, cuts[:-1], cuts[1:], strict=True):
                    chosen = first[a:b]
                    hot = set((needed[(needed & np.uint64(_HOT)) != 0] & ~_MARKS).tolist())
                    columns = (found.names, found.keys, found.starts, found.ends)
                    for name, key, start, end in zip(*(c[chosen].tolist() for c in columns), strict=True):
                        if name not in hot:
                            travel[((key >> 32) * parts) >> 32].append((owner, name, 0, key, text[start:end]))
                            continue
                        for place in range(end - start - width + 1):
                            piece = text[start + place:start + place + width]
                            key = xxhash.xxh3_64_intdigest(piece)
                            travel[((key >> 32) * parts) >> 32].append((owner, name, place, key, piece))
                rows = [(
                    part, np.array([(f[0], f[1] - (f[1] >> 63 << 64), f[2]) for f in sent], np.int64).tobytes(),
                    np.array([f[3] for f in sent], np.uint64).tobytes(), np.array([len(f[4]) for f in sent], np.int32).tobytes(),
                    b"".join(f[4] for f in sent),
                ) for part, sent in travel.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW,
                    )
            release_memory()

    return send


def later_spans(pieces: list[bytes], owners: np.ndarray, width: int) -> list[list[list[int]]]:
    """For each of several different stretches: the spans of windows that also occur in a stretch of a smaller owner."""
    text = np.frombuffer(b"".join(p + bytes([SEPARATOR]) for p in pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begin = np.cumsum(sizes + 1) - sizes - 1
    windows = sizes - width + 1
    owner_of = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(owner_of)) - np.repeat(np.cumsum(windows) - windows, windows)
    which, place = RunIndex(text).shared(text, begin[owner_of] + offset, width)
    rows, at = np.unique(place, return_inverse=True)
    smallest = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(smallest, at, owners[owner_of[which]])
    later = which[smallest[at] < owners[owner_of[which]]]
    piece, start = owner_of[later], offset[later]
    head = np.append(True, (piece[1:] != piece[:-1]) | (start[1:] > start[:-1] + width))[:len(later)]
    last = np.append(head[1:], True)[:len(later)]
    spans = np.stack([start[head], start[last] + width], axis=1).tolist()
    cuts = np.searchsorted(piece[head], np.arange(len(pieces) + 1)).tolist()
    return [spans[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


#: Rows of (owner, name, start, end): what goes from a stretch, in bytes of the stretch.
_Place = tuple[int, int, int]


def _settle(width: int, blocks: int, index_bytes: int):
    def settle(group: pa.Table) -> pa.Table:
        """Of one key range: what goes from each stretch, packed by block of owners."""
        kinds: dict[int, dict[bytes, list[_Place]]] = defaultdict(lambda: defaultdict(list))
        for sent in group.to_pylist():
            places = map(tuple, np.frombuffer(sent["owners"], np.int64).reshape(-1, 3).tolist())
            keys, ends = np.frombuffer(sent["keys"], np.uint64).tolist(), np.cumsum(np.frombuffer(sent["sizes"], np.int32)).tolist()
            data, at = sent["data"], 0
            for place, key, end in zip(places, keys, ends, strict=True):
                kinds[key][data[at:end]].append(place)
                at = end
        gone: list[tuple[int, int, int, int]] = []
        pieces: list[bytes] = []
        firsts: list[list[_Place]] = []

        def compare() -> None:
            for found, own in zip(firsts, later_spans(pieces, np.array([f[0][0] for f in firsts], np.int64), width), strict=True):
                if own:
                    gone.extend((owner, name, at + a, at + b) for owner, name, at in found for a, b in own)
            pieces.clear()
            firsts.clear()

        held = 0
        for own in kinds.values():
            for piece, found in own.items():
                smallest = min(found)[0]
                gone.extend((owner, name, at, at + len(piece)) for owner, name, at in found if owner > smallest)
                if len(own) > 1:
                    pieces.append(piece)
                    firsts.append([f for f in found if f[0] == smallest])
                    held += len(piece)
            if held >= index_bytes:
                compare()
                held = 0
        if pieces:
            compare()
        del kinds
        packed = pack_by_block(np.array(gone, np.int64).reshape(-1, 4), blocks)
        release_memory()
        return packed

    return settle


_FOUND = "doc_id bigint, gone binary"


def _gone_per_document(group: pa.Table) -> pa.Table:
    rows, cuts = unpacked(group, 4, 1)
    return pa.table({
        "doc_id": pa.array(rows[cuts[:-1], 0], pa.int64()),
        "gone": pa.array([np.ascontiguousarray(rows[a:b, 1:]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
    })


def _join_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted spans [start, end) without overlaps or touching neighbours."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > reach[:-1])
    starts = spans[head, 0]
    ends = reach[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)]
    return np.stack([starts, ends], axis=1)


def _removed(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, settled: bytes | None, gone: bytes | None) -> np.ndarray:
    """Spans to remove from a text, from its stretches and what was found out about them."""
    whole = np.isin(names, np.frombuffer(settled or b"", np.uint64))
    spans = [np.stack([starts[whole], ends[whole]], axis=1)]
    if gone:
        parts = np.frombuffer(gone, np.int64).reshape(-1, 3)
        order = np.argsort(names, kind="stable")
        low, high = (np.searchsorted(names[order], parts[:, 0].astype(np.uint64), side) for side in ("left", "right"))
        part = np.repeat(np.arange(len(parts)), high - low)
        # The occurrences of each part's stretch in this text, one behind the other.
        nth = np.arange(len(part)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        spans.append(parts[part, 1:] + starts[order[low[part] + nth]][:, None])
    return _join_spans(np.concatenate(spans))


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot_kinds: int = HOT_KINDS,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """All rows and columns of `docs`, removed_bytes (spans of the UTF-8 bytes) and kept_bytes.

    Every byte is removed that lies in a string of `width` bytes which also starts in a document
    with a smaller id, judged on the input; kept_bytes has the others. Shorter texts, null and empty
    ones lose nothing; an empty table gives an empty one. Rows without id neither lose bytes nor count
    as owners; rows with the same id are one document for the comparison, so repeated rows lose the same
    bytes and there are no ties between owners. A text of any length is read whole, in one task. Clashing
    input columns stay; the new ones are prefixed with "_" then. width is at least CORE. Keys with
    more than hot_kinds different stretches are compared window by window, with the same result.
    """
    bounded_batches(docs.sparkSession)
    settled_col, gone_col, removed_col, kept_col = (
        free_name(docs, c) for c in ("settled_names", "gone_parts", "removed_bytes", "kept_bytes"))
    found_id = free_name(docs, "found_id")
    parts = parts_for(text_bytes(docs, text_col)[1], RANGE_BYTES)
    known = docs.where(F.col(id_col).isNotNull())
    texts = known.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # As many tasks as ranges and as blocks, however few partitions the session shuffles into.
    told = texts.mapInArrow(_name_sender(parts, width), _NAMED).repartition(parts, "part").groupBy("part").applyInArrow(
        _name_answerer(parts, hot_kinds), PACKED,
    )
    names = staged(told.repartition(parts, "block").groupBy("block").applyInArrow(_names_per_document, _TOLD), "stretch-names")
    pieces = texts.join(names.where("needed IS NOT NULL").select("doc_id", "needed"), "doc_id").mapInArrow(_piece_sender(parts, width), _SENT)
    settled = pieces.repartition(parts, "part").groupBy("part").applyInArrow(_settle(width, parts, index_bytes), PACKED)
    gone = staged(settled.repartition(parts, "block").groupBy("block").applyInArrow(_gone_per_document, _FOUND), "repeated-bytes")
    found = names.where("settled IS NOT NULL").select("doc_id", "settled").join(gone, "doc_id", "full").select(
        F.col("doc_id").alias(found_id), F.col("settled").alias(settled_col), F.col("gone").alias(gone_col),
    )
    joined = known.join(found, known[id_col] == found[found_id], "left").drop(found_id).unionByName(
        docs.where(F.col(id_col).isNull()).withColumns({c: F.lit(None).cast("binary") for c in (settled_col, gone_col)})
    )
    plain = docs.columns
    schema = T.StructType([
        *docs.schema.fields, T.StructField(removed_col, T.ArrayType(T.ArrayType(T.LongType())), False),
        T.StructField(kept_col, T.BinaryType(), False),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                data = text_of(batch, text_col)
                told = list(zip(batch.column(settled_col).to_pylist(), batch.column(gone_col).to_pylist(), strict=True))
                own = Stretches([t if any(f) else b"" for t, f in zip(data, told, strict=True)], width)
                bounds = own.bounds().tolist()
                removed, kept = [], []
                for text, found, a, b in zip(data, told, bounds[:-1], bounds[1:], strict=True):
                    spans = _removed(own.names[a:b], own.starts[a:b], own.ends[a:b], *found).tolist() if any(found) else []
                    removed.append(spans)
                    rest, at = [], 0
                    for start, end in spans:
                        rest.append(text[at:start])
                        at = end
                    kept.append(b"".join([*rest, text[at:]]))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in plain), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()),
                ], names=schema.names)
            release_memory()

    return joined.mapInArrow(cut, schema)


def op7_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_removed = F.aggregate("removed_bytes", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return remove_repeated_bytes(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), n_removed.alias("n_removed"),
        F.size("removed_bytes").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS MATERIALIZED (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
judged AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS first FROM keyed),
starts AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM judged WHERE first < doc_id),
runs AS (
  SELECT doc_id, p, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM starts),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS gap FROM spans),
cut AS (
  SELECT g.doc_id, sum(e - s) AS n, count(*) AS spans, max(e) AS last,
    string_agg(substr(h, (2 * gap + 1)::BIGINT, (2 * (s - gap))::BIGINT), '' ORDER BY s) AS kept
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""
