"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (a shorter item is one
window). Patterns of one length share a table: the last two words under the reading head
look up how far the head may move on; where it may not move, the patterns that end in
these two words are compared with the text directly.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.batches import alnum_words, bounded_batches, slices, text_of
from corpusflow.llm.staging import free_name

WINDOW = 10
#: Benchmark words that one search table holds; a larger benchmark is searched in several passes.
TABLE_WORDS = 2_000_000


class WordSearch:
    """Wu-Manber tables for patterns of one length (in words); block size two, one for single words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], dict[int, None]]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.ends: dict = {}
        for words, owners in patterns.items():
            for at in range(length - self.block + 1):
                block = words[at] if self.block == 1 else (words[at], words[at + 1])
                move = length - self.block - at
                if move < self.shift.get(block, self.default):
                    self.shift[block] = move
            self.ends.setdefault(block, []).append((list(words), owners))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, dict[int, None]]]:
        """(start, owners) of every occurrence, in order."""
        length, default, get = self.length, self.default, self.shift.get
        head, n = length - 1, len(words)
        if self.block == 1:
            for at, word in enumerate(words):
                for _, owners in self.ends.get(word, ()):
                    yield at, owners
            return
        while head < n:
            block = (words[head - 1], words[head])
            move = get(block, default)
            if move:
                head += move
                continue
            start = head - length + 1
            for pattern, owners in self.ends[block]:
                if words[start:head + 1] == pattern:
                    yield start, owners
            head += 1


class Benchmark:
    """All windows of a bounded set of items, grouped by length."""

    def __init__(self, items: Iterable[tuple[int, bytes]], window: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], dict[int, None]]] = {}
        for item, text in items:
            words = alnum_words(text)
            length = min(window, len(words))
            for at in range(len(words) - length + 1) if length else ():
                by_length.setdefault(length, {}).setdefault(tuple(words[at:at + length]), {})[item] = None
        self.tables = [WordSearch(length, patterns) for length, patterns in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans [start, end) of words and the items that own them."""
        spans, items, met = [], set(), set()
        for table in self.tables:
            for start, owners in table.find(words):
                spans.append((start, start + table.length))
                # A window that many items share may occur often in one text; its owners are added once.
                if id(owners) not in met:
                    met.add(id(owners))
                    items.update(owners)
        return spans, items


def merged_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


#: The tables that this Python worker built last, by the name of their block.
_BUILT: dict[str, Benchmark] = {}


def _built(name: str, items: Iterable[tuple[int, bytes]], window: int) -> Benchmark:
    """The tables of a block, made once per worker; those of one block are held at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Benchmark(items, window)
    return _BUILT[name]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most about TABLE_WORDS words, read partition by partition."""
    block, held = [], 0
    for item, text in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        data = text.encode()
        block.append((item, data))
        held += len(alnum_words(data))
        if held >= TABLE_WORDS:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """All rows and columns of `docs`, n_words, hit_spans (merged word spans) and hit_items.

    The benchmark is a query set: it is read in blocks of bounded size, each broadcast once,
    and all documents pass each block. Documents are never shuffled. A null text has no
    words; a null item text or one without words hits nothing; an empty benchmark leaves all
    documents clean. Items with equal ids count once; an item without id marks words but is not listed. Input columns with clashing names stay;
    the new ones are prefixed with "_" then. Repeated rows each get their own result, empty `docs`
    give none. A very long text is held as the list of its words, one text at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n_words, spans, items = (free_name(docs, c) for c in ("n_words", "hit_spans", "hit_items"))
    span_type = "array<struct<start:int,end:int>>"
    out = docs.withColumns({
        n_words: F.lit(0).cast("bigint"), spans: F.array().cast(span_type), items: F.array().cast("array<bigint>"),
    })
    schema = out.schema
    blocks = _item_blocks(benchmark, item_col, item_text_col)
    for block in itertools.chain([next(blocks, [])], blocks):
        out = _search_block(spark, out, schema, block, window, text_col, (n_words, spans, items))
    return out


def _search_block(spark, docs, schema, block, window, text_col, names) -> DataFrame:
    shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    n_words, spans, items = names
    span_arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _built(name, shared.value, window)
        for whole in batches:
            for batch in slices(whole, text_col):
                counts, all_spans, all_items = [], [], []
                held = zip(batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True)
                for data, (old_spans, old_items) in zip(text_of(batch, text_col), held, strict=True):
                    words = alnum_words(data)
                    found, owners = tables.search(words)
                    found.extend((s["start"], s["end"]) for s in old_spans)
                    counts.append(len(words))
                    all_spans.append([{"start": s, "end": e} for s, e in merged_spans(found)])
                    all_items.append(sorted(owners.union(old_items) - {None}))
                new = {
                    n_words: pa.array(counts, pa.int64()), spans: pa.array(all_spans, span_arrow),
                    items: pa.array(all_items, pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays(
                    [new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names,
                )

    return docs.mapInArrow(search, schema)


def _items_digest(items):
    """Hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return find_hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        _items_digest(F.col("hit_items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
starts AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized),
patterns AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM starts),
lengths AS (SELECT DISTINCT k FROM patterns),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k),
windows AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM spots),
hits AS (SELECT doc_id, k, i, item_id FROM windows JOIN patterns USING (k, p)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
owners AS (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits),
lists AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM owners GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(l.n, 0)::BIGINT AS n_items,
  sha256(coalesce(l.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hits h ON d.doc_id = h.doc_id LEFT JOIN lists l ON d.doc_id = l.doc_id
"""
