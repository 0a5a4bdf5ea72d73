"""Ranked lexical search by NRA: impact-sorted lists are read in sequence, never looked up.

The index is cut into shards of documents. A shard keeps, per term, the documents that hold
it in descending order of what the term gives to their score. A query reads its lists from
the top, in rounds; each document has a lower bound (what was seen) and an upper bound (and
what the unread lists could still give). Documents whose upper bound falls below the k-th
lower bound go; reading ends when the bounds of all that are left have met, so membership,
ties and scores are exact. The best of each shard meet in one last ranking.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from corpusflow.llm.batches import alnum_words, bounded_batches, release_memory, slices, text_of
from corpusflow.llm.staging import staged
from corpusflow.operators.ordered import first_rows

TOP = 50
#: Postings and documents of one shard, about; a shard is one group in one task. A document is never cut.
SHARD_POSTINGS = 2_000_000
SHARD_DOCS = 16_000
#: Terms of the queries that are searched at a time; more queries are searched block by block.
BLOCK_TERMS = 200_000
#: Postings of each list in the first round; each round reads twice as many.
FIRST_STEP = 64

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INDEX = "shard bigint, term binary, held bigint, places binary, strengths binary, ids array<bigint>"
_INDEX_ARROW = pa.schema([
    ("shard", pa.int64()), ("term", pa.binary()), ("held", pa.int64()), ("places", pa.binary()), ("strengths", pa.binary()),
    ("ids", pa.list_(pa.int64())),
])


@dataclass
class Index:
    """Lists per shard and term (and a row of document ids per shard), documents with a term, and their terms."""

    lists: DataFrame
    n_docs: int
    n_terms: int


def _term_count(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Documents with a term, and all terms: two numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = total = 0
        for batch in batches:
            for data in text_of(batch, text_col):
                n = len(alnum_words(data))
                filled += n > 0
                total += n
        yield pa.record_batch([pa.array([filled], pa.int64()), pa.array([total], pa.int64())], names=["filled", "total"])

    found = docs.select(text_col).mapInArrow(count, "filled bigint, total bigint").agg(F.sum("filled"), F.sum("total")).first()
    return int(found[0] or 0), int(found[1] or 0)


class _Shard:
    """Postings of some documents, sorted into lists when the shard is full."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.lengths, self.terms, self.counts, self.postings = [], [], [], [], 0

    def add(self, doc_id, data: bytes) -> None:
        words = alnum_words(data)
        found = Counter(words)
        number = self.vocabulary.setdefault
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter((number(w, len(self.vocabulary)) for w in found), np.int32, len(found)))
        self.counts.append(np.fromiter(found.values(), np.int64, len(found)))
        self.postings += len(found)

    def full(self) -> bool:
        return self.postings >= SHARD_POSTINGS or len(self.ids) >= SHARD_DOCS

    def lists(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The row of ids, then a row per term, its documents strongest first."""
        empty = pa.array([b""], pa.binary())
        yield pa.record_batch([
            pa.array([shard], pa.int64()), pa.array([None], pa.binary()), pa.array([0], pa.int64()), empty, empty,
            pa.array([self.ids], pa.list_(pa.int64())),
        ], schema=_INDEX_ARROW)
        if not self.postings:
            return
        sizes = np.fromiter(map(len, self.terms), np.int64, len(self.terms))
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        m = 50 + (50 * np.array(self.lengths, np.int64) * n_docs) // n_terms
        strength = ((10**9 * tf) // (1000 * tf + 20 * m[place])).astype(np.int32)
        order = np.lexsort((place, -strength, term))
        held = np.bincount(term, minlength=len(self.vocabulary))
        ends = np.concatenate([[0], np.cumsum(held)]).astype(np.int32) * 4

        def packed(values: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(values[order].astype(np.int32))])

        whole = pa.record_batch([
            pa.array(np.full(len(held), shard), pa.int64()), pa.array(list(self.vocabulary), pa.binary()), pa.array(held, pa.int64()),
            packed(place), packed(strength), pa.nulls(len(held), pa.list_(pa.int64())),
        ], schema=_INDEX_ARROW)
        for at in range(0, whole.num_rows, 10_000):
            yield whole.slice(at, 10_000)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The written index of all documents; texts are read twice (counts, lists) and never shuffled.

    Every row is a document of its own, also a repeated one or one without id. Null and empty texts have
    no terms and are found by nothing. A text of any length is one document of one shard. Other columns
    play no part, so their names can't clash. No documents: an index without lists.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = _term_count(rows, "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, data in zip(batch.column("id").to_pylist(), text_of(batch, "text"), strict=True):
                    shard.add(doc_id, data)
                    if shard.full():
                        yield from shard.lists(part + made, n_docs, n_terms)
                        made, shard = made + 1, _Shard()
        if shard.ids:
            yield from shard.lists(part + made, n_docs, n_terms)
        release_memory()

    return Index(staged(rows.mapInArrow(index, _INDEX), "search-index"), n_docs, n_terms)


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, k: int, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents that may be among the k best above 0, their scores resolved.

    Each list is (places, impacts), impacts descending; it is read forward only. Documents equal to the
    k-th stay, for the caller to break ties.
    """
    lower = np.zeros(docs, np.int64)
    unread = np.ones((len(lists), docs))
    heads = np.array([impacts[0] if len(impacts) else 0 for _, impacts in lists], np.float64)
    active, at = np.arange(docs), 0
    while len(active):
        for i, (places, impacts) in enumerate(lists):
            if heads[i]:
                read = places[at:at + step]
                lower[read] += impacts[at:at + step]
                unread[i, read] = 0
                heads[i] = impacts[at + step] if at + step < len(impacts) else 0
        at, step = at + step, step * 2
        low = lower[active]
        high = low + (heads @ unread[:, active]).astype(np.int64)
        bar = max(1, np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 1
        stay = high >= bar
        active, low, high = active[stay], low[stay], high[stay]
        if (low == high).all():
            break
    return active, lower[active]


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[dict]:
    """Queries (id -> distinct terms) in blocks of about BLOCK_TERMS terms, read partition by partition."""
    lowered = F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = queries.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({_TERM})"), 1))).alias("term"))
    items = staged(words.groupBy("id").agg(F.collect_set("term").alias("terms")), "search-queries")
    block, held = {}, 0
    for row in items.toLocalIterator():
        block[row.id] = [t.encode() for t in row.terms]
        held += len(row.terms)
        if held >= BLOCK_TERMS:
            yield block
            block, held = {}, 0
    if block:
        yield block


def _search_block(index: Index, block: dict, item_type, k: int) -> DataFrame:
    """The k best of every shard for each query of a block, written."""
    spark = index.lists.sparkSession
    terms = sorted({t for words in block.values() for t in words})
    number = {t: i for i, t in enumerate(terms)}
    wanted = F.broadcast(spark.createDataFrame([(i, bytearray(t)) for t, i in number.items()], "number int, term binary"))
    lists = index.lists.join(wanted, "term")
    held = {r.number: r.held for r in lists.groupBy("number").agg(F.sum("held").alias("held")).collect()}
    weights = {i: weight(index.n_docs, n) for i, n in held.items()}
    shared = spark.sparkContext.broadcast((weights, {item: [number[t] for t in words] for item, words in block.items()}))
    arrow = pa.schema([("item", to_arrow_type(item_type)), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        known, items = shared.value
        ids, found = [], {}
        for batch in table.to_batches():
            columns = [batch.column(c).to_pylist() for c in ("number", "places", "strengths", "ids")]
            for term, places, strengths, own in zip(*columns, strict=True):
                if own is not None:
                    ids = own
                elif known[term] > 0:
                    impacts = np.frombuffer(strengths, np.int32).astype(np.int64) * known[term]
                    found[term] = (np.frombuffer(places, np.int32), impacts)
        out = []
        for item, words in items.items():
            lists = [found[t] for t in words if t in found]
            if not lists:
                continue
            places, scores = nra(lists, len(ids), k)
            ranked = sorted(zip((-scores).tolist(), [(ids[p] is None, ids[p] or 0) for p in places.tolist()], strict=True))[:k]
            out.extend((item, None if gone else doc, -score) for score, (gone, doc) in ranked)
        made = pa.Table.from_arrays([pa.array([r[j] for r in out], arrow.field(j).type) for j in range(3)], schema=arrow)
        release_memory()
        return made

    heads = index.lists.where("term is null").withColumn("number", F.lit(None).cast("int"))
    columns = ["shard", "number", "places", "strengths", "ids"]
    parts = max(1, heads.count())
    gathered = lists.select(columns).unionByName(heads.select(columns)).repartition(parts, "shard")
    best = gathered.groupBy("shard").applyInArrow(search, f"item {item_type.simpleString()}, doc_id bigint, score bigint")
    written = staged(best, "search-best")
    shared.unpersist()
    return written


def search(index: Index, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query with a score above 0: id_col, rank (from 1), doc_id, score.

    Equal scores are ordered by ascending doc_id, rows without id last; repeated documents are ranked each.
    Rows of one query id (null is one) are one query of all their terms. Queries without terms and terms
    that no document holds find nothing. The queries pass in blocks of bounded size; a block's broadcast
    is dropped when its answers are written. Documents never meet by term: a shard is the largest group.
    """
    item_type = queries.schema[id_col].dataType
    found = None
    for block in _query_blocks(queries, id_col, text_col):
        best = _search_block(index, block, item_type, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = queries.select(F.col(id_col).alias("item"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    ranked = first_rows(found, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k, out="rank")
    return ranked.select(F.col("item").alias(id_col), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(build_index(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
filled AS (SELECT doc_id, r, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM filled),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
spots AS (SELECT r, unnest(w) AS term FROM filled),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM spots WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, r, sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN filled USING (r), corpus GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
