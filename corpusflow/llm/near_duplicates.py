"""Near-duplicate documents by HyperMinHash sketches.

Documents with equal shingle sets form a class with one representative. Representatives
that share a band of compressed registers are candidates; a star per band and connected
components put each of them into exactly one candidate cluster. Inside a cluster, cut into
blocks of bounded size, pairs whose collision-corrected estimate can reach the threshold
are confirmed on the full shingle sets. Pairs never become rows, only confirmed links do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.batches import bounded_batches, slices, text_of
from corpusflow.llm.components import components
from corpusflow.llm.sketches import BAND_REGISTERS, BANDS, BUCKETS, estimate, filled_up, raw_registers, shingle_set
from corpusflow.llm.staging import staged

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Standard deviations by which an estimate may fall short before a pair is given up (about 1e-9 of the links).
SLACK = 6.0
#: Documents, and shingles, that one side of a block holds.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1 << 19

_SKETCH = "doc_id bigint, text_key bigint, n_shingles bigint, class binary, registers binary"
_SKETCH_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()),
    ("registers", pa.binary()),
])


def _sketcher(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [shingle_set(t, width) for t in text_of(batch, "text")]
                raw = raw_registers(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if len(s) else None for r, s in zip(raw, sets, strict=True)], pa.binary()),
                ], schema=_SKETCH_ARROW)

    return sketch


def sketch_documents(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, class (digest of the set) and raw registers of each row; null for an empty set."""
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"),
    ).mapInArrow(_sketcher(width), _SKETCH)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            raw = np.frombuffer(b"".join(part.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            bands = filled_up(raw).view(np.uint64).reshape(len(raw), BANDS)
            # The band's number goes in: equal registers of different bands are no match.
            keys = (bands * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part.column("rep").to_numpy(zero_copy_only=False), BANDS), pa.int64()),
                pa.array(keys.reshape(-1).view(np.int64), pa.int64()),
            ], names=["rep", "key"])


assert BAND_REGISTERS * 2 == 8  # a band is one 64-bit word of registers


def _links_in_block(percent: int):
    def links(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        """Confirmed links of one pair of chunks that connect what wasn't connected in the block yet."""
        left_chunk, right_chunk = key[1].as_py(), key[2].as_py()
        # An id may stand for several texts; each of them is compared on its own.
        rows = group.select(["rep", "text_key", "chunk", "registers", "shingles"]).sort_by(
            [("rep", "ascending"), ("text_key", "ascending")]).to_pydict()
        reps, chunk = rows["rep"], np.array(rows["chunk"])
        raw = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(-1, BUCKETS)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        sizes = np.array([len(s) for s in sets])
        root = list(range(len(reps)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        found: tuple[list[int], list[int]] = ([], [])
        left = np.flatnonzero(chunk == left_chunk)
        right = np.flatnonzero(chunk == right_chunk)
        for x in left.tolist():
            others = right[right > x] if left_chunk == right_chunk else right
            small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
            others = others[100 * small >= percent * large]
            if not len(others):
                continue
            like, used = estimate(raw[x][None, :], raw[others], sizes[x], sizes[others])
            limit = percent / 100
            others = others[like >= limit - SLACK * np.sqrt(limit * (1 - limit) / np.maximum(1, used))]
            for y in others.tolist():
                if find(x) == find(y):
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    root[find(y)] = find(x)
                    found[0].append(max(reps[x], reps[y]))
                    found[1].append(min(reps[x], reps[y]))
        return pa.table({"u": pa.array(found[0], pa.int64()), "v": pa.array(found[1], pa.int64())})

    return links


def _shingler(width: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = pa.array([shingle_set(t, width).tobytes() for t in text_of(batch, "text")], pa.binary())
                at = batch.schema.names.index("text")
                yield batch.set_column(at, "shingles", sets)

    return shingles


def confirmed_links(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (u, v) between representatives that connect all whose sets are similar enough."""
    bands = classes.select("rep", "registers").mapInArrow(_band_keys, "rep bigint, key bigint")
    stars = bands.groupBy("key").agg(F.min("rep").alias("star"), F.max("rep").alias("last")).where("star < last").select("key", "star")
    edges = bands.join(stars, "key").where("rep <> star").select(F.col("rep").alias("u"), F.col("star").alias("v"))
    clusters = components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    members = staged(classes.join(clusters, "rep"), "cluster-members")
    sizes = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES),
        ).cast("int").alias("chunks"),
    )
    placed = members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    texts = docs.select(
        F.col(id_col).cast("bigint").alias("rep"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"),
    )
    # Of repeated rows with the same id and text one is enough.
    sets = staged(
        placed.join(texts, ["rep", "text_key"]).select("cluster", "rep", "text_key", "chunks", "chunk", "registers", "text")
        .mapInArrow(
            _shingler(width),
            "cluster bigint, rep bigint, text_key bigint, chunks int, chunk int, registers binary, shingles binary",
        ),
        "cluster-sets",
    ).dropDuplicates(["rep", "text_key", "cluster"])
    # Each chunk meets every chunk of its cluster, itself included; blocks are (lower, upper).
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "cluster", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "rep",
        "text_key", "chunk", "registers", "shingles",
    )
    return paired.groupBy("cluster", "a", "b").applyInArrow(_links_in_block(percent), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs`.

    Documents whose shingle sets have 100 * intersection >= percent * union are linked;
    component_id is the smallest id that links reach, kept is true for that document. Texts
    without words (empty, null) have an empty set and no links. Rows without id have no links
    either: component_id is null and kept true. Rows with one id are one document. A text of
    fewer words than a shingle is one shingle.
    """
    sketched = staged(sketch_documents(docs, width, id_col, text_col), "sketches")
    usable = sketched.where("doc_id IS NOT NULL AND class IS NOT NULL")
    classes = staged(
        usable.groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key", "n_shingles")).alias("first"), F.first("registers").alias("registers"),
        ).select(
            "class", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"),
            F.col("first.n_shingles").alias("n_shingles"), "registers",
        ), "classes",
    )
    links = confirmed_links(docs, classes, width, percent, id_col, text_col)
    placed = staged(usable.select("doc_id", "class").join(classes.select("class", "rep"), "class").select("doc_id", "rep").distinct(), "class-members")
    # A repeated id whose rows have different texts ties the classes of all its rows.
    tied = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    ties = placed.join(tied, "doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
    found = components(staged(links.union(ties), "links"))
    named = placed.join(found, placed["rep"] == found["node"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"),
    )
    result = sketched.select("doc_id", "n_shingles").where("doc_id IS NOT NULL").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    unnamed = sketched.where("doc_id IS NULL").select(
        "doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"),
    )
    return result.union(unnamed)


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that near_duplicates keeps, with their columns."""
    gone = staged(
        near_duplicates(docs, width, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_gone_id")).distinct(),
        "near-duplicates",
    )
    known = docs.where(F.col(id_col).isNotNull())
    kept = known.join(gone, known[id_col] == gone["_gone_id"], "left_anti")
    return kept.union(docs.where(F.col(id_col).isNull()))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, least(4, len(w)) AS k, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM d),
shingles AS (SELECT DISTINCT doc_id, md5(k || ' ' || array_to_string(w[i:i + k - 1], ' ')) AS s FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(s, '' ORDER BY s)) AS c FROM shingles GROUP BY doc_id),
reps AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY c) AS rep FROM sets),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE a.doc_id IN (SELECT rep FROM reps) AND b.doc_id IN (SELECT rep FROM reps) GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)
  UNION SELECT rep, doc_id FROM reps WHERE rep <> doc_id),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT u AS doc_id, u AS seen FROM both_ways
  UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.seen),
lowest AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.c, d.doc_id) AS component_id,
  coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN lowest l ON d.doc_id = l.doc_id
"""
