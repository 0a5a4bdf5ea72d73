"""Exact nearest neighbours by block products.

Only the best ``n`` rows per query and block leave the Python stage: query-chunk pairs are never
rows of a DataFrame. Chunks are hashed into blocks of bounded bytes per space and are never
copied; the queries of a space are copied once per block and stream past it, Arrow batch by Arrow
batch. A task so holds one block and one batch, whatever the number of chunks and queries, and a
tenant owning a third of the chunks is spread over as many tasks as its size asks for. The plan is
the same for any number of queries.

A caller that knows its queries to be few can ask for ``broadcast_queries``: the
chunk table is then scanned once, without a shuffle of vectors. More queries than
the stated bound are an error there, never another plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corpusflow.operators.ordered import first_rows

BROADCAST_QUERY_ROWS = 4096
BROADCAST_QUERY_VALUES = 4_000_000
# Bytes of the vectors (as doubles) of one block of chunks.
BLOCK_BYTES = 64 << 20
# Queries that a block is multiplied with at a time, and the bytes that their distances may take in one array.
STEP_ROWS = 256
STEP_BYTES = 16 << 20
DISTANCE_DIGITS = {"cosine": 12, "l2": 6, "squared_l2": 6}


def sizes(vectors: np.ndarray, metric: str) -> np.ndarray:
    """What ``distances`` needs of each vector alone: its length, or the square of it."""
    return np.linalg.norm(vectors, axis=1) if metric == "cosine" else (vectors**2).sum(axis=1)


def distances(chunks: np.ndarray, queries: np.ndarray, metric: str, chunk_sizes: np.ndarray | None = None) -> np.ndarray:
    """Distance matrix (queries x chunks) in double precision, rounded so that ties are exact."""
    chunk_sizes = sizes(chunks, metric) if chunk_sizes is None else chunk_sizes
    dots = queries @ chunks.T
    if metric == "cosine":
        norms = np.outer(sizes(queries, metric), chunk_sizes)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1.0 - dots / norms
    elif metric in ("l2", "squared_l2"):
        squares = sizes(queries, metric)[:, None] + chunk_sizes[None, :]
        out = np.maximum(squares - 2.0 * dots, 0.0)
        if metric == "l2":
            out = np.sqrt(out)
    else:
        raise ValueError(f"unknown metric {metric}")
    return np.where(np.isnan(out), np.inf, np.round(out, DISTANCE_DIGITS[metric]))


class _Best:
    """Best ``n`` chunks of each query in one block of queries."""

    def __init__(self, query_ids, vectors, scopes, n, metric):
        self.query_ids, self.vectors, self.scopes = query_ids, vectors, scopes
        self.n, self.metric = n, metric
        self.kept = None
        self.bound = np.full(len(query_ids), np.inf)

    def add(self, chunk_ids, document_ids, vectors):
        scores = distances(vectors, self.vectors, self.metric)
        allowed = np.ones(scores.shape, dtype=bool)
        for position, scope in enumerate(self.scopes):
            if scope is not None and len(scope):
                allowed[position] = pd.Series(document_ids).isin(list(scope)).to_numpy()
        masked = np.where(allowed, scores, np.inf)
        n = min(self.n, scores.shape[1])
        limit = np.minimum(np.partition(masked, n - 1, axis=1)[:, n - 1], self.bound)
        rows, cols = np.nonzero(allowed & (masked <= limit[:, None]))
        found = pd.DataFrame(
            {"q": rows, "distance": scores[rows, cols], "chunk_id": np.asarray(chunk_ids)[cols]}
        )
        merged = found if self.kept is None else pd.concat([self.kept, found], ignore_index=True)
        merged = merged.sort_values(["q", "distance", "chunk_id"], ignore_index=True)
        rank = merged.groupby("q").cumcount()
        self.kept = merged[rank < self.n].reset_index(drop=True)
        full = self.kept[self.kept.groupby("q").cumcount() == self.n - 1]
        self.bound[full["q"].to_numpy()] = full["distance"].to_numpy()

    def frame(self) -> pd.DataFrame:
        kept = self.kept
        if kept is None:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        return pd.DataFrame(
            {
                "query_id": np.asarray(self.query_ids)[kept["q"].to_numpy()],
                "chunk_id": kept["chunk_id"].to_numpy(),
                "distance": kept["distance"].replace(np.inf, np.nan).to_numpy(),
            }
        )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _prepared(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    # Aliases make the columns new ones: questions may be derived from the very chunks they search.
    return df.select(
        *[F.col(c).alias(c) for c in (*columns, *keys)], F.col("embedding").alias("embedding")
    ).filter(F.size("embedding") > 0).withColumn("_dim", F.size("embedding"))


def nearest(
    queries: DataFrame,
    chunks: DataFrame,
    n: int,
    metric: str = "cosine",
    keys: tuple[str, ...] = ("user_id", "embedding_model"),
    broadcast_queries: bool = False,
    chunk_block_rows: int | None = None,
    query_block_rows: int = STEP_ROWS,
    live: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, distance, rank)`` of the ``n`` nearest chunks sharing all ``keys``.

    ``queries``: query_id, keys, embedding and optionally ``scope`` (array of document ids;
    null or empty means every document). ``chunks``: chunk_id, document_id, keys, embedding.
    ``live``: (document_id, user_id) of the documents that may answer; every document without it.
    ``chunk_block_rows`` sets the size of a block in place of ``BLOCK_BYTES``.
    """
    keys = list(keys)
    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.lit(None).cast("array<string>"))
    query_rows = _prepared(
        queries.withColumn("scope", F.col("scope").cast("array<string>")), ["query_id", "scope"], keys
    )
    id_types = (queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType)
    schema = f"query_id {id_types[0].simpleString()}, chunk_id {id_types[1].simpleString()}, distance double"

    wanted = chunks
    if live is not None:
        wanted = wanted.join(live.select("document_id", "user_id"), ["document_id", "user_id"], "left_semi")
    chunk_rows = _prepared(
        wanted.withColumn("document_id", F.col("document_id").cast("string")), ["chunk_id", "document_id"], keys
    )
    if broadcast_queries:
        # The driver never sees more than one row past the bound.
        probe = query_rows.limit(BROADCAST_QUERY_ROWS + 1).toArrow()
        if probe.num_rows > BROADCAST_QUERY_ROWS or sum(probe.column("_dim").to_pylist()) > BROADCAST_QUERY_VALUES:
            raise ValueError("too many queries to broadcast; leave broadcast_queries out")
        candidates = _scan_with_broadcast(probe, chunk_rows, keys, n, metric, schema)
    else:
        candidates = _block_join(
            query_rows, chunk_rows, keys, n, metric, schema, chunk_block_rows, query_block_rows
        )
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    return first_rows(candidates, ["query_id"], order, n, out="rank")


def _scan_with_broadcast(probe, chunk_rows, keys, n, metric, schema):
    spark = chunk_rows.sparkSession
    space = [*keys, "_dim"]
    table = probe.to_pandas()
    blocks = {}
    if len(table):
        for key, rows in table.groupby(space, sort=False, dropna=True):
            vectors = np.stack([np.asarray(v, dtype=np.float64) for v in rows["embedding"]])
            blocks[key] = (rows["query_id"].to_numpy(), vectors, list(rows["scope"]))
    shared = spark.sparkContext.broadcast(blocks)

    def scan(batches):
        best = {}
        names = None
        for batch in batches:
            names = names or batch.schema.names
            columns = {name: batch.column(position) for position, name in enumerate(names)}
            labels = pd.DataFrame({name: columns[name].to_pandas() for name in space})
            for key, positions in labels.groupby(space, sort=False, dropna=True).indices.items():
                if key not in shared.value:
                    continue
                if key not in best:
                    ids, vectors, scopes = shared.value[key]
                    best[key] = _Best(ids, vectors, scopes, n, metric)
                rows = pa.array(positions)
                best[key].add(
                    columns["chunk_id"].take(rows).to_pandas().to_numpy(),
                    columns["document_id"].take(rows).to_pandas().to_numpy(),
                    _matrix(columns["embedding"].take(rows), key[-1]),
                )
        for block in best.values():
            yield pa.RecordBatch.from_pandas(block.frame(), schema=arrow_schema, preserve_index=False)

    arrow_schema = _arrow_schema(probe.schema, chunk_rows)
    return chunk_rows.mapInArrow(scan, schema)


def _arrow_schema(query_schema, chunk_rows):
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema(
        [
            ("query_id", query_schema.field("query_id").type),
            ("chunk_id", to_arrow_type(chunk_rows.schema["chunk_id"].dataType)),
            ("distance", pa.float64()),
        ]
    )


class _Block:
    """A block of chunks, against which batches of queries are ranked."""

    def __init__(self, pieces: list[pa.RecordBatch], dim: int, n: int, metric: str):
        self.ids = pa.concat_arrays([p.column("chunk_id") for p in pieces])
        self.vectors = np.concatenate([_matrix(p.column("embedding"), dim) for p in pieces])
        documents = pa.concat_arrays([p.column("document_id") for p in pieces]).dictionary_encode()
        self.documents = documents.indices.to_numpy(zero_copy_only=False)
        self.known = {d: i for i, d in enumerate(documents.dictionary.to_pylist())}
        # Rank of each id, for ties.
        order = pc.sort_indices(self.ids).to_numpy()
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.dim, self.n, self.metric = dim, n, metric
        parts = np.array_split(self.vectors, -(-self.vectors.nbytes // STEP_BYTES) or 1)
        self.sizes = np.concatenate([sizes(part, metric) for part in parts])

    def ranked(self, queries: pa.RecordBatch, step_rows: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """``best`` of all queries, so many at a time that their distances stay bounded whatever the block's rows."""
        step = max(1, min(step_rows, STEP_BYTES // (8 * max(1, len(self.vectors)))))
        for at in range(0, queries.num_rows, step):
            yield self.best(queries.slice(at, step))

    def best(self, queries: pa.RecordBatch) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(query_id, chunk_id, distance) of the ``n`` nearest chunks of every query of the batch."""
        scores = distances(self.vectors, _matrix(queries.column("embedding"), self.dim), self.metric, self.sizes)
        allowed = np.ones(scores.shape, dtype=bool)
        for position, scope in enumerate(queries.column("scope").to_pylist()):
            if scope:
                allowed[position] = np.isin(self.documents, [self.known[d] for d in set(scope) if d in self.known])
        masked = np.where(allowed, scores, np.inf)
        n = min(self.n, scores.shape[1])
        limit = np.partition(masked, n - 1, axis=1)[:, n - 1]
        rows, cols = np.nonzero(allowed & (masked <= limit[:, None]))
        order = np.lexsort((self.place[cols], scores[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        firsts = np.searchsorted(rows, rows, side="left")
        kept = np.arange(len(rows)) - firsts < n
        rows, cols = rows[kept], cols[kept]
        distance = scores[rows, cols]
        return queries.column("query_id").take(pa.array(rows)), self.ids.take(pa.array(cols)), pa.array(distance, mask=np.isinf(distance))


def _block_join(query_rows, chunk_rows, keys, n, metric, schema, chunk_block_rows, step_rows):
    space = [*keys, "_dim"]
    each = F.lit(chunk_block_rows) if chunk_block_rows else F.greatest(F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("_dim"))), F.lit(1))
    grid = chunk_rows.groupBy(*space).agg(F.count("*").alias("_n")).select(*space, F.ceil(F.col("_n") / each).cast("int").alias("_blocks"))
    cells = [*space, "_block"]
    vector = "array<float>" if all(df.schema["embedding"].dataType.elementType == FloatType() for df in (query_rows, chunk_rows)) else "array<double>"
    types = {"query_id": query_rows.schema["query_id"].dataType, "scope": "array<string>",
             "chunk_id": chunk_rows.schema["chunk_id"].dataType, "document_id": "string"}

    def side(df, is_query, block):
        own = [F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in types.items()]
        return df.join(grid, space).select(
            *space, block.alias("_block"), F.lit(is_query).alias("_query"),
            *[c.alias(name) for c, name in zip(own, types, strict=True)], F.col("embedding").cast(vector).alias("embedding"),
        )

    held = side(chunk_rows, False, F.pmod(F.xxhash64("chunk_id"), F.col("_blocks")).cast("int"))
    asked = side(query_rows, True, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The chunks of the block come first, then its queries.
        pieces, block = [], None
        for batch in batches:
            queries = pc.sum(pc.cast(batch.column("_query"), pa.int64())).as_py()
            chunks = batch.num_rows - queries
            if chunks:
                if block is not None:
                    raise ValueError("chunks of a block must precede its queries")
                pieces.append(batch.slice(0, chunks))
            if not queries:
                continue
            if not pieces:
                return
            if block is None:
                block = _Block(pieces, batch.column("_dim")[0].as_py(), n, metric)
            for query_ids, chunk_ids, found in block.ranked(batch.slice(chunks), step_rows):
                yield pa.RecordBatch.from_arrays([query_ids, chunk_ids, found], names=["query_id", "chunk_id", "distance"])

    ordered = held.unionByName(asked).repartition(*cells).sortWithinPartitions(*cells, "_query")
    return ordered.groupBy(*cells).applyInArrow(rank, schema)
