import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import knn, retrieval
from tests.conftest import rows

VECTORS = "array<float>"


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(3)
    chunk_rows, query_rows = [], []
    for i in range(600):
        # One tenant owns most of the chunks.
        user = "hot" if i % 4 else f"u{i % 3}"
        vector = rng.normal(size=8)
        if i % 50 == 0:
            vector = np.ones(8)
        chunk_rows.append((i, i % 20, user, f"m{i % 2}", vector.tolist()))
    for q in range(40):
        user = ["hot", "u0", "u1", "nobody"][q % 4]
        scope = [1, 5] if q % 5 == 0 else None
        query_rows.append((q, user, f"m{q % 2}", rng.normal(size=8).tolist(), scope))
    chunks = spark.createDataFrame(
        chunk_rows, f"chunk_id long, document_id long, user_id string, embedding_model string, embedding {VECTORS}"
    )
    queries = spark.createDataFrame(
        query_rows, f"query_id long, user_id string, embedding_model string, embedding {VECTORS}, scope array<long>"
    )
    return chunk_rows, query_rows, chunks, queries


def brute(chunk_rows, query_rows, n, metric):
    out = set()
    for q, user, model, vector, scope in query_rows:
        found = []
        for c, doc, owner, space_, other in chunk_rows:
            if owner != user or space_ != model or (scope and doc not in scope):
                continue
            a, b = np.float32(vector).astype(float), np.float32(other).astype(float)
            d = 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if metric == "cosine" else np.linalg.norm(a - b)
            found.append((round(d, 6), c))
        out |= {(q, c, rank) for rank, (_, c) in enumerate(sorted(found)[:n], 1)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("plan", ["broadcast", "blocks"])
def test_both_plans_equal_brute_force(space, metric, plan):
    chunk_rows, query_rows, chunks, queries = space
    # Blocks far smaller than the hot tenant.
    limits = {"broadcast_queries": True} if plan == "broadcast" else {"chunk_block_rows": 37, "query_block_rows": 3}
    found = knn.nearest(queries, chunks, 7, metric, **limits)
    assert set(rows(found, "query_id", "chunk_id", "rank")) == brute(chunk_rows, query_rows, 7, metric)


def test_other_dimensions_are_not_compared(spark):
    chunks = spark.createDataFrame(
        [(1, 1, "u", "m", [1.0, 0.0]), (2, 1, "u", "m", [1.0, 0.0, 0.0])],
        f"chunk_id long, document_id long, user_id string, embedding_model string, embedding {VECTORS}",
    )
    queries = spark.createDataFrame([(9, "u", "m", [1.0, 0.0])], f"query_id long, user_id string, embedding_model string, embedding {VECTORS}")
    assert rows(knn.nearest(queries, chunks, 5), "chunk_id") == [(1,)]


def test_weak_matches_apply_to_the_fetched_rows(spark):
    found = spark.createDataFrame(
        [(1, 10, 0.2), (1, 11, 0.9), (2, 12, 0.8), (2, 13, 0.95)], "query_id long, chunk_id long, distance double"
    )
    weak = retrieval.distance_filter(found, 0.75, F.lit(True))
    assert sorted(rows(weak, "query_id", "chunk_id")) == [(1, 10), (2, 12), (2, 13)]
    strict = retrieval.distance_filter(found, 0.75, F.lit(False))
    assert rows(strict, "query_id", "chunk_id") == [(1, 10)]
    assert rows(retrieval.keep_first(weak, 1), "query_id", "chunk_id", "index") == [(1, 10, 1), (2, 12, 1)]


def test_probing_every_list_is_exact(space):
    chunk_rows, query_rows, chunks, queries = space
    plain = queries.drop("scope")
    exact = {r[:2] for r in brute(chunk_rows, [(*q[:4], None) for q in query_rows], 5, "cosine")}
    all_lists = retrieval.approx_knn(plain, chunks, nlist=4, nprobe=4, n=5)
    assert set(rows(all_lists, "query_id", "chunk_id")) == exact
    some = set(rows(retrieval.approx_knn(plain, chunks, nlist=4, nprobe=2, n=5), "query_id", "chunk_id"))
    assert len(some & exact) / len(exact) > 0.5


def test_distinct_questions_share_one_representative(spark):
    asked = spark.createDataFrame(
        [(3, "u", "a", True), (1, "u", "a", True), (2, "u", "a", False), (4, "v", "a", True)],
        "query_id long, user_id string, query string, allow_weak boolean",
    )
    out = dict(rows(retrieval.distinct_questions(asked), "query_id", "asked_as"))
    assert out == {1: 1, 3: 1, 2: 2, 4: 4}


def test_locators(spark):
    schema = "m struct<page:int,slide:int,paragraph:int,line:int,table:int,section:string,title:string>"
    data = [((2, None, 3, 4, None, "", None),), ((None, None, 3, 4, None, "S", None),), ((None, 7, 3, None, 1, None, "T"),)]
    df = spark.createDataFrame(data, schema)
    assert [r[0] for r in rows(df.select(retrieval.locators(F.col("m"))))] == [["p. 2"], ["¶ 3", "line 4", "S"], ["slide 7"]]


def test_citations_without_keys_are_spread(spark):
    sources = spark.createDataFrame(
        [(1, 10, 100), (2, 11, None), (3, None, 100), (4, 99, 999), *[(i, None, None) for i in range(5, 400)], (5, None, None)],
        "message_id long, chunk_id long, document_id long",
    )
    chunks = spark.createDataFrame([(10, 0, 100), (11, 1, 100)], "chunk_id long, chunk_index int, document_id long")
    documents = spark.createDataFrame([(100, "a.txt")], "document_id long, original_filename string")
    got = retrieval.resolved_citations(sources, chunks, documents)
    found = {r.message_id: (r.chunk_index, r.chunk_document_id, r.original_filename) for r in got.collect()}
    assert {k: found[k] for k in range(1, 5)} == {1: (0, 100, "a.txt"), 2: (1, 100, None), 3: (None, None, "a.txt"), 4: (None, None, None)}
    assert got.count() == 400 and set(found) == set(range(1, 400))
    # Both keys take part in the exchange of the rows without any.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retrieval.resolved_citations(sources, chunks, documents)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert exchanges and all("_place" in line for line in exchanges)


def test_distances_of_a_block_are_bounded():
    """Many chunks in a block make the steps of queries smaller, not the arrays larger; the answers stay."""
    generator = np.random.default_rng(5)
    vectors, asked = generator.normal(size=(60_000, 4)).astype(np.float32), generator.normal(size=(256, 4)).astype(np.float32)
    table = lambda v, **more: pa.record_batch({"embedding": pa.array(v.tolist(), pa.list_(pa.float32())), **more})
    ids = pa.array(range(len(vectors)), pa.int64())
    queries = table(asked, query_id=pa.array(range(len(asked)), pa.int64()), scope=pa.array([None] * len(asked), pa.list_(pa.string())))
    for metric in ("cosine", "l2"):
        block = knn._Block([table(vectors, chunk_id=ids, document_id=ids.cast(pa.string()))], 4, 3, metric)
        tracemalloc.start()
        found = [part for part in block.ranked(queries, knn.STEP_ROWS)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 10 * knn.STEP_BYTES
        whole = block.best(queries)
        for column in range(3):
            assert [v for part in found for v in part[column].to_pylist()] == whole[column].to_pylist()
