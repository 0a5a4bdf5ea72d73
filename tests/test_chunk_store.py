import pytest

from corpusflow.operators import chunk_store
from tests.conftest import rows

SCHEMA = "chunk_id bigint, document_id bigint, user_id string, content string, embedding_model string"


@pytest.fixture
def store(spark, tmp_path):
    made = chunk_store.open_store(spark, str(tmp_path / "store"), SCHEMA, user_buckets=8, id_buckets=3)
    yield made
    made.forget()


def filled(spark, store, n=300):
    data = [(i, i % 50, f"u{i % 50 % 10}", f"text {i}", "m") for i in range(n)]
    chunks = spark.createDataFrame(data, SCHEMA)
    documents = chunks.select("document_id", "user_id").distinct()
    store.append(chunks, documents.filter("document_id != 49"))
    return [d for d in data if d[1] != 49]


def test_append_keeps_living_documents_and_reopens(spark, store, tmp_path):
    data = filled(spark, store)
    assert sorted(rows(store.table().drop("user_bucket"))) == sorted(data)
    again = chunk_store.open_store(spark, str(tmp_path / "store"), SCHEMA, user_buckets=8, id_buckets=3)
    assert again.table().count() == len(data)
    again.forget()


def test_lookup_reads_only_the_users_partitions_and_shuffles_no_content(spark, store):
    data = filled(spark, store)
    asked = spark.createDataFrame([("u3", 3), ("u3", 13), ("u7", 7)], "user_id string, chunk_id bigint")
    held = store.holding(asked)
    assert set(rows(held.select("user_bucket").distinct())) == {(b,) for b in store.partitions_of(asked)}
    assert held.select("user_bucket").distinct().count() < store.table().select("user_bucket").distinct().count()
    # Also where the citations are too many to be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = asked.select("chunk_id").hint("merge").join(held.select("chunk_id", "content"), "chunk_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(rows(joined)) == [(i, f"text {i}") for i in (3, 7, 13)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "PartitionFilters: [isnotnull(user_bucket" in plan or "PartitionFilters: [user_bucket" in plan
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1, plan


def test_delete_rewrites_only_what_it_touches(spark, store):
    data = filled(spark, store)
    files = {p: b for b, p in rows(store.files())}
    victims = spark.createDataFrame([(3, "u3"), (4, "nobody"), (13, "u3")], "document_id bigint, user_id string")
    gone = store.delete(victims)
    assert sorted(rows(gone.select("chunk_id"))) == sorted((d[0],) for d in data if d[1] in (3, 13))
    assert sorted(rows(store.table().drop("user_bucket"))) == sorted(d for d in data if d[1] not in (3, 13))
    touched = set(store.partitions_of(spark.createDataFrame([("u3",)], "user_id string")))
    kept = {p for p, b in files.items() if b not in touched}
    now = {p: b for b, p in rows(store.files())}
    assert kept <= set(now) and {p for p in now if now[p] not in touched} == kept
    assert not {p for p in files if files[p] in touched} & set(now)


def test_delete_empties_a_partition(spark, store):
    data = filled(spark, store)
    users = {b: [u for u in {d[2] for d in data} if store.partitions_of(spark.createDataFrame([(u,)], "user_id string")) == [b]] for b in range(8)}
    bucket, owners = next((b, us) for b, us in users.items() if us)
    victims = spark.createDataFrame(sorted({(d[1], d[2]) for d in data if d[2] in owners}), "document_id bigint, user_id string")
    store.delete(victims)
    assert sorted(rows(store.table().drop("user_bucket"))) == sorted(d for d in data if d[2] not in owners)
    assert store.delete(victims).count() == 0


