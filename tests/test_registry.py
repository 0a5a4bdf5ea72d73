import pytest

import __spark_entry__ as entry
from corpusflow.plans import catalogue
from tests.oracle_check import ROOT, compare

# A spread of the registered queries; tests/oracle_check.py runs all of them.
CHECKED = [
    "retrieve_sources", "retrieve_scoped", "search_conversations", "route_messages", "markdown_blocks", "document_state",
    "fixed_window_limits", "ttl_cache_hits", "cascade_delete", "ingest_documents", "assemble_prompts", "chunk_documents",
    "stored_citations", "stored_chunks_after_delete", "document_runs_stream", "incremental_ingest", "scan_raw_files", "read_sse_stream",
    "embed_with_provider", "observed_progress",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, name):
    text, good = compare(spark, name, f"{ROOT}/sf0.001")
    assert good, text


def test_every_query_is_registered_once_and_described():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert set(catalogue.QUERIES) - set(entry.oracle_sql()) == {"approx_knn"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
