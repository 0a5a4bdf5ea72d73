import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import context, ordered
from tests.conftest import rows


def sources(spark, lengths, kind="document"):
    data = [(1, i, kind, f"d{i}", "x" * n, None) for i, n in enumerate(lengths, 1)]
    return spark.createDataFrame(data, "query_id int, index int, type string, document_name string, content string, page int")


def test_budget_stops_at_first_overflow(spark):
    # The third block overflows, the fourth would fit: both are left out.
    got = context.context_blocks(sources(spark, [40, 40, 500, 1]), max_chars=120)
    assert [r[0] for r in rows(got.orderBy("number"), "number")] == [1, 2]


def test_budget_boundary_and_many_tiny_sources(spark):
    assert len(rows(context.context_blocks(sources(spark, [3]), max_chars=10))) == 1
    assert len(rows(context.context_blocks(sources(spark, [3]), max_chars=9))) == 0
    tiny = spark.range(1, 4000).select(
        F.lit(1).alias("query_id"), F.col("id").cast("int").alias("index"), F.lit("document").alias("type"),
        F.lit("").alias("document_name"), F.lit("").alias("content"),
    )
    used, want = 0, 0
    for i in range(1, 4000):
        used += len(f"[{i}] ") + 1
        if used > 12000:
            break
        want = i
    got = context.context_blocks(tiny)
    assert got.count() == want


def test_headers(spark):
    data = [(1, 1, "web", "T", "https://u", None, None, None, "snip"), (1, 2, "document", "T", None, "file.pdf", 3, "body", None), (1, 3, "document", "T", None, None, 0, None, "s")]
    df = spark.createDataFrame(data, "query_id int, index int, type string, title string, url string, document_name string, page int, content string, snippet string")
    text = rows(context.build_context(df, start_index=4), "context")[0][0]
    assert text == "[4] T - https://u\nsnip\n\n[5] file.pdf, page 3\nbody\n\n[6] T\ns"


def messages(spark, texts, roles=None):
    t0 = datetime(2024, 1, 1)
    data = [(1, i, (roles or ["user", "assistant"] * 50)[i], t, t0 + timedelta(seconds=i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "conversation_id int, message_id int, role string, content string, created_at timestamp")


@pytest.mark.parametrize("texts,kept", [
    (["a"] * 9, [3, 4, 5, 6, 7, 8]),
    (["a", " ", "b", "\n"], [0, 2]),
    (["x" * 900] * 8, [2, 3, 4, 5, 6, 7]),
    (["x" * 1300] * 6, [2, 3, 4, 5]),
])
def test_history_window(spark, texts, kept):
    got = context.build_history(messages(spark, texts))
    assert sorted(r[0] for r in rows(got, "message_id")) == kept


def test_newest_message_always_stays(spark):
    got = context.build_history(messages(spark, ["a", "x" * 50]), max_chars=10)
    assert rows(got, "message_id", "content") == [(1, "x" * 50)]
    cut = context.build_history(messages(spark, ["x" * 1201]))
    assert rows(cut, "content") == [("x" * 1200 + " ...",)]


@pytest.mark.parametrize("block", [4096, 8])
def test_history_before_every_turn(spark, block):
    generator = random.Random(block)
    talks = {c: [generator.choice(["", " \n", "a", "x" * 700, "y" * 1300, "z" * 40]) for _ in range(n)] for c, n in ((1, 120), (2, 3), (3, 1))}
    t0 = datetime(2024, 1, 1)
    # Some messages share their time; their ids decide.
    data = [(c, 1000 * c + i, ["user", "assistant"][i % 2], t, t0 + timedelta(hours=i // 2)) for c, texts in talks.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "conversation_id int, message_id int, role string, content string, created_at timestamp")
    found = context.turn_histories(df, block=block).select("message_id", "history", context.format_turns(F.col("history")).alias("text"))
    got = {r.message_id: ([tuple(h) for h in r.history], r.text) for r in found.collect()}
    assert len(got) == len(data)
    for c, texts in talks.items():
        for i in range(len(texts)):
            window, used = [], 0
            for j in reversed([j for j in range(i) if texts[j].strip()][-6:]):
                said = texts[j] if len(texts[j]) <= 1200 else texts[j][:1200] + " ..."
                used += len(said)
                if window and used > 6000:
                    break
                window.insert(0, (["user", "assistant"][j % 2], said))
            lines = [("User: " if r == "user" else "Assistant: ") + (s.strip()[:800] + " ..." if len(s.strip()) > 800 else s.strip()) for r, s in window]
            assert got[1000 * c + i] == (window, "\n".join(lines) or context.NO_HISTORY)


def test_format_history(spark):
    got = context.format_history(messages(spark, ["hi", "  ", " there ", "x" * 900]))
    assert rows(got, "history") == [("User: hi\nUser: there\nAssistant: " + "x" * 800 + " ...",)]
    blank = context.format_history(messages(spark, [" "]))
    assert rows(blank, "history") == [(context.NO_HISTORY,)]


def test_prompts(spark):
    schema = "query_id int, mode string, question string, history string, document_context string, web_context string"
    df = spark.createDataFrame([(1, "document", "Q", None, "", None), (2, "web", "Q", "H", None, "W" * 13000), (3, "hybrid", "Q", "H", "D", ""), (4, "llm", "Q", None, "D", "W")], schema)
    got = dict(rows(context.assemble_prompts(df), "query_id", "prompt"))
    assert context.NO_PASSAGES in got[1] and context.NO_HISTORY in got[1]
    assert "W" * 12000 in got[2] and "W" * 12001 not in got[2]
    assert "Document research:\nD\n" in got[3] and context.NO_WEB_RESULTS in got[3]
    assert got[4].endswith("Question:\nQ") and "D" not in got[4].replace("Conversation", "")
    notice = spark.range(1).select(context.web_context_with_extras(F.lit(""), F.lit(None).cast("string"), F.lit(True), F.lit(0)))
    assert notice.first()[0] == context.NO_CURRENT_DATA


def test_slab_numbers_equal_plain_windows(spark):
    data = [("hot" if i % 3 else f"k{i % 7}", (i * 37) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = ordered.slab_row_number(df, ["k"], F.floor(F.col("v") / 50), [F.col("v"), F.col("i")], "n")
    want = {}
    for k, v, i in sorted(data):
        want[(k, i)] = want.get(k, 0) + 1
        want[k] = want[(k, i)]
    assert {(r[0], r[1]): r[2] for r in rows(got, "k", "i", "n")} == {x: n for x, n in want.items() if isinstance(x, tuple)}
    total = ordered.slab_running_sum(df, ["k"], F.floor(F.col("v") / 50), [F.col("v"), F.col("i")], F.col("v"), "t", inclusive=False)
    running, expect = {}, {}
    for k, v, i in sorted(data):
        expect[(k, i)] = running.get(k, 0)
        running[k] = running.get(k, 0) + v
    assert {(r[0], r[1]): r[2] for r in rows(total, "k", "i", "t")} == expect
