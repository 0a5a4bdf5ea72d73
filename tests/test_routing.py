import pytest
from pyspark.sql import functions as F

from corpusflow.operators import routing
from tests.conftest import rows

WEB = [
    "The new movie of spider man brand new day collection",
    "What is the latest box office collection of Spider-Man: Brand New Day?",
    "What are the latest news updates about Spider-Man: Brand New Day?", "box office collection of Avatar 3",
    "what is the current price of bitcoin", "todays weather in Karachi", "latest news on the election",
    "recent developments in fusion power", "what is the opening weekend gross of Dune 3",
    "lifetime collection of Pushpa 2", "how much has the movie grossed", "total earnings of the film so far",
    "current exchange rate for the pound", "what is the score right now", "What are the latest AI developments?",
    "What is happening in AI today?", "Any news about the Mistral release?", "Who won the election?",
]
LLM = [
    "What is a transformer model?", "Explain gradient descent", "Write a function that reverses a string", "hello",
    "thanks!", "What is RAG?", "Define idempotency", "hi", "who are you", "In 2025 maybe nothing",
]
DOCUMENTS = [
    "summarize my document", "what does the PDF say about attention", "what is on page 4",
    "according to the report, what was the conclusion", "Summarise the document",
    "I uploaded a contract - what is the notice period?", "What does the paper say on page 12?",
]
HYBRID = [
    "Compare my uploaded research paper with the latest research.",
    "How does my document compare with current best practice?", "Compare my report with recent industry standards",
]


def routed(spark, cases):
    schema = "message_id long, message string, has_documents boolean, has_attachment boolean, web_enabled boolean, force_web boolean"
    df = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], schema)
    out = routing.route_messages(df).orderBy("message_id")
    return rows(out, "route", "confidence", "reason", "requires_fresh_data")


def test_message_tables(spark):
    for expected, messages, has_documents in (("web", WEB, False), ("llm", LLM, False), ("documents", DOCUMENTS, True), ("hybrid", HYBRID, True)):
        got = routed(spark, [(m, has_documents, False, True, False) for m in messages])
        assert [(m, g[0]) for m, g in zip(messages, got)] == [(m, expected) for m in messages]


def test_flags_and_availability(spark):
    cases = [
        ("explain how photosynthesis works", False, False, True, True),
        ("what does this say about the topic", True, True, True, True),
        ("latest news", False, False, False, True),
        ("summarise this", True, True, True, False),
        ("compare this with the latest research", True, True, True, False),
        ("What does my document say about X?", False, False, True, False),
        ("the thing from before", True, False, True, False),
        ("the thing from before", False, False, True, False),
        ("", False, False, True, False),
        ("explain the current score", False, False, False, False),
        ("Compare my report with recent work", True, False, False, False),
        ("étoday is no word", False, False, True, False),
    ]
    got = routed(spark, cases)
    assert [g[0] for g in got] == [
        "web", "hybrid", "llm", "documents", "hybrid", "llm", "documents", "llm", "llm", "llm", "documents", "web",
    ]
    assert got[0][1:] == (1.0, "the user asked for a web search", True)
    assert got[3][1] == 0.99 and got[3][3] is None
    assert got[5][2] == "refers to the user documents; no documents available"
    assert got[6][1] == 0.4 and got[7][1] == 0.5
    assert got[9][3] is True
    assert got[10][2].endswith("; web search unavailable")


def test_labels_answer_for_open_messages(spark):
    df = spark.createDataFrame([(1, "the thing from before"), (2, "hello"), (3, "the thing there")], "message_id long, message string")
    labels = spark.createDataFrame([(1, " Web. "), (2, "web"), (3, "unsure")], "message_id long, label string")
    out = routing.route_messages(df, labels=labels).orderBy("message_id")
    assert rows(out, "route", "confidence") == [("web", 0.7), ("llm", 0.99), ("llm", 0.5)]


@pytest.mark.parametrize("message,fresh", [
    ("latest news", True), ("total revenue this year", True), ("write a haiku about autumn", False), ("summarize my document", False),
])
def test_needs_fresh_data(spark, message, fresh):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(routing.needs_fresh_data(F.col("m"))).first()[0] is fresh


def test_retrieval_mode(spark):
    df = spark.createDataFrame([(r,) for r in ("documents", "web", "hybrid", "llm")], "r string")
    assert [r[0] for r in rows(df.select(routing.retrieval_mode(F.col("r"))))] == ["document", "web", "hybrid", "llm"]
