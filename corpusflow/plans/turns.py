"""Question tables to prompt tables and turn reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow import views as V
from corpusflow.functions.text import clean_rewrite, generate_title
from corpusflow.operators import context, folds, retrieval, routing
from corpusflow.plans import ingest
from corpusflow.session import bounded_batches, staged
from corpusflow.sources.web import normalise_web_results, page_text, strip_html

# --- operators over question tables ------------------------------------------------


def hybrid_retrieve(
    questions: DataFrame, chunks: DataFrame, documents: DataFrame, web: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Document and web sources per question, each only where the mode asks for it.

    Weak document matches may stand in for questions about the documents only, not in hybrid mode.
    """
    wanted = questions.filter(F.col("mode").isin("document", "hybrid")).withColumn(
        "allow_weak", F.col("mode") == "document"
    )
    documents_found = retrieval.retrieve(wanted, chunks, documents)
    searching = questions.filter(F.col("mode").isin("web", "hybrid")).select("query_id")
    return documents_found, web.join(searching, "query_id", "left_semi")


def assemble_turn_prompts(
    questions: DataFrame, messages: DataFrame, document_sources: DataFrame, web_sources: DataFrame,
    scraped: DataFrame | None = None,
) -> DataFrame:
    """Prompt per question. A question is a message: its history is the bounded window before it.

    ``questions``: query_id (the message id), conversation_id, created_at, question, mode, requires_fresh_data.
    ``scraped``: query_id, scraped (text of the page read for the question).
    """
    past = context.turn_histories(messages)
    history = past.select(F.col("message_id").alias("query_id"), context.format_turns(F.col("history")).alias("history"))
    counts = document_sources.groupBy("query_id").agg(F.count("*").alias("_n"))
    from_documents = context.build_context(document_sources).withColumnRenamed("context", "document_context")
    numbered = web_sources.join(counts, "query_id", "left").withColumn("_start", F.coalesce("_n", F.lit(0)) + 1)
    from_web = context.build_context(numbered, start_index="_start").withColumnRenamed("context", "_web")
    web_counts = web_sources.groupBy("query_id").agg(F.count("*").alias("_web_count"))
    turns = questions
    for part in (history, from_documents, from_web, web_counts):
        turns = turns.join(part, "query_id", "left")
    page = F.lit(None).cast("string")
    if scraped is not None:
        turns = turns.join(scraped, "query_id", "left")
        page = F.when(F.col("_web_count") > 0, F.col("scraped"))
    full = context.web_context_with_extras(
        F.col("_web"), page, F.coalesce("requires_fresh_data", F.lit(False)), F.col("_web_count")
    )
    return context.assemble_prompts(turns.withColumn("web_context", full))


def turn_report(turns: DataFrame, answers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per turn: route, mode, sources used, finish reason, rewrite flag, new title.

    ``turns``: message_id, answer_id, message, route, rewritten, is_new; ``answers``: message_id,
    finish_reason, error_code, content; ``sources``: query_id, type.
    """
    used = sources.groupBy(F.col("query_id").alias("answer_id")).agg(
        F.count_if(F.col("type") == "document").alias("document_sources"),
        F.count_if(F.col("type") == "web").alias("web_sources"),
    )
    outcome = answers.select(
        F.col("message_id").alias("answer_id"), "finish_reason", "error_code",
        (F.length(F.trim("content")) > 0).alias("has_answer"),
    )
    joined = turns.join(outcome, "answer_id", "left").join(used, "answer_id", "left")
    query = clean_rewrite(F.col("message"), F.col("rewritten"))
    return joined.select(
        "message_id", "route", routing.retrieval_mode(F.col("route")).alias("mode"),
        F.coalesce("document_sources", F.lit(0)).alias("document_sources"),
        F.coalesce("web_sources", F.lit(0)).alias("web_sources"), "finish_reason", "error_code", "has_answer",
        (query != F.col("message")).alias("rewritten"),
        F.when(F.col("is_new"), generate_title(F.col("message"))).alias("new_title"),
    )


# --- the same over the model tables --------------------------------------------------


def web_hits(spark, folder) -> DataFrame:
    """Crawled pages as search results: whole visible text, ordered by page id within the query."""
    return V.web_results(spark, folder).select(
        "query_id", F.col("page_id").alias("rank"), "title", "url", page_text(F.col("html")).alias("content"), "score"
    )


def web_sources(spark, folder) -> DataFrame:
    read = V.table(spark, folder, "pages").filter("url like 'https:%'").select("url")
    return normalise_web_results(web_hits(spark, folder), scraped=read)


def routed_turns(spark, folder) -> DataFrame:
    return routing.route_messages(V.questions_asked(spark, folder))


def turn_outcomes(spark, folder) -> DataFrame:
    """Route of each question with the outcome of the answer that follows it."""
    asked = routed_turns(spark, folder).select(
        (F.col("message_id") + 1).alias("message_id"), "conversation_id", "user_id", "route",
        routing.retrieval_mode(F.col("route")).alias("mode"),
    )
    answers = folds.assemble_answers(V.answer_events(spark, folder))
    return asked.join(answers, "message_id").select(
        "message_id", "conversation_id", "user_id", "route", "mode", "finish_reason",
        (F.length(F.trim("content")) > 0).alias("has_answer"), F.col("error_code").isNotNull().alias("has_error"),
    )


def turn_report_query(spark, folder) -> DataFrame:
    asked = routed_turns(spark, folder).select(
        "message_id", (F.col("message_id") + 1).alias("answer_id"), "message", "route",
        F.expr("if(message_id % 4 = 0, concat(message, '?'), message)").alias("rewritten"),
        (F.col("position") == 0).alias("is_new"),
    )
    answers = folds.assemble_answers(V.answer_events(spark, folder))
    return turn_report(asked, answers, V.message_sources(spark, folder))


def turn_questions(spark, folder) -> DataFrame:
    """Every question asked in a conversation, with a vector and its mode."""
    asked = routed_turns(spark, folder)
    times = V.messages(spark, folder).select("message_id", "created_at")
    vectors = V.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("_vec"), "embedding", F.expr("concat('m', label % 2)").alias("embedding_model")
    )
    numbered = asked.join(times, "message_id").withColumn("_vec", F.col("message_id") % V.rows_in(spark, folder, "embeddings"))
    return numbered.join(vectors, "_vec").select(
        F.col("message_id").alias("query_id"), "conversation_id", "user_id", "created_at",
        F.col("message").alias("question"), routing.retrieval_mode(F.col("route")).alias("mode"),
        "requires_fresh_data", "embedding", "embedding_model",
    )


def prompts_of_turns(spark, folder) -> DataFrame:
    """Prompts of all questions; search results are those of the question's group of pages."""
    # Python steps read whole pages here.
    bounded_batches(spark)
    # Seven branches read the routed questions; they are routed once.
    questions = staged(turn_questions(spark, folder), "questions")
    # Five pages a group, so that every page is a result.
    groups = F.greatest(F.floor((V.rows_in(spark, folder, "pages") + 4) / 5), F.lit(1).cast("bigint"))
    grouped = V.web_results(spark, folder).withColumn("_group", F.col("page_id") % groups)
    found = grouped.select(
        F.col("_group").alias("query_id"), F.col("page_id").alias("rank"), "title", "url", page_text(F.col("html")).alias("content"), "score",
    )
    # Five results per group are picked before the groups meet the questions.
    top = normalise_web_results(found).withColumnRenamed("query_id", "_group")
    asking = questions.select("query_id", (F.col("query_id") % groups).alias("_group"), "mode")
    web = asking.join(top, "_group").drop("_group", "mode")
    documents_found, web_found = hybrid_retrieve(questions, V.chunks(spark, folder), V.documents(spark, folder), web)
    # The page of the first hit is read: its visible text up to the length limit, not the short snippet.
    first = grouped.groupBy("_group").agg(F.min_by("html", "page_id").alias("html"))
    scraped = asking.join(first, "_group").select("query_id", strip_html(F.col("html")).alias("scraped"))
    return assemble_turn_prompts(questions, V.messages(spark, folder), documents_found, web_found, scraped)


def ingest_query(spark, folder) -> DataFrame:
    """Every upload judged against the whole library, half of them sent by the next user."""
    files = V.uploads(spark, folder).withColumn(
        "user_id", F.expr("concat('src', (cast(substr(user_id, 4) as int) + document_id % 2) % 20)")
    ).drop("document_id")
    out = ingest.ingest_documents(files, V.documents(spark, folder))
    states = out["documents"].select("document_id", "status", "error_code", "chunk_count")
    return out["verdicts"].select("document_id", "user_id", "name", "code", "action").join(
        states, "document_id", "left"
    ).select(
        "user_id", "name", "code", "action",
        F.when(F.col("action").isin("new", "replace"), F.col("status")).alias("status"),
        F.when(F.col("action").isin("new", "replace"), F.col("error_code")).alias("error_code"),
    )
