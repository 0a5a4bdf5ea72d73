"""Conversation listing, search and message retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.text import DAY_LABELS, ilike_contains, relative_day, search_snippet, search_term
from corpusflow.operators.ordered import first_rows, slab_row_number

def _list_order() -> list[Column]:
    return [F.col("pinned").desc(), F.col("pinned_at").desc_nulls_last(), F.col("updated_at").desc(),
            F.col("conversation_id")]


def conversations_with_documents(conversations: DataFrame, documents: DataFrame) -> DataFrame:
    """Left join on (document, owner): a document of somebody else gives a null name."""
    names = documents.select("document_id", "user_id", F.col("name").alias("document_name"))
    return conversations.join(names, ["document_id", "user_id"], "left")


def with_message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"))
    return conversations.join(counts, "conversation_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0))
    )


def list_conversations(conversations: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """All conversations with document name and message count, pinned first, newest first."""
    full = with_message_counts(conversations_with_documents(conversations, documents), messages)
    return full.orderBy("user_id", *_list_order())


def conversation_ranks(conversations: DataFrame) -> DataFrame:
    """Position of each conversation in its owner's list.

    Slabs follow the list order (pinned, pinned day, updated day), so an owner with a third of
    all conversations is numbered in as many tasks as it has active days.
    """
    far = F.lit(1 << 30)
    unpinned = F.when(F.col("pinned"), 0).otherwise(1)
    pinned_day = F.coalesce(-F.unix_date(F.to_date("pinned_at")), far)
    # Rows with a pinned time are ordered by that time first, so their slab ends at its day.
    updated_day = F.when(F.col("pinned_at").isNull(), -F.unix_date(F.to_date("updated_at"))).otherwise(0)
    slab = F.struct(
        unpinned.alias("a"), pinned_day.alias("b"), F.coalesce(updated_day, far).alias("c")
    )
    return slab_row_number(conversations, ["user_id"], slab, _list_order(), "list_rank")


def messages_owned(messages: DataFrame, conversations: DataFrame, user_id: str | None = None) -> DataFrame:
    """Messages reachable through an owned conversation, with the owner."""
    owners = conversations.select("conversation_id", "user_id")
    if user_id is not None:
        owners = owners.filter(F.col("user_id") == user_id)
    return messages.join(owners, "conversation_id")


def sources_json(sources: DataFrame) -> DataFrame:
    """``(message_id, sources)``: citation metadata in position order."""
    pairs = F.array_sort(F.collect_list(F.struct("position", "metadata")))
    return sources.groupBy("message_id").agg(
        F.transform(pairs, lambda p: p["metadata"]).alias("sources")
    )


def get_messages(messages: DataFrame, conversations: DataFrame, sources: DataFrame) -> DataFrame:
    """Owned messages with their ordered citations (an empty array without any), oldest first."""
    joined = messages_owned(messages, conversations).join(sources_json(sources), "message_id", "left")
    return joined.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).orderBy(
        "conversation_id", "created_at", "message_id"
    )


def search_hits(terms: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Rank, match place and latest matching message per (user, term, conversation).

    Title hits and message hits are found separately, each on the side that holds the text, so
    no term is paired with a message it does not match, and only hits are shuffled afterwards.
    """
    asked = terms.select("user_id", search_term(F.col("term")).alias("term")).filter(
        "term is not null"
    ).distinct()
    titles = conversations.select("conversation_id", "user_id", "title")
    in_title = titles.join(asked, (titles["user_id"] == asked["user_id"]) & ilike_contains(titles["title"], asked["term"]))
    title_hits = in_title.select(
        titles["user_id"], asked["term"], "conversation_id", F.lit(2).alias("rank"),
        F.lit(None).cast("string").alias("content"),
    )
    owned = messages_owned(messages, conversations.select("conversation_id", "user_id"))
    in_message = owned.join(asked, (owned["user_id"] == asked["user_id"]) & ilike_contains(owned["content"], asked["term"]))
    message_hits = in_message.select(
        owned["user_id"], asked["term"], "conversation_id", F.lit(1).alias("rank"),
        F.struct("created_at", "message_id").alias("at"), "content",
    )
    hits = message_hits.unionByName(title_hits.withColumn("at", F.lit(None).cast(message_hits.schema["at"].dataType)))
    return hits.groupBy("user_id", "term", "conversation_id").agg(
        F.max("rank").alias("rank"), F.max_by("content", "at").alias("snippet")
    ).withColumn("match_source", F.when(F.col("rank") == 2, "title").otherwise("message"))


def search_conversations(
    terms: DataFrame, conversations: DataFrame, messages: DataFrame, documents: DataFrame,
    limit: int = S.SEARCH_LIMIT,
) -> DataFrame:
    """First ``limit`` conversations per (user, term): pinned, then title hits, then newest."""
    hits = search_hits(terms, conversations, messages)
    matched = hits.join(conversations, ["conversation_id", "user_id"])
    order = [F.col("pinned").desc(), F.col("rank").desc(), F.col("updated_at").desc(), F.col("conversation_id")]
    top = first_rows(matched, ["user_id", "term"], order, limit, out="position")
    full = with_message_counts(conversations_with_documents(top, documents), messages)
    cut = F.when(F.length("snippet") > 0, search_snippet(F.col("snippet"), F.col("term"))).otherwise(F.col("snippet"))
    return full.withColumn("snippet", cut)


def day_groups(conversations: DataFrame, as_of: Column) -> DataFrame:
    """Conversations with their day label and its place in the label order.

    The groups stay rows: a label like ``Older`` may hold most of the table, so it is never
    gathered into one list.
    """
    label = relative_day(F.coalesce("updated_at", "created_at"), as_of)
    place = F.array_position(F.array(*[F.lit(x) for x in DAY_LABELS]), F.col("label"))
    return conversations.withColumn("label", label).withColumn("label_order", place)


def retrieval_hint(sources: DataFrame) -> DataFrame:
    """Label per message telling where its sources came from; null for other kinds only."""
    flags = sources.groupBy("message_id").agg(
        F.bool_or(F.col("type") == "document").alias("doc"), F.bool_or(F.col("type") == "web").alias("web")
    )
    label = (
        F.when(F.col("doc") & F.col("web"), "Used your documents + web")
        .when(F.col("doc"), "Used your documents").when(F.col("web"), "Searched the web")
    )
    return flags.select("message_id", label.alias("hint"))


def route_summary(turns: DataFrame) -> DataFrame:
    return turns.groupBy("route", "mode", "finish_reason").agg(F.count("*").alias("turns"))
