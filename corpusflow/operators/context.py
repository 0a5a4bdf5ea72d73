"""Context, history and prompt assembly under character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import schemas as S
from corpusflow.functions.text import strip
from corpusflow.operators.ordered import first_rows, slab_running_sum

# "[i] " plus the line break: no context block is shorter than this.
SHORTEST_BLOCK = 5
# What stands in a prompt for missing parts, and the heading of a page that was read.
NO_HISTORY = "(no previous messages)"
NO_PASSAGES = "(no relevant passages found)"
NO_WEB_RESULTS = "(no web results found)"
SCRAPED_HEADING = "\n\nFull text of the most relevant page:\n"
# Fixed value: notice given when a question needs live figures and the search found nothing.
NO_CURRENT_DATA = (
    "\n\nNo current web results could be retrieved for this question. Tell the user "
    "that live information is unavailable right now and that any figure you might "
    "recall could be out of date. Do not state a specific current figure."
)


def source_header(index: Column, type_: Column, title: Column, url: Column, name: Column, page: Column) -> Column:
    web = F.concat(
        F.lit("["), index.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit(" - "),
        F.coalesce(url, F.lit("")),
    )
    # Page 0 counts as "no page".
    where = F.when(page > 0, F.concat(F.lit(", page "), page.cast("string"))).otherwise(F.lit(""))
    document = F.concat(
        F.lit("["), index.cast("string"), F.lit("] "), F.coalesce(name, title, F.lit("")), where
    )
    return F.when(type_ == "web", web).otherwise(document)


def context_blocks(sources: DataFrame, max_chars: int = S.CONTEXT_CHARS, start_index: int | str = 1) -> DataFrame:
    """Numbered blocks per query that fit the budget, stopping at the first overflow.

    Adds ``number``, ``block`` and ``used_chars``. ``start_index`` is a number or a column name.
    No block is shorter than ``SHORTEST_BLOCK``, so rows ranked past ``max_chars / SHORTEST_BLOCK``
    cannot fit and are pruned before the shuffle.
    """
    have = set(sources.columns)

    def col(name: str, dtype: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(dtype)

    ranked = first_rows(
        sources, ["query_id"], [F.col("index")], max_chars // SHORTEST_BLOCK + 1, out="_offset"
    )
    first = F.col(start_index) if isinstance(start_index, str) else F.lit(start_index)
    numbered = ranked.withColumn("number", (F.col("_offset") - 1 + first).cast("int"))
    header = source_header(
        F.col("number"), col("type"), col("title"), col("url"), col("document_name"), col("page", "int")
    )
    web_body = F.coalesce(col("snippet"), F.lit(""))
    body = F.when(col("type") == "web", web_body).otherwise(
        F.coalesce(col("content"), col("snippet"), F.lit(""))
    )
    running = Window.partitionBy("query_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("block", F.concat(header, F.lit("\n"), body))
        .withColumn("used_chars", F.sum(F.length("block")).over(running))
        .filter(F.col("used_chars") <= max_chars)
        .drop("_offset")
    )


def ordered_concat(value: str, order: str, separator: str) -> Column:
    """Aggregate: values joined by a separator in the order of another column."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("_v"))))
    return F.array_join(F.transform(pairs, lambda p: p["_v"]), separator)


def build_context(sources: DataFrame, max_chars: int = S.CONTEXT_CHARS, start_index: int | str = 1) -> DataFrame:
    """``(query_id, context)``: the blocks that fit, joined by blank lines."""
    blocks = context_blocks(sources, max_chars, start_index)
    return blocks.groupBy("query_id").agg(ordered_concat("block", "number", "\n\n").alias("context"))


def join_context_plain(sources: DataFrame, k: int = S.RETRIEVAL_K) -> DataFrame:
    """Older form: contents of the ``k`` best sources joined by blank lines, unnumbered."""
    top = first_rows(sources, ["query_id"], [F.col("index")], k)
    return top.groupBy("query_id").agg(ordered_concat("content", "index", "\n\n").alias("context"))


def web_listing(results: DataFrame, max_results: int = 5) -> DataFrame:
    """Older form of the first search results: title, address and 500 characters each, ruled off."""
    line = F.concat(
        F.lit("\n            Title : "), F.coalesce("title", F.lit("")),
        F.lit("\n            URL : "), F.col("url"),
        F.lit("\n            Content : "), F.substring(F.col("content"), 1, 500),
        F.lit("\n            "),
    )
    top = first_rows(results, ["query_id"], [F.col("index")], max_results)
    return top.withColumn("_line", line).groupBy("query_id").agg(
        ordered_concat("_line", "index", "\n---\n").alias("listing")
    )


def _latest(messages: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("message_id").desc()]
    return first_rows(messages, keys, order, n, out="_back")


def tail_messages(messages: DataFrame, n: int, key: str = "conversation_id") -> DataFrame:
    """Last ``n`` messages per conversation."""
    return _latest(messages, [key], n).drop("_back")


def build_history(
    messages: DataFrame,
    key: str = "conversation_id",
    max_messages: int = S.HISTORY_MESSAGES,
    max_chars: int = S.HISTORY_CHARS,
    max_chars_per_message: int = S.HISTORY_CHARS_PER_MESSAGE,
) -> DataFrame:
    """History window: last non-blank messages, each cut, dropped from the oldest until they fit.

    The newest message always stays. The rank filter runs before the shuffle, so a conversation
    of any length contributes at most ``max_messages`` rows per task.
    """
    spoken = messages.filter(F.length(strip(F.col("content"))) > 0)
    recent = _latest(spoken, [key], max_messages)
    text = F.when(
        F.length("content") > max_chars_per_message,
        F.concat(F.substring(F.col("content"), 1, max_chars_per_message), F.lit(" ...")),
    ).otherwise(F.col("content"))
    newer = Window.partitionBy(key).orderBy("_back").rowsBetween(Window.unboundedPreceding, 0)
    return (
        recent.withColumn("content", text)
        .withColumn("_chars", F.sum(F.length("content")).over(newer))
        .filter((F.col("_back") == 1) | (F.col("_chars") <= max_chars))
        .drop("_chars")
        .withColumnRenamed("_back", "recency")
    )


def format_history(
    history: DataFrame, key: str = "conversation_id",
    max_messages: int = S.HISTORY_MESSAGES, max_chars: int = S.PROMPT_HISTORY_CHARS,
) -> DataFrame:
    """``(key, history)``: the last turns as ``User:`` / ``Assistant:`` lines."""
    recent = _latest(history, [key], max_messages)
    clean = strip(F.coalesce("content", F.lit("")))
    cut = F.when(
        F.length(clean) > max_chars, F.concat(F.substring(clean, 1, max_chars), F.lit(" ..."))
    ).otherwise(clean)
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    lines = recent.withColumn("_line", F.when(F.length(clean) > 0, F.concat(speaker, cut))).withColumn(
        "_order", -F.col("_back")
    )
    joined = lines.groupBy(key).agg(ordered_concat("_line", "_order", "\n").alias("history"))
    return joined.withColumn("history", F.coalesce(F.nullif("history", F.lit("")), F.lit(NO_HISTORY)))


# Spoken messages of one conversation that share a task; the last few of a block are repeated in the next.
HISTORY_BLOCK = 4096


def turn_histories(
    messages: DataFrame,
    key: str = "conversation_id",
    max_messages: int = S.HISTORY_MESSAGES,
    max_chars: int = S.HISTORY_CHARS,
    max_chars_per_message: int = S.HISTORY_CHARS_PER_MESSAGE,
    block: int = HISTORY_BLOCK,
) -> DataFrame:
    """``(key, message_id, history)``: for every message the history window as it was before it.

    ``history`` is an array of (role, content), oldest first: the last ``max_messages`` non-blank
    messages, each cut, dropped from the oldest until they fit; the newest always stays. One bounded
    frame per message instead of a row per message and earlier message. Non-blank messages are
    numbered by days, and the frame runs per block of numbers, so a conversation of any length is
    spread over its blocks. Messages of one time are taken in the order of their ids.
    """
    content = F.when(
        F.length("content") > max_chars_per_message,
        F.concat(F.substring(F.col("content"), 1, max_chars_per_message), F.lit(" ...")),
    ).otherwise(F.col("content"))
    blank = F.coalesce(F.length(strip(F.col("content"))), F.lit(0)) == 0
    narrow = messages.select(
        key, "message_id", "created_at", F.when(~blank, F.struct("role", content.alias("content"))).alias("_said")
    )
    numbered = slab_running_sum(
        narrow, [key], F.to_date("created_at"), [F.col("created_at"), F.col("message_id")],
        F.col("_said").isNotNull().cast("int"), "_n",
    )
    home = F.floor(F.col("_n") / block)
    repeated = F.col("_said").isNotNull() & (F.col("_n") % block >= block - max_messages)
    spread = numbered.select(
        key, "message_id", "_said", "_n", home.alias("_home"),
        F.explode(F.when(repeated, F.array(home, home + 1)).otherwise(F.array(home))).alias("_block"),
    )
    order = Window.partitionBy(key, "_block").orderBy("_n")
    # A blank message has the number of the spoken one before it, which belongs to its history.
    spoken_before = F.collect_list("_said").over(order.rangeBetween(-max_messages, -1))
    blank_before = F.collect_list("_said").over(order.rangeBetween(1 - max_messages, 0))
    framed = spread.withColumn(
        "_past", F.reverse(F.when(F.col("_said").isNotNull(), spoken_before).otherwise(blank_before))
    ).filter("_block = _home")

    def fits(_, i):
        newest = F.slice("_past", F.lit(1), i + 1)
        return (i == 0) | (F.aggregate(newest, F.lit(0), lambda n, m: n + F.length(m["content"])) <= max_chars)

    return framed.select(key, "message_id", F.reverse(F.filter("_past", fits)).alias("history"))


def format_turns(history: Column, max_chars: int = S.PROMPT_HISTORY_CHARS) -> Column:
    """A history array as ``User:`` / ``Assistant:`` lines."""

    def line(turn: Column) -> Column:
        clean = strip(F.coalesce(turn["content"], F.lit("")))
        cut = F.when(F.length(clean) > max_chars, F.concat(F.substring(clean, 1, max_chars), F.lit(" ..."))).otherwise(clean)
        return F.when(F.length(clean) > 0, F.concat(F.when(turn["role"] == "user", "User: ").otherwise("Assistant: "), cut))

    return F.coalesce(F.nullif(F.array_join(F.transform(history, line), "\n"), F.lit("")), F.lit(NO_HISTORY))


# Layout of the question part of the prompt, one per retrieval mode.
_HISTORY_PART = "Conversation so far (for pronouns and follow-up context only):\n{history}\n\n"
PROMPT_LAYOUTS = {
    "document": _HISTORY_PART
    + "Retrieved context:\n{context}\n\nQuestion:\n{question}\n\nAnswer the question from the retrieved context.",
    "web": _HISTORY_PART
    + "Web research:\n{research}\n\nQuestion:\n{question}\n\nAnswer the question from the web research.",
    "hybrid": _HISTORY_PART
    + "Document research:\n{context}\n\nWeb research:\n{research}\n\nQuestion:\n{question}\n\n"
    + "Answer the question using both sources.",
    "llm": _HISTORY_PART + "Question:\n{question}",
}


def _filled(layout: str, values: dict[str, Column]) -> Column:
    parts = []
    for piece in layout.replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        if piece.startswith("{"):
            parts.append(values[piece.strip("{}")])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def web_context_with_extras(context: Column, scraped: Column, fresh: Column, web_count: Column) -> Column:
    """Web context plus the page text, or the notice that no current data exists."""
    base = F.coalesce(context, F.lit(""))
    page = F.when(
        F.length(scraped) > 0,
        F.concat(F.lit(SCRAPED_HEADING), F.substring(scraped, 1, S.SCRAPE_CHARS)),
    ).otherwise(F.lit(""))
    notice = F.when(fresh & (F.coalesce(web_count, F.lit(0)) == 0), F.lit(NO_CURRENT_DATA)).otherwise(F.lit(""))
    return F.concat(base, page, notice)


def assemble_prompts(turns: DataFrame, layouts: dict[str, str] | None = None) -> DataFrame:
    """Prompt text per query.

    ``turns``: query_id, mode, question, history, document_context, web_context (nulls allowed).
    """
    layouts = layouts or PROMPT_LAYOUTS

    def context(name: str, placeholder: str) -> Column:
        cut = F.substring(F.coalesce(F.col(name), F.lit("")), 1, S.CONTEXT_CHARS)
        return F.coalesce(F.nullif(cut, F.lit("")), F.lit(placeholder))

    values = {
        "history": F.coalesce(F.col("history"), F.lit(NO_HISTORY)),
        "context": context("document_context", NO_PASSAGES),
        "research": context("web_context", NO_WEB_RESULTS),
        "question": F.col("question"),
    }
    prompt = F.when(F.lit(False), F.lit(None))
    for mode in ("llm", "document", "web"):
        prompt = prompt.when(F.col("mode") == mode, _filled(layouts[mode], values))
    prompt = prompt.otherwise(_filled(layouts["hybrid"], values))
    return turns.select("query_id", "mode", prompt.alias("prompt"))
