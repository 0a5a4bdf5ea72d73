"""Web pages and search results."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import schemas as S
from corpusflow.functions.text import SPACE, strip
from corpusflow.operators.ordered import first_rows

TRUNCATED = "... [truncated]"


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def page_text(page: Column) -> Column:
    """Visible text: comments, scripts and styles dropped, tags to spaces, entities decoded.

    Everything runs in the JVM except entity decoding, which sees only texts with an ampersand.
    """
    bare = F.regexp_replace(page, r"(?s)<!--.*?-->", " ")
    # An element that is never closed hides the rest of the page.
    bare = F.regexp_replace(bare, r"(?is)<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    # Quoted attribute values may contain ">".
    bare = F.regexp_replace(bare, r"""(?s)<[!/?a-zA-Z](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*>""", " ")
    coded = F.contains(bare, F.lit("&"))
    decoded = F.when(coded, _unescape(F.when(coded, bare))).otherwise(bare)
    return strip(F.regexp_replace(decoded, f"{SPACE}+", " "))


def strip_html(page: Column, max_chars: int = S.SCRAPE_CHARS) -> Column:
    """Visible text cut at ``max_chars`` with a mark."""
    text = page_text(page)
    return F.when(
        F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit(TRUNCATED))
    ).otherwise(text)


def normalise_web_results(results: DataFrame, max_results: int = 5, scraped: DataFrame | None = None) -> DataFrame:
    """Search hits as numbered web sources.

    ``results``: query_id, rank, title, url, content, score (a number; text is no score). ``scraped``
    (url, text) marks the first source of a query whose page was read.
    """
    # Only numbers count as scores: a score given as text is none.
    kind = results.schema["score"].dataType
    number = F.col("score").cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    top = first_rows(results, ["query_id"], [F.col("rank")], max_results, out="index")
    sources = top.select(
        "query_id", "index", F.lit("web").alias("type"),
        F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), "url",
        F.substring(F.coalesce("content", F.lit("")), 1, S.SNIPPET_CHARS).alias("snippet"),
        F.round(number, 4).alias("score"),
    )
    if scraped is None:
        return sources.withColumn("scraped", F.lit(False))
    # Only the addresses of first hits are looked up, so the page table is scanned, not shuffled whole.
    read = scraped.select("url").distinct().withColumn("_read", F.lit(True))
    return sources.join(read, "url", "left").withColumn(
        "scraped", (F.col("index") == 1) & F.coalesce("_read", F.lit(False))
    ).drop("_read")
