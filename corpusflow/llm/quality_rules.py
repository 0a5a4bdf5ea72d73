"""Host-level quality rules.

Every document gets counts and a base verdict from its whole text. Rule failures are
summed by host (one small partial sum per task, so a hot host costs nothing), the rate of
each host is shrunk with a beta prior fitted to all hosts, and hosts whose shrunk rate is
too high are joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.batches import bounded_batches, slices, space_words
from corpusflow.llm.staging import free_name, staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Weak signs that count against a host, and against a document of a rejected host.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
MEAN_WORD_CHARS = (3.0, 10.0)
#: A host is rejected when its shrunk rate of failing documents is above this.
HOST_LIMIT = 0.5
#: Prior strength where the hosts' rates don't tell one (one host, or no spread).
FLAT_STRENGTH = 2.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    vocabulary = len(ids) + 1
    window = code[:n]
    for j in range(1, WINDOW):
        joined = window * vocabulary + code[j:j + n]
        # Dense ids after each step keep the product inside 64 bits, whatever the length.
        window = np.unique(joined, return_inverse=True)[1]
    counts = np.bincount(window)
    hit = np.flatnonzero(counts[window] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    data = text.encode()
    words = space_words(data)
    blanks = sum(map(text.count, BLANKS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        _repeat_words(words), len(lines),
    )


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and the counts of the whole text (null: no words)."""
    bounded_batches(docs.sparkSession)
    names = [free_name(docs, c) for c in (*COUNTS, "n_lines")]
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(n, T.LongType(), False) for n in names])
    arrow_names = [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                texts = batch.column(text_col).to_pylist()
                table = np.array([text_counts(t or "") for t in texts], np.int64).reshape(len(texts), len(names))
                columns = [*batch.columns, *(pa.array(table[:, i]) for i in range(len(names)))]
                yield pa.RecordBatch.from_arrays(columns, names=arrow_names)

    return docs.mapInArrow(count, schema)


def _base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _weak(n_words, word_chars, n_symbols, n_dup_lines, n_lines):
    """A failing weak rule: symbols, repeated lines or odd word lengths (no words: none fails)."""
    mean = word_chars / F.greatest(n_words, F.lit(1))
    return (n_words > 0) & (
        (n_symbols > MAX_SYMBOLS_PER_WORD * n_words)
        | (n_dup_lines > MAX_DUP_LINE_SHARE * n_lines)
        | (mean < MEAN_WORD_CHARS[0]) | (mean > MEAN_WORD_CHARS[1])
    )


def host_verdicts(judged: DataFrame, host: str, failed: str, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n_docs, n_failed, shrunk_rate and host_rejected.

    The prior is beta(a, b) by the method of moments over the hosts' rates: with mean m and
    variance v above what chance alone gives, a + b = m (1 - m) / v - 1. Without spread
    between the hosts a weak prior of FLAT_STRENGTH documents around the mean is used.
    A null host has no verdict.
    """
    hosts = staged(judged.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"),
    ), "hosts")
    m, v, noise = hosts.agg(
        F.sum("n_failed") / F.sum("n_docs"), F.var_pop(F.col("n_failed") / F.col("n_docs")), F.avg(1 / F.col("n_docs")),
    ).first()
    m, spread = m or 0.0, (v or 0.0) - (m or 0.0) * (1 - (m or 0.0)) * (noise or 0.0)
    strength = max(m * (1 - m) / spread - 1, FLAT_STRENGTH) if spread > 0 else FLAT_STRENGTH
    shrunk = (F.col("n_failed") + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select(
        host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > host_limit).alias("host_rejected"),
    )


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """All rows and columns of `docs`, the five counts, base_failed, host_rejected and kept.

    kept is false where base_failed, and where the host is rejected and the document itself
    shows a weak sign; a spotless document of a rejected host stays. Null and empty texts have
    no words, so they fail the base rule. A null host has no verdict. Repeated rows each get
    their own row. Clashing input columns stay; the new ones are prefixed with "_" then.

    Texts are read twice and never shuffled; only rejected hosts meet the documents, as a
    written table whose size the planner knows (broadcast below its threshold, else a join).
    """
    counted = document_counts(docs, text_col)
    n = {c: counted.columns[len(docs.columns) + i] for i, c in enumerate((*COUNTS, "n_lines"))}
    c = {k: F.col(v) for k, v in n.items()}
    base, bad, kept, weak = (free_name(counted, x) for x in ("base_failed", "host_rejected", "kept", "weak"))
    judged = counted.withColumns({
        base: _base_failed(c["n_words"], c["n_repeat_words"]),
        weak: _weak(c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_lines"]),
    })
    failing = judged.select(F.col(host_col).alias("host"), (F.col(base) | F.col(weak)).alias("failed"))
    rejected = staged(
        host_verdicts(failing, "host", "failed", host_limit).where("host_rejected").select(F.col("host").alias("_bad_host")),
        "rejected-hosts",
    )
    joined = judged.join(rejected, judged[host_col] == rejected["_bad_host"], "left")
    return joined.withColumn(bad, F.col("_bad_host").isNotNull()).withColumn(
        kept, ~F.col(base) & ~(F.col(bad) & F.col(weak))
    ).drop("_bad_host", weak, n["n_lines"])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
keyed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM spots),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, range(0, 3) t(o) WHERE n > 1 GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, d.source, len(d.w)::BIGINT AS n_words,
    length(regexp_replace(coalesce(d.text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(d.lines) - len(list_distinct(d.lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(d.lines) AS n_lines
  FROM words d LEFT JOIN covered c ON d.doc_id = c.doc_id),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words > 0 AND (n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.3::DOUBLE * n_lines
      OR word_chars / greatest(n_words, 1) < 3 OR word_chars / greatest(n_words, 1) > 10) AS weak
  FROM counted),
hosts AS (
  SELECT source, count(*) AS n, sum((base_failed OR weak)::INT) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT sum(f) / sum(n) AS m, var_pop(f / n) AS v, avg(1 / n) AS noise FROM hosts),
prior AS (
  SELECT m, CASE WHEN v - m * (1 - m) * noise > 0
    THEN greatest(m * (1 - m) / (v - m * (1 - m) * noise) - 1, 2.0::DOUBLE) ELSE 2.0::DOUBLE END AS s FROM moments),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (weak AND source IS NOT NULL AND source IN (SELECT source FROM bad)) AS kept
FROM judged
"""
