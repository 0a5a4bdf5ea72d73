"""Substring dedup with repeated-phrase automata.

First the passages that recur are confirmed: windows of 13 words whose sequence also starts
in a document with a smaller id. Then the documents, dealt out by id, are taken in shards of
bounded size: the recurring passages of a shard are compiled into one Aho-Corasick automaton
over words, and all its documents are streamed through it to locate every occurrence. So
each text passes one automaton, however many passages the corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.batches import release_memory, slices, space_words, text_of, window_hashes, word_hashes
from corpusflow.llm.first_seen import runs_of, seen_before, with_seen
from corpusflow.llm.staging import free_name

WINDOW = 13
#: Words of one pattern at most. A longer passage is several patterns that share window - 1 words, so each of its
#: windows lies in one; the automaton's depth stays bounded however long a text is.
PASSAGE_WORDS = 4096


def text_window_keys(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all word windows of each text, and how many each text has."""
    words = [space_words(t) for t in texts]
    counts = np.fromiter((max(0, len(w) - window + 1) for w in words), np.int64, len(words))
    found = [window_hashes(word_hashes(w), window) for w in words if len(w) >= window]
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


class _WindowKeys:
    def __init__(self, window: int):
        self.window = window

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return text_window_keys(texts, self.window)


#: Distinct words that code points can stand for, surrogates and 0 left out.
LETTERS = 0x10FFFF - 0x800


def _letter(number: int) -> str:
    """A code point for the n-th distinct word; surrogates are left out, 0 stands for other words."""
    return chr(number if number <= 0xD7FF else number + 0x800)


class _Alphabet:
    """Words as numbers from 1 on, and sequences of them in the form that the automaton takes.

    Strings, a code point a word; for a shard of more words than there are code points, sequences of numbers.
    """

    def __init__(self, numbers: dict[bytes, int]):
        self.numbers, self.wide = numbers, len(numbers) > LETTERS
        self.letters = None if self.wide else {w: _letter(n) for w, n in numbers.items()}

    def automaton(self) -> ahocorasick.Automaton:
        return ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE) if self.wide else ahocorasick.Automaton()

    def sequence(self, words: list[bytes]):
        if self.wide:
            return tuple(self.numbers.get(w, 0) for w in words)
        return "".join([self.letters.get(w, "\0") for w in words])


def shard_spans(ids: list[int | None], words: list[list[bytes]], seen: list[np.ndarray | None], window: int) -> list[np.ndarray]:
    """Spans of words to remove from each document of a shard.

    seen: the confirmed window keys of each document. A passage is a run of confirmed windows;
    with it stands the smallest id that it was confirmed for, because only documents from that
    id on are known to have a smaller owner for all its windows.
    """
    numbers: dict[bytes, int] = {}
    confirmed: list[tuple[int, list[bytes]]] = []
    for owner, own, keys in zip(ids, words, seen, strict=True):
        if keys is None or len(own) < window:
            continue
        flags = np.isin(window_hashes(word_hashes(own), window), keys)
        for start, stop in runs_of(flags):
            for at in range(start, stop, PASSAGE_WORDS - window + 1):
                passage = own[at:min(at + PASSAGE_WORDS, stop + window - 1)]
                for w in passage:
                    numbers.setdefault(w, len(numbers) + 1)
                confirmed.append((owner, passage))
    if not confirmed:
        return [np.empty((0, 2), np.int64)] * len(words)
    alphabet = _Alphabet(numbers)
    passages: dict = {}
    for owner, passage in confirmed:
        key = alphabet.sequence(passage)
        passages[key] = min(owner, passages.get(key, owner))
    automaton = alphabet.automaton()
    for passage, owner in passages.items():
        automaton.add_word(passage, (len(passage), owner))
    automaton.make_automaton()
    out = []
    for owner, own in zip(ids, words, strict=True):
        hits = np.zeros(len(own) + 1, np.int32)
        if owner is not None:
            for end, (length, since) in automaton.iter(alphabet.sequence(own)):
                if owner >= since:
                    hits[end - length + 1] += 1
                    hits[end + 1] -= 1
        out.append(runs_of(np.cumsum(hits)[:-1] > 0))
    return out


def _without(words: list[bytes], spans: np.ndarray) -> bytes:
    if not len(spans):
        return b" ".join(words)
    kept, at = [], 0
    for start, end in spans.tolist():
        kept.extend(words[at:start])
        at = end
    return b" ".join(kept + words[at:])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns of `docs`, n_words, removed_spans (of words) and kept_text.

    Every word is removed that lies in a window of `window` words whose sequence also starts
    in a document with a smaller id, judged on the input; kept_text has the other words, joined by
    one blank. Texts with fewer words than a window, null and empty texts lose nothing (kept_text
    of a null is empty). Rows without id neither lose words nor count as owners; rows with the
    same id are one document for the comparison. Clashing input columns stay; the new ones are
    prefixed with "_" then.
    """
    n_words, spans_col, kept_col = (free_name(docs, c) for c in ("n_words", "removed_spans", "kept_text"))
    seen_col = free_name(docs, "seen_keys")
    joined = with_seen(docs, seen_before(docs, _WindowKeys(window), id_col, text_col), id_col, seen_col)
    span_type = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([
        *docs.schema.fields, T.StructField(n_words, T.LongType(), False), T.StructField(spans_col, span_type, False),
        T.StructField(kept_col, T.StringType(), False),
    ])
    plain = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                words = [space_words(t) for t in text_of(batch, text_col)]
                seen = [
                    None if x is None else np.frombuffer(x, np.uint64)
                    for x in batch.column(seen_col).to_pylist()
                ]
                spans = shard_spans(batch.column(id_col).to_pylist(), words, seen, window)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c) for c in plain),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([s.tolist() for s in spans], pa.list_(pa.list_(pa.int64()))),
                    pa.array([_without(w, s) for w, s in zip(words, spans, strict=True)], pa.binary()).cast(pa.string()),
                ], names=schema.names)
                del words, seen, spans
            release_memory()

    return joined.mapInArrow(cut, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_removed = F.aggregate("removed_spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return remove_repeats(docs).select(
        "doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS k FROM spots),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS at FROM judged WHERE first < doc_id),
all_words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.at) AS t, count(*) AS n
  FROM all_words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.at = g.at GROUP BY a.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
