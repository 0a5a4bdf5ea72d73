"""Token counts by rank-synchronous merging of ragged arrays.

Many pre-tokens lie behind each other in one symbol array. In each round every sequence
finds the lowest rank among its neighbouring pairs and joins all places of that pair at
once; a sequence without a mergeable pair is done, and its symbols that are left are counted.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.batches import MEMO_ENTRIES, bounded_batches, slices
from corpusflow.llm.pieces import chunks, pretokens
from corpusflow.llm.staging import free_name

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 1024
#: Symbols that one round holds at a time (a longer pre-token is held alone).
ROUND_SYMBOLS = 1 << 18
#: Bytes from which a pre-token finds its lowest rank by a heap instead of a look at all its pairs in each round.
LONG_PIECE = 256
#: Characters from which a chunk is counted each time instead of being remembered.
LONG_CHUNK = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class RaggedMerger:
    """The merge table of a byte-level vocabulary, applied to many sequences at once."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        vocabulary = stored["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in stored["model"]["merges"]]
        self.base = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        self.size = max(vocabulary.values()) + 1
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # Joining all places of the lowest pair at once is right only if no new symbol makes a lower pair.
        born = np.full(self.size, -1, np.int64)
        born[made] = np.arange(len(pairs))
        if not ((born[left] < np.arange(len(pairs))).all() and (born[right] < np.arange(len(pairs))).all()):
            raise ValueError("a merge comes before the merges that make its parts")
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of_key, self.made = keys[order], order, made
        self.never = len(pairs)
        #: The same ranks for single look-ups.
        self.pairs = dict(zip((left * self.size + right).tolist(), range(len(pairs)), strict=True))
        special = [t["content"] for t in stored.get("added_tokens", []) if t["content"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.chunk_counts: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        keys = symbols[:-1] * self.size + symbols[1:]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank_of_key[at], self.never)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each byte string after all merges."""
        out = np.zeros(len(pieces), np.int64)
        long = [i for i, p in enumerate(pieces) if len(p) >= LONG_PIECE]
        if long:
            short = [i for i, p in enumerate(pieces) if len(p) < LONG_PIECE]
            out[long] = [self._count_long(pieces[i]) for i in long]
            out[short] = self.counts([pieces[i] for i in short])
            return out
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        start = 0
        while start < len(pieces):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + ROUND_SYMBOLS, side="right")))
            out[start:stop] = self._count(pieces[start:stop], lengths[start:stop])
            start = stop
        return out

    def _count_long(self, piece: bytes) -> int:
        """As `_count` for one long sequence: n log n instead of n for every rank that occurs.

        The places of each rank wait in a list, the ranks in a heap. A round takes the lowest
        rank, joins its places from the left and files the pairs that this makes; they are all
        of higher rank. A place is out of date if its pair has another rank by then.
        """
        symbols = self.base[np.frombuffer(piece, np.uint8)]
        n = len(symbols)
        first = self._ranks(symbols)
        places: dict[int, list[int]] = {}
        by_rank = np.argsort(first, kind="stable")
        by_rank = by_rank[first[by_rank] < self.never]
        found, starts = np.unique(first[by_rank], return_index=True)
        for rank, start, stop in zip(found.tolist(), starts.tolist(), [*starts.tolist()[1:], len(by_rank)]):
            places[rank] = by_rank[start:stop].tolist()
        heap = sorted(places)
        rank_at, held = [*first.tolist(), self.never], symbols.tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        left, pairs, never, size = n, self.pairs, self.never, self.size
        while heap:
            rank = heapq.heappop(heap)
            made = int(self.made[rank])
            for at in sorted(places.pop(rank)):
                if rank_at[at] != rank:
                    continue
                gone = after[at]
                following, previous = after[gone], before[at]
                held[at], after[at], rank_at[gone] = made, following, never
                left -= 1
                rank_at[at] = never
                if following >= 0:
                    before[following] = at
                    rank_at[at] = pairs.get(made * size + held[following], never)
                if previous >= 0:
                    rank_at[previous] = pairs.get(held[previous] * size + made, never)
                for place in (at, previous):
                    new = rank_at[place] if place >= 0 else never
                    if new < never:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(heap, new)
                        places[new].append(place)
        return left

    def _count(self, pieces: list[bytes], lengths: np.ndarray) -> np.ndarray:
        out = lengths.copy()
        symbols = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            rank = np.append(self._ranks(symbols), self.never)
            rank[:-1][owner[:-1] != owner[1:]] = self.never
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(owner)))
            wanted = np.repeat(lowest, sizes)
            hit = (rank == wanted) & (wanted < self.never)
            if not hit.any():
                break
            # In a run of overlapping places every second one is joined, from the left.
            places = np.flatnonzero(hit)
            starts = np.append(True, np.diff(places) > 1)
            run = places[starts][np.cumsum(starts) - 1]
            places = places[(places - run) % 2 == 0]
            symbols[places] = self.made[rank[places]]
            keep = np.repeat(lowest < self.never, sizes)
            keep[places + 1] = False
            out -= np.bincount(owner[places], minlength=len(out))
            symbols, owner = symbols[keep], owner[keep]
        return out

    def learn(self, texts: set[str]) -> dict[str, int]:
        """Count the chunks that are not known yet, all in the same rounds; those too long to be remembered are returned."""
        once = {}
        new = [t for t in texts if t not in self.chunk_counts]
        cut = [pretokens(t) for t in new]
        pieces = sorted({p for found in cut for p in found})
        known = dict(zip(pieces, self.counts([p.encode() for p in pieces]).tolist(), strict=True))
        for text, found in zip(new, cut, strict=True):
            kept = self.chunk_counts if len(text) < LONG_CHUNK else once
            kept[text] = sum(map(known.__getitem__, found))
        return once

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; a special string is one token."""
        parts = []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special and self.special.search(text) else [text]
            parts.append((i, pieces))
        cut = []
        for i, pieces in parts:
            found: list[str] = []
            for piece in pieces:
                own = chunks(piece)
                found.extend(pretokens(piece) if own is None else own)
            cut.append((i, len(pieces) - 1, found))
        if len(self.chunk_counts) > 4 * MEMO_ENTRIES:
            self.chunk_counts.clear()
        once = self.learn({c for _, _, found in cut for c in found})
        known = self.chunk_counts
        return [extra + sum(once[c] if len(c) >= LONG_CHUNK else known[c] for c in found) for _, extra, found in cut]


@functools.lru_cache(maxsize=2)
def merger(path: str = VOCABULARY) -> RaggedMerger:
    """One merge table per Python worker."""
    return RaggedMerger(path)


def count_tokens(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of `docs` and n_tokens of the whole text (null and empty: 0).

    Works inside each row: no shuffle, memory for one slice of texts, or for one text that is
    longer than a slice. Pieces without blanks cost n log n. Repeated rows are counted each;
    empty input gives no rows. Clashing input columns stay; the new one is prefixed with "_" then.
    """
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for whole in batches:
            for batch in slices(whole, text_col):
                found = own.count_texts([t or "" for t in batch.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

    return docs.mapInArrow(count, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )
