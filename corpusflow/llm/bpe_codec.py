"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a byte string the encoding is determined by its last token alone: token
t ends prefix p exactly if t fits behind the last token of the prefix before it, and only
one such t exists. The last tokens of all prefixes are therefore a complete record of the
encoding: bytes can be appended by going on, and an edit leaves everything before it valid.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.batches import Memo, bounded_batches, release_memory, slices
from corpusflow.llm.pieces import pretokens
from corpusflow.llm.staging import free_name

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters from which on a piece is worked out for each slice of texts instead of being remembered.
LONG = 64
#: Entries of the memo of pieces, besides those of one slice, and of each generation of that of neighbouring tokens.
PIECE_ENTRIES, CODEC_ENTRIES = 400_000, 150_000


class Vocabulary:
    """Ranks by byte string; which tokens fit side by side."""

    def __init__(self, path: str):
        self.ranks, self.tokens = token_bytes(path)
        self.longest = max(map(len, self.ranks))
        #: The last merge that makes each token, or None for single bytes and for tokens no merge reaches.
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.reached: set[int] = set()
        self.fits = Memo(lambda pair: self._side_by_side(pair >> 32, pair & 0xFFFFFFFF), CODEC_ENTRIES)
        for token in sorted(self.ranks, key=self.ranks.__getitem__):
            self._split(token)
        #: Lengths of the tokens that end in three given bytes, longest first (two: the only length left).
        sizes: dict[bytes, set[int]] = {}
        for token in map(self.tokens.__getitem__, self.reached):
            if len(token) > 2:
                sizes.setdefault(token[-3:], set()).add(len(token))
        self.ends = {end: tuple(sorted(found, reverse=True)) for end, found in sizes.items()}
        self.known = {self.tokens[rank]: rank for rank in self.reached}

    def _split(self, token: bytes) -> None:
        """Merge the token's bytes with the tokens of lower rank: two parts must be left, or it is out of reach."""
        rank = self.ranks[token]
        if len(token) == 1:
            self.parts[rank] = None
            self.reached.add(rank)
            return
        parts = self.merge(token, below=rank)
        if len(parts) == 2:
            self.parts[rank] = (parts[0], parts[1])
            self.reached.add(rank)

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        limit = len(self.tokens) if below is None else below
        while len(parts) > 1:
            rank, at = min(
                (self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)
            )
            if rank >= limit:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _side_by_side(self, left: int, right: int) -> bool:
        """Whether no merge would have joined anything across the border of two tokens.

        Both tokens are taken apart again, the one merged last first; at each step the border
        pair must not form a token of a rank that merging would have met before that split.
        """
        tokens, ranks, parts = self.tokens, self.ranks, self.parts
        bound = never = len(tokens)
        while True:
            if ranks.get(tokens[left] + tokens[right], never) < bound:
                return False
            # The border token merged last; of equal ranks the right one, as merging goes from the left.
            undo_left = left > right
            if parts[left if undo_left else right] is None:
                undo_left = not undo_left
            halves = parts[left if undo_left else right]
            if halves is None:
                return True
            if undo_left:
                bound, left = left, halves[1]
            else:
                # A border pair of this very rank stands further left and would have come first.
                bound, right = right + 1, halves[0]


class PrefixEncoder:
    """The last token of every prefix of one pre-token's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Go on behind what is stored; nothing before changes."""
        start = len(self.data)
        self.data += more
        self._extend(bytes(self.data), start)

    def _extend(self, data: bytes, start: int, old: list[int] | None = None) -> None:
        """Last tokens of the prefixes of `data` beyond `start`; `old` are records to fall in with again."""
        v, last = self.vocabulary, self.last
        lengths, known, fits, ranks = v.ends.get, v.known.get, v.fits, v.ranks
        agreed = 0
        for end in range(start + 1, len(data) + 1):
            token = None
            if end > 2:
                for size in lengths(data[end - 3:end], ()):
                    if size <= end:
                        rank = known(data[end - size:end])
                        if rank is not None and (size == end or fits[last[end - size - 1] << 32 | rank]):
                            token = rank
                            break
            if token is None and end > 1:
                rank = known(data[end - 2:end])
                if rank is not None and (end == 2 or fits[last[end - 3] << 32 | rank]):
                    token = rank
            last.append(ranks[data[end - 1:end]] if token is None else token)
            if old is not None:
                at = end - start - 1
                agreed = agreed + 1 if last[-1] == old[at] else 0
                if agreed >= v.longest:
                    last.extend(old[at + 1:])
                    return

    def turn_into(self, data: bytes) -> None:
        """Become the record of `data`; the tokens of the prefixes that both share stay."""
        size = min(len(self.data), len(data))
        differ = int.from_bytes(self.data[:size]) ^ int.from_bytes(data[:size])
        shared = size - (differ.bit_length() + 7) // 8
        del self.last[shared:]
        self.data = bytearray(data)
        self._extend(data, shared)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; prefixes before the edit keep their tokens.

        Behind the edit the old records are taken over as soon as as many prefixes as the
        longest token has bytes agree with them: no later prefix looks further back.
        """
        tail, old = bytes(self.data[stop:]), self.last[stop:]
        del self.data[start:], self.last[start:]
        self.append(new)
        begin = len(self.data)
        self.data += tail
        self._extend(bytes(self.data), begin, old)

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Codec:
    """Text to ids and back; remembers the ids of pieces, packed as little-endian 32-bit integers."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary(path)
        self.packed_id = [rank.to_bytes(4, "little") for rank in range(len(self.vocabulary.tokens))]
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the memo of pieces: workers are used again, also by other steps, and would keep it."""
        self.pieces = {}

    def _learn(self, wanted: set[str]) -> None:
        """Pieces that aren't remembered, in their order: each goes on from the prefix that it shares with the one before."""
        fresh = sorted(p for p in wanted if p not in self.pieces)
        if len(self.pieces) + len(fresh) > PIECE_ENTRIES:
            self.pieces = {p: self.pieces[p] for p in wanted if p in self.pieces}
        encoder, packed_id, whole = PrefixEncoder(self.vocabulary), self.packed_id.__getitem__, self.vocabulary.ranks.get
        for piece in fresh:
            data = piece.encode()
            rank = whole(data)
            if rank is None:
                encoder.turn_into(data)
                self.pieces[piece] = b"".join(map(packed_id, encoder.tokens()))
            else:
                self.pieces[piece] = packed_id(rank)

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [pretokens(t) for t in texts]
        wanted = set().union(*cut)
        self._learn(wanted)
        out = [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        for piece in wanted:
            if len(piece) >= LONG:
                del self.pieces[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def token_bytes(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Ranks by token, and tokens by rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


@functools.lru_cache(maxsize=2)
def codec(path: str = VOCABULARY) -> Codec:
    """One codec per Python worker."""
    return Codec(path)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of `docs` and token_ids (array<int>) of the whole text (null: none).

    Works inside each row: no shuffle, and memory for one slice of texts only. Special strings
    are ordinary text. Clashing input columns stay; the new one is prefixed with "_" then.
    """
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "token_ids")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType(), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        try:
            for whole in batches:
                for batch in slices(whole, text_col):
                    ids = own.encode_packed([t or "" for t in batch.column(text_col).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=schema.names)
        finally:
            own.forget()
            release_memory()

    return docs.mapInArrow(encode, schema)


def decode_documents(docs: DataFrame, ids_col: str = "token_ids", path: str = VOCABULARY) -> DataFrame:
    """All rows and columns of `docs` and the decoded bytes of the packed ids (null: none)."""
    bounded_batches(docs.sparkSession)
    name = free_name(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType(), False)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = token_bytes(path)[1].__getitem__
        for whole in batches:
            for batch in slices(whole, ids_col):
                texts = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)
        del token
        release_memory()

    return docs.mapInArrow(decode, schema)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_documents(docs).select("doc_id", "token_ids")
    return decode_documents(encoded).select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
