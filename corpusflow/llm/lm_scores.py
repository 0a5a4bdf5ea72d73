"""Language-model scores of documents: a byte PPM model and a unigram base, both learnt from the corpus."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm.batches import bounded_batches, mixed, release_memory, slices, space_words, text_of, word_hashes
from corpusflow.llm.ppm_model import ORDER, PPMModel, gram_counts, merge_counts
from corpusflow.llm.staging import parts_for, staged, text_bytes

#: A context is broadcast when it makes up at least this share of all bytes: at most so many per order. The others are looked up.
CONTEXTS_PER_ORDER = 16384
#: Words of at least this share of all tokens are broadcast: at most so many. The others are joined.
HEAD_WORDS = 1 << 21
#: Documents whose CRC has this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Key of the end token: no word contains a line feed.
END = b"\n"

_END_KEY = int(word_hashes([END]).view(np.int64)[0])
_COUNTS = "gram boolean, key bigint, n bigint"


def _word_keys(words: list[bytes]) -> np.ndarray:
    return word_hashes(words).view(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (with ends) and byte strings of the batch's texts, each distinct one once.

    Of held-out texts only the byte strings, with a count of 0: their probabilities are wanted.
    """
    for whole in batches:
        held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        for batch in slices(whole, "text"):
            learnt, out = [], []
            for text, held_out in zip(text_of(batch, "text"), batch.column("held_out").to_pylist(), strict=True):
                (learnt if held_out is False else out).append(text)
            words = _word_keys([w for t in learnt for w in space_words(t.lower())])
            keys, n = np.unique(words, return_counts=True)
            asked = gram_counts(out)[0]
            found = [(False, np.append(keys, _END_KEY), np.append(n, len(learnt)))] if learnt else []
            for kind, k, c in (*found, (True, *gram_counts(learnt)), (True, asked, np.zeros(len(asked), np.int64))):
                held[kind][0].append(k)
                held[kind][1].append(c)
        for kind, lists in held.items():
            keys, n = merge_counts(*lists)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())],
                names=["gram", "key", "n"],
            )


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of words and of byte strings over the texts of `docs` that are not held out, as a written table.

    Byte strings of held-out texts alone are there with a count of 0.
    """
    return staged(
        docs.select("held_out", F.col(text_col).alias("text")).mapInArrow(_count, _COUNTS).groupBy("gram", "key").agg(F.sum("n").alias("n")),
        "corpus-counts",
    )


def gram_orders(counts: DataFrame) -> DataFrame:
    """Counts (o, g, n) of the byte strings of every order, as a written table: shorter contexts are sums of longer ones."""
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDER))).alias("o")
    shorter = counts.where("gram").select("key", "n", order).select(
        "o", F.col("key").bitwiseAND(F.element_at(F.array(*[F.lit((1 << 8 * (o + 1)) - 1) for o in range(ORDER + 1)]), F.col("o") + 1)).alias("g"), "n",
    ).groupBy("o", "g").agg(F.sum("n").alias("n"))
    return staged(shorter, "gram-orders")


def train_ppm(table: DataFrame, contexts_per_order: int) -> PPMModel:
    """The model of the frequent contexts, to be broadcast.

    Totals of one order add up to all bytes, so at most `contexts_per_order` contexts reach
    their share: this part is bounded by that number, not by the corpus. Bytes behind other
    contexts are looked up in `gram_scores`.
    """
    table = table.where("n > 0")
    total = table.where("o = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    context = F.shiftright("g", 8)
    frequent = table.groupBy("o", context.alias("c")).agg(F.sum("n").alias("t")).where(
        F.col("t") * contexts_per_order >= F.lit(total)
    ).select("o", "c")
    kept = table.withColumn("c", context).join(frequent, ["o", "c"]).select("o", "g", "n").orderBy("o", "g").toArrow()
    return PPMModel(*(kept.column(i).to_numpy() for i in range(3)))


def gram_scores(table: DataFrame) -> DataFrame:
    """key and p: log10 probability of the last byte of every full string of `table` by the model of all contexts.

    From the empty context upwards: each string meets the one without its first byte (which has
    at most 256 such), and the strings of one context, at most 256, share a window.
    """
    below = None
    for o in range(ORDER + 1):
        own = table.where(F.col("o") == o).select("g", "n")
        context = Window.partitionBy(F.shiftright("g", 8))
        seen = F.col("n") > 0
        if below is None:
            own = own.withColumn("esc", F.lit(0.0)).withColumn("lower_p", F.lit(None).cast("double"))
        else:
            own = own.withColumn("s", F.col("g").bitwiseAND((1 << 8 * o) - 1)).join(below, "s")
        own = own.select("*", F.sum("n").over(context).alias("t"), F.count(F.when(seen, 1)).over(context).alias("k"))
        if below is None:
            esc = -F.log10(F.greatest(F.lit(1), 256 - F.col("k")))
        else:
            # Behind an escape the shorter context's bytes without the own ones are left.
            own = own.withColumn("rest", F.col("lower_t") - F.sum(F.when(seen, F.col("lower_n")).otherwise(0)).over(context))
            kinds = F.col("lower_k") - F.col("k")
            esc = F.when(F.col("lower_n") > 0, F.log10(F.col("lower_n") / (F.col("rest") + kinds))).otherwise(
                F.when(kinds > 0, F.log10(kinds / (F.col("rest") + kinds))).otherwise(0.0) + F.col("esc")
            )
        p = F.when(seen, F.log10(F.col("n") / (F.col("t") + F.col("k")))).when(
            F.col("k") > 0, F.log10(F.col("k") / (F.col("t") + F.col("k"))) + F.col("new_esc")
        ).otherwise(F.coalesce("lower_p", F.col("new_esc")))
        below = own.withColumn("new_esc", F.when(seen, 0.0).otherwise(esc)).select(
            F.col("g").alias("s"), F.col("n").alias("lower_n"), F.col("t").alias("lower_t"), F.col("k").alias("lower_k"),
            F.col("new_esc").alias("esc"), p.alias("lower_p"),
        )
    return below.select(F.col("s").alias("key"), F.col("lower_p").alias("p"))


_ROWS = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, head_known bigint, head_sum double, score double, "
    "tail array<bigint>, tail_n array<bigint>, slice bigint, ask binary, rare binary"
)
#: Text bytes, and distinct byte strings, whose lookups share one task.
RANGE_BYTES, RANGE_GRAMS = 64 << 20, 1 << 20
#: Strings that one message of the table holds at most.
_MESSAGE_GRAMS = 1 << 18
_SENT = "part bigint, slice bigint, keys binary, p binary"
_SENT_ARROW = pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("p", pa.binary())])
_ANSWERS = "slice bigint, part bigint, p binary"


def _squeezed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _by_part(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """Part, start and stop of each stretch of keys; they are in the order of their mixed values."""
    part = ((mixed(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(keys) else np.empty(0, np.int64)
    return [(int(part[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True)]


def _asker(parts: int):
    """Each slice's distinct strings, packed by hash range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed in zip(batch.column("slice").to_pylist(), batch.column("ask").to_pylist(), strict=True):
                keys = np.frombuffer(zlib.decompress(packed), np.int64)
                rows = [(part, name, _squeezed(keys[a:b]), None) for part, a, b in _by_part(keys, parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW,
                    )

    return ask


def _table_sender(parts: int):
    """The table of strings, packed by hash range."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, p = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("key", "p"))
        order = np.argsort(mixed(keys.view(np.uint64)))
        keys, p = keys[order], p[order].astype(np.float32)
        rows = [(part, None, _squeezed(keys[a:b]), p[a:b].tobytes()) for part, a, b in _by_part(keys, parts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW,
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _MESSAGE_GRAMS:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    return send


def _answer(group: pa.Table) -> pa.Table:
    """Of one hash range: the probabilities that each slice asks for, in its order."""
    part, asked, keys, values = group.column("part")[0].as_py(), [], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
    for row in group.select(["slice", "keys", "p"]).to_pylist():
        own = np.frombuffer(zlib.decompress(row["keys"]), np.int64)
        if row["slice"] is None:
            keys.append(own)
            values.append(np.frombuffer(row["p"], np.float32))
        else:
            asked.append((row["slice"], own))
    known, p = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(known)
    known, p = known[order], p[order]
    out = pa.table({
        "slice": pa.array([name for name, _ in asked], pa.int64()), "part": pa.array([part] * len(asked), pa.int64()),
        "p": pa.array([p[np.searchsorted(known, own)].tobytes() for _, own in asked], pa.binary()),
    })
    release_memory()
    return out


def _rare_sums(wanted: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one slice: each row's sum over its strings."""
    parts = sorted(answers.select(["part", "p"]).to_pylist(), key=lambda a: a["part"])
    p = np.frombuffer(b"".join(a["p"] for a in parts), np.float32).astype(np.float64)
    kind = np.uint16 if len(p) <= 0xFFFF else np.uint32
    sums = [float(p[np.cumsum(np.frombuffer(zlib.decompress(x), kind), dtype=np.int64)].sum()) for x in wanted.column("rare").to_pylist()]
    return pa.table({"row": wanted.column("row"), "rare_score": pa.array(sums, pa.float64())})


def rare_scores(scored: DataFrame, known: DataFrame, text_size: int) -> DataFrame:
    """row and rare_score: what the bytes behind contexts outside the broadcast add to each row.

    Slices send their distinct strings to the task of the string's hash range, which holds that
    range of the table of all strings, and get the probabilities back in the same order.
    """
    parts = max(parts_for(text_size, RANGE_BYTES), parts_for(known.count(), RANGE_GRAMS))
    asked = scored.where("ask IS NOT NULL").select("slice", "ask").mapInArrow(_asker(parts), _SENT)
    sent = asked.unionByName(known.mapInArrow(_table_sender(parts), _SENT))
    answers = staged(sent.groupBy("part").applyInArrow(_answer, _ANSWERS), "rare-answers")
    wanted = scored.where("rare IS NOT NULL").select("slice", "row", "rare")
    sums = wanted.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_rare_sums, "row bigint, rare_score double")
    return staged(sums, "rare-sums")


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, head_log = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = text_of(batch, "text")
                words = [space_words(t.lower()) for t in texts]
                counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
                keys = _word_keys([w for own in words for w in (*own, END)])
                owner = np.repeat(np.arange(len(texts)), counts)
                at = np.minimum(np.searchsorted(head, keys), max(0, len(head) - 1))
                known = head[at] == keys if len(head) else np.zeros(len(keys), bool)
                sums = np.bincount(owner[known], weights=head_log[at[known]], minlength=len(texts))
                known_n = np.bincount(owner[known], minlength=len(texts))
                rest_owner, rest = owner[~known], keys[~known]
                order = np.lexsort((rest, rest_owner))
                rest_owner, rest = rest_owner[order], rest[order]
                fresh = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (rest_owner[1:] != rest_owner[:-1]))[:len(rest)])
                times = np.diff(np.append(fresh, len(rest)))
                cuts = np.searchsorted(rest_owner[fresh], np.arange(len(texts) + 1)).astype(np.int32)
                known_sum, rare_owner, rare = model.score_known(texts)
                asked, at_rare = np.unique(rare, return_inverse=True)
                by_hash = np.argsort(mixed(asked.view(np.uint64)))
                place = np.empty(len(asked), np.uint16 if len(asked) <= 0xFFFF else np.uint32)
                place[by_hash] = np.arange(len(asked))
                rare_cuts = np.searchsorted(rare_owner, np.arange(len(texts) + 1))
                rare_places = [
                    _squeezed(np.diff(np.sort(place[at_rare[a:b]]), prepend=place.dtype.type(0))) if b > a else None
                    for a, b in zip(rare_cuts[:-1], rare_cuts[1:], strict=True)
                ]
                # The slice is named by its first row, which carries its distinct strings.
                name = batch.column("row")[0].as_py()
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(counts, pa.int64()),
                    pa.array(known_n, pa.int64()), pa.array(sums, pa.float64()), pa.array(known_sum, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest[fresh], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times, pa.int64())),
                    pa.array([name] * len(texts), pa.int64()),
                    pa.array([_squeezed(asked[by_hash]) if len(asked) else None, *[None] * (len(texts) - 1)], pa.binary()),
                    pa.array(rare_places, pa.binary()),
                ], names=["row", "doc_id", "held_out", "n_tokens", "head_known", "head_sum", "score", "tail", "tail_n", "slice", "ask", "rare"])

    return score


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `docs`.

    Both models learn from the rows that are not held out. score is the log10 probability
    that the PPM model gives to the bytes of the whole text and its end; a null text is empty.
    Rows are scored one by one, so repeated rows and rows without id each get theirs. With
    nothing to learn from, bytes are uniform and the base score is 0. Frequent words come as
    a broadcast of bounded size; the others, each a small share of all tokens, are joined. Likewise
    bytes behind frequent contexts are scored from a broadcast, the others from the table of all.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    counts = corpus_counts(texts)
    words = counts.where("NOT gram")
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = words.where(F.col("n") * HEAD_WORDS >= F.lit(tokens)).select("key", "n").orderBy("key").toArrow()
    head_keys, head_n = (head.column(i).to_numpy() for i in (0, 1))
    table = gram_orders(counts)
    model = train_ppm(table, CONTEXTS_PER_ORDER)
    # Written before the rows are, so that its shuffles are gone by then.
    known = staged(gram_scores(table), "gram-scores")
    shared = spark.sparkContext.broadcast((model, head_keys, np.log10(head_n + 1.0)))
    scored = staged(
        texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_scorer(shared), _ROWS), "scored-rows",
    )
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select(
        "row", F.col("t.tail").alias("key"), F.col("t.tail_n").alias("times"),
    )
    rare = words.where(F.col("n") * HEAD_WORDS < F.lit(tokens)).select("key", "n")
    sums = tail.join(rare, "key").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_sum"), F.sum("times").alias("tail_known"),
    )
    zero = F.lit(0)
    rare_sums = rare_scores(scored, known, text_bytes(texts)[1])
    return scored.drop("tail", "tail_n", "ask", "rare").join(sums, "row", "left").join(rare_sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", zero)).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs, fold_of("doc_id", FOLDS) == HELD_OUT)
