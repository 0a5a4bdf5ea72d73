"""Quality scores: pooled random-indexing vectors and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.lm_scores import fold_of
from corpusflow.llm.staging import free_name, staged
from corpusflow.llm.word_vectors import DIMENSIONS, pooled, train_vectors

#: Labelled rows that the network is fitted on at most: a sample by hash of the id.
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
BATCH = 256
RATE = 3e-3
DECAY = 1e-4
#: Every n-th training row is kept back for the temperature.
CALIBRATION = 5
#: Documents whose CRC has this remainder are held out.
FOLDS, HELD_OUT = 3, 1


class Network:
    """tanh layer and logistic output on standardized inputs; the logit is divided by a fitted temperature."""

    def __init__(self, inputs: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.weights = [
            rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
        ]
        self.temperature = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        hidden = np.tanh(x @ w1 + b1)
        return hidden, hidden @ w2 + b2[0]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
        """Adam on the log loss; without both classes only the (smoothed) share of ones is learnt."""
        share = (y.sum() + 1) / (len(y) + 2)
        self.weights[3][0] = np.log(share / (1 - share))
        if len(set(y.tolist())) < 2:
            self.weights[2][:] = 0
            return self
        rng = np.random.default_rng(seed)
        back = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        fit_x, fit_y = x[~back], y[~back]
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(fit_y))
            for start in range(0, len(order), BATCH):
                part = order[start:start + BATCH]
                hidden, logit = self._forward(fit_x[part])
                error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - fit_y[part]) / len(part)
                inner = np.outer(error, self.weights[2]) * (1 - hidden**2)
                slopes = [
                    fit_x[part].T @ inner + DECAY * self.weights[0], inner.sum(axis=0),
                    hidden.T @ error + DECAY * self.weights[2], np.array([error.sum()]),
                ]
                step += 1
                for i, slope in enumerate(slopes):
                    first[i] += 0.1 * (slope - first[i])
                    second[i] += 0.001 * (slope**2 - second[i])
                    self.weights[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if back.any():
            self._calibrate(self._forward(x[back])[1], y[back])
        return self

    def _calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least log loss on the rows kept back."""
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        losses = [np.logaddexp(0, np.where(y > 0, -logit, logit) / t).mean() for t in tried]
        self.temperature = float(tried[int(np.argmin(losses))])

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = self._forward((x - self.mean) / self.scale)[1] / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def _features(shared):
    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, found in pooled(shared.value, batch):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), pa.array([r.tobytes() for r in found], pa.binary())], names=["label", "features"],
                )

    return pool


def train_classifier(
    docs: DataFrame, labels: DataFrame, vectors, usable: Column, id_col: str, text_col: str, label_col: str, most: int = TRAIN_ROWS,
) -> Network:
    """A network fitted on at most `most` labelled rows that `usable` allows; the sample is what the bound limits.

    Repeated labels of one id count by majority (ties: 1); null labels and ids are no labels.
    """
    chosen = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_label_id")
    ).agg((F.avg(label_col) >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("_label_id"), "_label_id").limit(most)
    sample = staged(chosen, "label-sample")
    # At most `most` rows of two numbers: a bounded broadcast.
    texts = docs.join(F.broadcast(sample), docs[id_col] == sample["_label_id"]).select(
        "label", F.col("_label_id").alias("id"), F.col(text_col).alias("text"),
    )
    found = texts.mapInArrow(_features(vectors), "label int, features binary").toArrow()
    x = np.frombuffer(b"".join(found.column("features").to_pylist()), np.float32).reshape(-1, 2 * DIMENSIONS)
    y = np.array(found.column("label").to_pylist(), np.float64)
    # Rows arrive in any order; sorted, they give the same network in every run.
    order = np.lexsort(np.append(x.T, [y], axis=0)) if len(y) else np.empty(0, np.int64)
    order = np.random.default_rng(11).permutation(order)
    return Network(2 * DIMENSIONS).fit(x[order].astype(np.float64), y[order])


def score_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """All rows and columns of `docs` and quality_score (0 to 1: likelier label 1) of the whole text.

    Word vectors come from all texts; labels only from rows that `usable` (a condition on
    `labels`) allows. Ids, languages, sources and labels are never inputs of a score. Null and
    empty texts are scored as texts without words. Without labels every score is one half. A
    clashing input column stays; the new one is prefixed with "_" then.
    """
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(train_vectors(docs, text_col))
    network = spark.sparkContext.broadcast(train_classifier(docs, labels, vectors, usable, id_col, text_col, label_col, train_rows))
    name = free_name(docs, "quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType(), False)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            renamed = batch.rename_columns(["text" if c == text_col else f"c{i}" for i, c in enumerate(batch.schema.names)])
            for piece, found in pooled(vectors.value, renamed):
                scores = network.value.score(found.astype(np.float64))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(score, schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = F.col("quality_score")
    return score_quality(docs, labels, fold_of("doc_id", FOLDS) != HELD_OUT).select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )
