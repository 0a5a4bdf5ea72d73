"""Embedding hooks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import schemas as S
from corpusflow.functions.text import strip

HASHING_MODEL = "hashing-tf"


def drop_blank_texts(df: DataFrame, column: str = "content") -> DataFrame:
    return df.filter(F.length(strip(F.col(column))) > 0)


def embed_chunks(
    chunks: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    model_id: str,
    dimension: int = S.EMBEDDING_DIMENSION,
    batch_size: int = S.BATCH_SIZE,
) -> DataFrame:
    """Add ``embedding`` and ``embedding_model`` from a provider called with bounded batches.

    Each vector stays beside its row, so order needs no join; a provider that returns another
    number or length of vectors fails the batch.
    """
    schema = T.StructType(
        [*chunks.schema.fields, T.StructField("embedding", S.VECTOR), T.StructField("embedding_model", T.StringType())]
    )

    def run(batches):
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                vectors = embed(part["content"].tolist())
                if len(vectors) != len(part):
                    raise ValueError("EMBEDDING_MISMATCH: vector count differs from text count")
                if any(len(v) != dimension for v in vectors):
                    raise ValueError(f"EMBEDDING_MISMATCH: vectors must have {dimension} dimensions")
                yield part.assign(embedding=pd.Series(list(vectors), index=part.index), embedding_model=model_id)

    return chunks.mapInPandas(run, schema)


def _word_counts(texts: DataFrame, column: str, dimension: int) -> DataFrame:
    words = RegexTokenizer(inputCol=column, outputCol="_words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension)
    return counts.transform(words.transform(texts)).drop("_words")


def fit_idf(texts: DataFrame, column: str = "content", dimension: int = S.EMBEDDING_DIMENSION) -> IDFModel:
    """Inverse document frequencies of the hashed words over a corpus: sums that merge, one number per dimension."""
    return IDF(inputCol="_counts", outputCol="_weighted").fit(_word_counts(texts, column, dimension))


def hashing_embeddings(
    texts: DataFrame, column: str = "content", dimension: int = S.EMBEDDING_DIMENSION, idf: IDFModel | None = None
) -> DataFrame:
    """Built-in provider: hashed word counts scaled to unit length, entirely in the JVM.

    With ``idf`` (from ``fit_idf``) the counts are weighted first. The weights are part of the model's
    name, so vectors weighted by different corpora are different spaces and never compared.
    """
    counted, name = _word_counts(texts, column, dimension), f"{HASHING_MODEL}-{dimension}"
    if idf is not None:
        counted = idf.transform(counted).drop("_counts").withColumnRenamed("_weighted", "_counts")
        digest = hashlib.sha256(repr(idf.idf.toArray().tolist()).encode()).hexdigest()[:8]
        name = f"{HASHING_MODEL}idf-{dimension}-{digest}"
    out = Normalizer(inputCol="_counts", outputCol="_unit").transform(counted)
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).withColumn(
        "embedding_model", F.lit(name)
    ).drop("_counts", "_unit")


def zip_embeddings(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Join separately delivered vectors by (batch, position); missing ones are reported as null.

    ``texts``: batch, position, ...; ``vectors``: batch, position, embedding, embedding_model.
    """
    return texts.join(vectors.select("batch", "position", "embedding", "embedding_model"), ["batch", "position"], "left")


def embedding_mismatches(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Batches whose vector count differs from their text count."""
    n = texts.groupBy("batch").agg(F.count("*").alias("texts"))
    m = vectors.groupBy("batch").agg(F.count("*").alias("vectors"))
    both = n.join(m, "batch", "full").fillna(0, ["texts", "vectors"])
    return both.filter("texts != vectors")
