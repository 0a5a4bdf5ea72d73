import math
import re

import pytest
from pyspark.ml.feature import HashingTF

from corpusflow.operators import embedding
from tests.conftest import rows

TEXTS = ["the cat sat", "the dog sat on the dog", "a cat, a dog", "the the the", "Zebra"]


def brute(texts, dimension, weighted):
    """Hashed counts, weighted by log((n + 1) / (df + 1)), scaled to unit length."""
    hashing = HashingTF(numFeatures=dimension)
    counts = []
    for text in texts:
        vector = [0.0] * dimension
        for word in re.findall(r"\w+", text.lower()):
            vector[hashing.indexOf(word)] += 1
        counts.append(vector)
    held = [sum(v[i] > 0 for v in counts) for i in range(dimension)]
    out = []
    for vector in counts:
        if weighted:
            vector = [x * math.log((len(texts) + 1) / (h + 1)) for x, h in zip(vector, held)]
        norm = math.sqrt(sum(x * x for x in vector))
        out.append([x / norm if norm else 0.0 for x in vector])
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_vectors_by_value(spark, weighted):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string").repartition(3)
    idf = embedding.fit_idf(df, dimension=64) if weighted else None
    got = dict(rows(embedding.hashing_embeddings(df, dimension=64, idf=idf), "id", "embedding"))
    for i, vector in enumerate(brute(TEXTS, 64, weighted)):
        assert got[i] == pytest.approx(vector, abs=1e-6)


def test_weights_make_a_space_of_their_own(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    names = {embedding.hashing_embeddings(df, dimension=64).first().embedding_model}
    for part in (df, df.filter("id < 3")):
        idf = embedding.fit_idf(part, dimension=64)
        names.add(embedding.hashing_embeddings(df, dimension=64, idf=idf).first().embedding_model)
    assert len(names) == 3
