import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import chunking, constraints, embedding
from tests.conftest import rows


def naive(text, size, overlap, marks=("\n\n", "\n", " ", "")):
    """Straight list-of-strings form of the splitting rules, kept for comparison."""
    mark = next(m for m in marks if m == "" or m in text)
    later = marks[marks.index(mark) + 1 :]
    if mark:
        first, *others = text.split(mark)
        parts = [p for p in [first, *[mark + o for o in others]] if p]
    else:
        parts = list(text)
    out, waiting = [], []

    def pack(pieces):
        window = []
        for piece in pieces:
            if window and sum(map(len, window)) + len(piece) > size:
                out.append("".join(window).strip())
                while sum(map(len, window)) > overlap or (window and sum(map(len, window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        if window:
            out.append("".join(window).strip())

    for part in parts:
        if len(part) < size:
            waiting.append(part)
            continue
        pack(waiting)
        waiting = []
        if later:
            out.extend(naive(part, size, overlap, later))
        else:
            out.append(part)
    pack(waiting)
    return [p for p in out if p]


@pytest.mark.parametrize("size,overlap", [(40, 8), (25, 0), (30, 29), (100, 10)])
def test_splitter_matches_naive_form(size, overlap):
    generator = random.Random(size)
    alphabet = ["a", "bb", "ccc", " ", " ", "\n", "\n\n", "é", "😀", "word" * 12, "\n\n\n"]
    for _ in range(300):
        text = "".join(generator.choice(alphabet) for _ in range(generator.randint(0, 120)))
        got = chunking.split_text(text, size, overlap)
        assert got == (naive(text, size, overlap) if text else [])
        assert all(len(p) <= size for p in got)


def test_chunk_numbers_and_metadata(spark):
    text = " ".join(f"word{i}" for i in range(900))
    blocks = spark.createDataFrame(
        [("d", 0, text, 1), ("d", 1, "   ", 2), ("d", 2, "short", 3), ("d", 9000, text, 4), ("e", 5, "x", 1)],
        "document_id string, block_no int, text string, line int",
    )
    got = chunking.chunk_blocks(blocks)
    for key, per in (("d", 1 + 2 * len(chunking.split_text(text))), ("e", 1)):
        found = sorted(rows(got.filter(F.col("document_id") == key), "chunk_index", "block_no", "line", "content"))
        assert [f[0] for f in found] == list(range(per))
        assert [f[1] for f in found] == sorted(f[1] for f in found)
        assert all(f[3].strip() == f[3] and f[3] for f in found)
    want = chunking.split_text(text) + ["short"] + chunking.split_text(text)
    assert [r[0] for r in rows(got.filter("document_id = 'd'").orderBy("chunk_index"), "content")] == want


def test_sparse_metadata(spark):
    df = spark.createDataFrame([((None, 2, None, None, None, "", "T"), "f.pptx")], "m struct<page:int,slide:int,paragraph:int,line:int,table:int,section:string,title:string>, n string")
    got = df.select(chunking.sparse_metadata(F.col("m"), F.lit(None).cast("string"), F.col("n"))).first()[0]
    assert got == '{"documentName":"f.pptx","slide":2,"title":"T"}'


def test_provider_batches(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "i int, content string").coalesce(1)

    def embed(texts):
        assert len(texts) <= 64
        return [[float(t[1:]), 1.0] for t in texts]

    out = embedding.embed_chunks(df, embed, "m", dimension=2)
    assert all(v[0] == i and m == "m" for i, v, m in rows(out, "i", "embedding", "embedding_model"))
    for bad in (lambda t: [[1.0, 2.0]] * (len(t) - 1), lambda t: [[1.0]] * len(t)):
        with pytest.raises(Exception, match="EMBEDDING_MISMATCH"):
            embedding.embed_chunks(df, bad, "m", dimension=2).count()


def test_hashing_provider_and_guards(spark):
    df = spark.createDataFrame([("a", "red fox"), ("b", "red fox"), ("c", "blue whale"), ("d", " ")], "document_id string, content string")
    out = embedding.hashing_embeddings(embedding.drop_blank_texts(df), dimension=32)
    vectors = dict(rows(out, "document_id", "embedding"))
    assert set(vectors) == {"a", "b", "c"} and vectors["a"] == vectors["b"] and len(vectors["a"]) == 32
    assert abs(sum(x * x for x in vectors["a"]) - 1) < 1e-6
    mixed = out.withColumn("document_id", F.lit("x")).withColumn("embedding_model", F.concat(F.lit("m"), F.length("content")))
    assert rows(constraints.embedding_guard(mixed, 64), "violations") == [("DIMENSION_MISMATCH,MIXED_MODELS",)]
    same = constraints.space_compatibility(out, out, key="document_id").first()
    assert same["compatible"] and same["same_model"] and same["texts"] == 3
