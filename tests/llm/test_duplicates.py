"""Near duplicates, repeated phrases and repeated bytes against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import near_duplicates, repeated_bytes, repeated_phrases
from corpusflow.llm.components import components
from corpusflow.llm.run_index import SEPARATOR, RunIndex

AWKWARD = [(None, "a text without an id that is long enough to be a window of its own, twice over and more"), (900, None), (901, ""), (902, " \n\t ")]


def corpus(seed, n=60, words=80, vocabulary=40):
    """Random texts, some of them copies, near copies or with shared passages."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    texts = []
    for i in range(n):
        kind = rng.random()
        base = rng.choice(texts).split(" ") if texts and kind < 0.6 else [rng.choice(names) for _ in range(rng.randint(1, words))]
        if 0.2 < kind < 0.4:
            base = [rng.choice(names) if rng.random() < 0.03 else w for w in base]
        elif 0.4 < kind < 0.6:
            at = rng.randint(0, len(base))
            base = [rng.choice(names) for _ in range(10)] + base[at:at + 30] + [rng.choice(names) for _ in range(10)]
        texts.append(" ".join(base))
    ids = rng.sample(range(800), n)
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def shingles(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(rows, width, percent):
    rows = [(i, shingles(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(rows):
        for j, t in rows[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in rows}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = corpus(width) + AWKWARD
    found = near_duplicates.near_duplicates(frame(spark, rows), width=width).collect()
    assert len(found) == len(rows)
    expected = brute_components(rows, width, 80)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_a_family_wider_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_DOCS", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(["x", "y", "z"]) + str(i) if rng.random() < 0.03 else w for w in base)) for i in range(50)]
    found = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame(spark, rows), width=4).collect()}
    assert found == {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}


def test_repeated_ids_are_one_document(spark):
    rows = [(5, "a b c d e f g h"), (5, "k l m n o p q r"), (7, "k l m n o p q r"), (9, "a b c d e f g h"), (9, "a b c d e f g h")]
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect())
    assert found == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False)]
    kept = near_duplicates.drop_near_duplicates(frame(spark, rows).withColumn("class", F.lit(1)).withColumn("component_id", F.lit("x")))
    assert [r.doc_id for r in kept.collect()] == [5, 5] and kept.columns == ["doc_id", "text", "class", "component_id"]


def test_texts_of_one_id_keep_the_links_of_each(spark):
    # Both texts of id 5 stand for their sets and are near each other, so they meet in one cluster of candidates.
    base = [f"w{i}" for i in range(120)]
    other = [*base[:60], *(f"x{i}" for i in range(12)), *base[72:]]
    near_base = ["first", *base[1:]]
    near_other = [*other[:-1], "last"]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (9, " ".join(near_base)), (11, " ".join(near_other)), (12, "alone " * 9)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates.near_duplicates(frame(spark, rows), 5).collect()}
    assert got == {5: (5, True), 9: (5, False), 11: (5, False), 12: (12, True)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        low, high = sorted((find(u), find(v)))
        root[high] = low
    linked = {x for u, v in edges if u != v for x in (u, v)}
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def brute_phrases(rows, width):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for at in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[at:at + width])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = {p for at in range(len(w) - width + 1 if i is not None else 0) if first[tuple(w[at:at + width])] < i for p in range(at, at + width)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


def order(row):
    return tuple("" if x is None else str(x) for x in row)


def test_repeated_phrases_equal_brute_force(spark):
    rows = corpus(11) + corpus(12)[:10] + AWKWARD + [(903, "\U0001F600 b c " * 30), (904, "\U0001F600 b c " * 20)]
    out = repeated_phrases.remove_repeats(frame(spark, rows).withColumn("n_words", F.lit("mine")))
    assert out.columns == ["doc_id", "text", "n_words", "_n_words", "removed_spans", "kept_text"]
    found = [(r.doc_id, r._n_words, sum(b - a for a, b in r.removed_spans), r.kept_text) for r in out.collect()]
    assert sorted(found, key=order) == sorted(brute_phrases(rows, 13), key=order)


def brute_bytes(rows, width):
    first = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for at in range(len(b) - width + 1 if i is not None else 0):
            first[b[at:at + width]] = min(i, first.get(b[at:at + width], i))
    out = []
    for i, b in coded:
        gone = {p for at in range(len(b) - width + 1 if i is not None else 0) if first[b[at:at + width]] < i for p in range(at, at + width)}
        out.append((i, len(b), len(gone), bytes(x for p, x in enumerate(b) if p not in gone)))
    return out


def test_repeated_bytes_equal_brute_force(spark):
    same_id = [(905, "one text of an id that comes twice, with a tail of its own: " + "abc" * 20), (905, "zz" * 40 + "abc" * 25)]
    rows = corpus(21) + AWKWARD + same_id + [(906, "a" * 500), (907, "a" * 300), (908, "ä€😀" * 60), (909, "x" + "ä€😀" * 50)]
    found = [
        (r.doc_id, len((r.text or "").encode()), sum(b - a for a, b in r.removed_bytes), bytes(r.kept_bytes))
        for r in repeated_bytes.remove_repeated_bytes(frame(spark, rows)).collect()
    ]
    assert sorted(found, key=order) == sorted(brute_bytes(rows, 50), key=order)


@pytest.mark.parametrize("options", [{"hot_kinds": 3}, {"index_bytes": 200}])
def test_repeated_bytes_of_hot_cores(spark, options):
    """One passage with other surroundings in every document: few different stretches an index, or none of its key."""
    rng = random.Random(31)
    core = "a passage of sixty bytes that everybody has copied somewhere"
    letters = "abcd"
    rows = [
        (i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + core[rng.randint(0, 8):len(core) - rng.randint(0, 8)] * rng.randint(1, 2)
         + "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in rng.sample(range(500), 60)
    ]
    rows += [(600, "".join(rng.choice("ab") for _ in range(4000))), (601, "ab" * 300), (602, "b" + "ab" * 200)]
    out = repeated_bytes.remove_repeated_bytes(frame(spark, rows).withColumn("found_id", F.lit(1)).withColumn("removed_bytes", F.lit("x")), **options)
    assert out.columns == ["doc_id", "text", "found_id", "removed_bytes", "_removed_bytes", "kept_bytes"]
    found = [(r.doc_id, len(r.text), sum(b - a for a, b in r._removed_bytes), bytes(r.kept_bytes)) for r in out.collect()]
    assert sorted(found) == sorted(brute_bytes(rows, 50)) and sum(f[2] for f in found) > 1000


def test_names_of_stretches_are_those_of_their_bytes():
    rng = random.Random(8)
    shared = bytes(rng.choice(b"xyz ") for _ in range(5000))
    texts = [bytes(rng.choice(b"pq") for _ in range(rng.randint(0, 90))) + shared[a:a + 700] + b"k" * rng.randint(0, 200) for a in range(0, 4000, 130)]
    found = repeated_bytes.Stretches([b"", b"short", *texts])
    assert found.counts[:2].tolist() == [0, 0] and found.counts.sum() == len(found.names)
    of_name = {}
    for i, (a, b) in enumerate(zip(found.bounds()[2:-1], found.bounds()[3:])):
        for at in range(a, b):
            piece = texts[i][found.starts[at]:found.ends[at]]
            assert of_name.setdefault(found.names[at], piece) == piece
    assert len(of_name) == len(set(of_name.values())) < len(found.names)


def test_run_index_against_search():
    import numpy as np

    rng = random.Random(4)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(60, 90))) for _ in range(8)] + ["ab" * 40, "ab" * 35]
    text = b"".join(p.encode() + bytes([SEPARATOR]) for p in pieces)
    index = RunIndex(np.frombuffer(text, np.uint8))
    assert index.runs < len(text)
    for _ in range(200):
        at = rng.randrange(len(text) - 60)
        pattern = text[at:at + rng.randint(1, 50)]
        if bytes([SEPARATOR]) not in pattern:
            place = index.locate(pattern)
            assert text[place:place + len(pattern)] == pattern
    assert index.locate(b"c") is None and index.locate(b"abbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbbb") is None
    starts = np.array([s for s in range(len(text) - 50) if bytes([SEPARATOR]) not in text[s:s + 50]])
    which, places = index.shared(np.frombuffer(text, np.uint8), starts, 50)
    shared = {s for s in starts.tolist() if sum(text[t:t + 50] == text[s:s + 50] for t in starts.tolist()) > 1}
    assert set(starts[which].tolist()) == shared
    names = {}
    for w, place in zip(which.tolist(), places.tolist()):
        window = text[starts[w]:starts[w] + 50]
        assert names.setdefault(window, place) == place and text[place:place + 50] == window


def test_the_index_is_entered_behind_the_last_32_bytes(monkeypatch):
    import numpy as np

    rng = random.Random(6)
    core = "".join(rng.choice("ab") for _ in range(70))
    pieces = [rng.choice(("", "x", "yx")) + core[rng.randint(0, 12):rng.randint(58, 70)] + rng.choice(("", "x", "zz")) for _ in range(60)]
    text = np.frombuffer(b"".join(p.encode() + bytes([SEPARATOR]) for p in pieces), np.uint8)
    starts = np.array([s for s in range(len(text) - 50) if SEPARATOR not in text[s:s + 50]])
    index = RunIndex(text)
    plain = [x.tolist() for x in index.shared(text.copy(), starts, 50)]
    steps = []
    monkeypatch.setattr(RunIndex, "_lead", lambda self, byte, row, real=RunIndex._lead: (steps.append(len(row)), real(self, byte, row))[1])
    assert [x.tolist() for x in index.shared(text, starts, 50)] == plain and plain[0]
    assert len(steps) == 2 * (50 - 32)


@pytest.mark.parametrize("operator", [
    near_duplicates.near_duplicates, near_duplicates.drop_near_duplicates, repeated_phrases.remove_repeats,
    repeated_bytes.remove_repeated_bytes,
])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    """The five stages on a small corpus, each against its definition."""
    rng = random.Random(9)
    names = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(names) for _ in range(120)) for _ in range(12)]
    texts += [texts[0], texts[1] + " tail", "short text", "same " * 200, texts[2] + " " + texts[3], None]
    item = " ".join(texts[4].split()[20:40])
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(i, t) for i, t in enumerate(texts) if t and len(t.split()) >= 50 and not t.startswith("same")]
    kept = brute_components(docs, 5, 80)
    docs = [(i, t) for i, t in docs if kept[i][1] == i]
    cut = {i: (t, n) for i, _, n, t in brute_phrases(docs, 13)}
    docs = [(i, cut[i][0] if cut[i][1] else t) for i, t in docs]
    docs = [(i, t) for i, t in docs if not any(" ".join(item.split()[a:a + 10]) in t for a in range(11))]
    found = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs}
    assert 4 not in found and 12 not in found and 13 not in found and 14 not in found and 17 not in found


def test_shards_with_more_words_than_code_points(monkeypatch):
    """Numbers stand for words where code points don't suffice; small shards give the same spans either way."""
    rng = random.Random(6)
    names = [f"w{i}".encode() for i in range(50)]
    texts = [[rng.choice(names) for _ in range(80)] for _ in range(6)]
    texts += [t[10:60] + [rng.choice(names) for _ in range(20)] for t in texts]
    keys = [repeated_phrases.text_window_keys([b" ".join(t)], 5)[0] for t in texts]
    seen = [None if i < 6 else np.intersect1d(k, np.concatenate(keys[:i])) for i, k in enumerate(keys)]
    plain = repeated_phrases.shard_spans(list(range(12)), texts, seen, 5)
    monkeypatch.setattr(repeated_phrases, "LETTERS", 3)
    monkeypatch.setattr(repeated_phrases, "PASSAGE_WORDS", 7)
    assert all((a == b).all() for a, b in zip(plain, repeated_phrases.shard_spans(list(range(12)), texts, seen, 5), strict=True))
    assert sum(len(s) for s in plain) >= 6


def test_a_text_of_more_words_than_code_points():
    long = [b"%d" % i for i in range(1_200_000)]
    keys = repeated_phrases.text_window_keys([b" ".join(long)], 13)[0]
    spans = repeated_phrases.shard_spans([1, 2], [long, long], [None, keys], 13)
    assert not len(spans[0]) and spans[1].tolist() == [[0, len(long)]]
