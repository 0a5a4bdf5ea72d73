"""Ranked search, Merkle manifest and URL filters against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import merkle_manifest, ranked_search, url_rules
from tests.oracle_check import ROOT, compare

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- ranked search ----------------------------------------------------------------


def plain_search(docs, queries, k):
    words = [(i, TERM.findall(low(t or "").encode())) for i, t in docs]
    filled = [w for _, w in words if w]
    n_docs, n_terms = len(filled), sum(map(len, filled))
    held = Counter(t for w in filled for t in set(w))
    asked = {}
    for item, text in queries:
        asked.setdefault(item, set()).update(TERM.findall(low(text or "").encode()))
    out = {}
    for item, terms in asked.items():
        scored = []
        for doc, w in words:
            counts = Counter(w)
            m = 50 + (50 * len(w) * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m))
                for t in terms if counts[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out[item] = [(i, None if gone else doc, -s) for i, (s, gone, doc) in enumerate(sorted(scored)[:k], 1)]
    return {i: r for i, r in out.items() if r}


def search_corpus(seed, n=150):
    rng = random.Random(seed)
    names = [f"W{i}" if i % 3 else f"é{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(names, weights=range(1, 31), k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(70)]  # more equal scores than places
    docs += [(None, docs[3][1]), (900, None), (901, ""), (902, "?! \x00"), (3, docs[3][1]), (903, "w1 " * 50_000)]
    queries = [(i, " ".join(rng.sample(names, 6))) for i in range(8)]
    queries += [(100, docs[3][1]), (101, None), (102, ""), (103, "absent"), (None, "w1 W2"), (0, "w29 w29"), (104, "w1")]
    return docs, queries


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return out


@pytest.mark.parametrize(("postings", "block"), [(2_000_000, 200_000), (300, 5)])
def test_search_equals_plain_ranking(spark, monkeypatch, postings, block):
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    docs, queries = search_corpus(postings)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("rank", F.lit("clash")).withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame(queries, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert found(ranked_search.search(ranked_search.build_index(table), asked, k=50)) == plain_search(docs, queries, 50)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert ranked_search.search(ranked_search.build_index(none), asked).count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ranked_search.search(ranked_search.build_index(docs), asked.limit(0)).count() == 0


def test_text_ids_of_queries(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("x", "a"), ("y", "c c")], "item_id string, text string")
    assert {(r.item_id, r.doc_id) for r in ranked_search.search(ranked_search.build_index(docs), asked).collect()} == {("x", 1), ("y", 2)}


@pytest.mark.parametrize("seed", range(20))
def test_bounds_leave_exactly_the_best(seed):
    rng = np.random.default_rng(seed)
    docs, lists = 400, []
    for _ in range(rng.integers(1, 9)):
        places = rng.choice(docs, rng.integers(1, docs), replace=False).astype(np.int32)
        impacts = np.sort(rng.integers(0, 12, len(places)))[::-1].astype(np.int64)
        lists.append((places, impacts))
    scores = np.zeros(docs, np.int64)
    for places, impacts in lists:
        scores[places] += impacts
    kept, bounds = ranked_search.nra(lists, docs, 10, step=4)
    assert (bounds == scores[kept]).all()
    bar = max(1, np.sort(scores)[-10])
    assert set(np.flatnonzero(scores >= bar)) == set(kept[bounds >= bar])


def test_reading_stops_before_the_ends_of_the_lists():
    """A strong document settles one query early: the tail of the list is not read."""
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at.stop)
            return super().__getitem__(at)

    places = np.arange(10_000, dtype=np.int32).view(Watched)
    impacts = np.arange(10_000, 0, -1).astype(np.int64)
    kept, scores = ranked_search.nra([(places, impacts)], 10_000, 3, step=4)
    assert list(kept[:3]) == [0, 1, 2] and list(scores[:3]) == [10_000, 9_999, 9_998]
    assert max(reads) < 100


# --- Merkle manifest ---------------------------------------------------------------


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 8])) for i in range(0, len(below), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        out.append((at % 8, run[:at % 8] + run[at % 8 + 1:]))
        at //= 8
    return out


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: plain_tree([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in order}
    top = plain_tree([built[t][-1][0] for t in order])
    out = []
    for spot, t in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            path = plain_path(built[t], at) + plain_path(top, spot)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = plain_leaf((*row[:4], None if row[4] is None else low(row[4]))) if changed else leaf
            for place, others in path:
                node = sha("".join([*others[:place], node, *others[place:]]))
            proof = sha("".join(x for _, others in path for x in others))
            out.append((row[0], leaf, built[t][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def manifest_of(spark, tmp_path, rows, parts=3):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("clash")).repartition(parts)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle_manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1,), (8, 9), (1, 64, 65), (700, 2), (5000,)])
def test_manifest_equals_plain_trees(spark, tmp_path, sizes, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PART_ROWS", 300)
    langs = [None, "", "de", "é", "z"]
    rows = [(17 * i + j, f"s{i % 3}", langs[j], i, f"Text {i} É") for j, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PART_ROWS", 20)
    hit = next(i for i in range(7, 50) if zlib.crc32(str(i).encode()) % 3 == 0)
    rows = [(hit, "s", "en", 3, "ABC"), (hit, "s", "en", 3, None)] + [(None, None, None, None, None)] * 40 + [(5, "s", "en", 3, "ABC")] * 90 + [(5, "s", "en", 3, "abc"), (6, "", "", 0, ""), (-7, "s", "en", 1, "X" * 2_000_000)]
    made = manifest_of(spark, tmp_path, rows)
    assert made == plain_manifest(rows) and not all(r[6] for r in made) and any(r[6] for r in made)


def test_manifest_of_many_trees(spark, tmp_path):
    rows = [(i, None, f"l{i}", i, "T") for i in range(600)]
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_of_no_rows(spark, tmp_path):
    assert manifest_of(spark, tmp_path, []) == []


def test_only_every_third_level_is_stored(spark):
    nodes = spark.range(5000).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("node"), F.struct("id").alias("carry"))
    forest = merkle_manifest.build_forest(nodes)
    assert [level.count() for level in forest.levels] == [5000, 10]
    root = plain_tree([sha(str(i)) for i in range(5000)])[-1][0]
    assert [(r.depth, r.root) for r in forest.trees.collect()] == [(5, root)]


def test_siblings_are_real_output(spark):
    rows = [(i, "s", "en", i, "T") for i in range(70)]
    leaves = plain_tree([plain_leaf(r) for r in rows])
    docs = spark.createDataFrame(rows, SCHEMA)
    for r in merkle_manifest.document_proofs(docs, {"leaf": F.col("text")}).collect():
        assert list(zip(r.places, r.siblings)) == plain_path(leaves, r.doc_id) and r._leaf == "T"


# --- URL filters -------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    after = rest[cut:]
    end = min([after.find(c) for c in "?#" if c in after] or [len(after)])
    return low(rest[:cut]), after[:end], after


def plain_glob(text):
    out = ""
    for c in text:
        out += ".*" if c == "*" else r"(?:[^\w.%-]|$)" if c == "^" else re.escape(c)
    return re.compile(out, re.I | re.S)


def plain_verdict(url, rules, default="allow"):
    host, path, after = plain_url(url)
    best = None
    for kind, verdict, text in rules if url and "://" in url else ():
        h, _, p = text.partition("/")
        if kind == "place":
            fits = (host == low(h) or host.endswith("." + low(h))) and ("/" not in text or path.startswith("/" + p))
        else:
            fits = plain_glob(text).search("://" + host + after) is not None
        if fits:
            best = max(best or (False,), (kind == "place", len(text), (text + "/").index("/"), verdict == "block", text, verdict))
    if best is None:
        return host, path, None, None, default
    return host, path, best[4] if best[0] else None, None if best[0] else best[4], best[5]


URLS = [
    None, "", "no scheme", "://", "http://", "http://ORG", "http://org/", "http://a.Org/x", "http://borg/x", "https://example.org?x=/es/",
    "http://example.org/es/", "http://www.EXAMPLE.org/es/a", "http://example.org/ES/", "http://example.org/en/1", "http://example.org/en/1999#top",
    "http://example.org/en/2", "http://x.example.org/en/12/es/", "http://notexample.org/es/", "http://example.org:80/es/", "http://u@example.org/es/",
    "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/fr/", "http://com/de/#x", "a://b://com/de/", "http://b.net/login", "http://b.net/login?x",
    "http://b.net/login.html", "http://b.net/Login/", "http://b.net/loginx", "http://b.net/a?page=2&ref=x", "http://b.net/a?page=2&amp;ref=x",
    "http://blog.b.net/a?page=2&ref=x", "http://m.b.net/z/print/", "http://b.net/914.html", "http://b.net/14.html9", "http://b.net/é/login/",
    "http://b.net/a?sessionid=1", "http://b.net/a?mysessionid=1", "http://b.net/x\ny/tag/q", "http://b.net/" + "a/" * 100_000 + "cart", "http://b.net/a?utm_source=feed",
]
MORE = [
    ("place", "block", "net"), ("place", "allow", "Deep.Sub.net/a.b/"), ("pattern", "block", "*"), ("pattern", "allow", "é/x"), ("pattern", "block", "b.net^"),
    ("pattern", "allow", "a+b"), ("pattern", "block", "(x)[y]"), ("pattern", "block", "never-seen-token/"), ("pattern", "allow", "seen.never/"), ("pattern", "block", "same/1"), ("pattern", "allow", "same/1"),
]


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    out = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules), **more)
    return {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in out.collect()}


@pytest.mark.parametrize("rules", [url_rules.RULES, [*url_rules.RULES, *MORE], MORE])
def test_urls_equal_every_rule_tried(spark, rules):
    rng = random.Random(5)
    bits = ["login", "same", "1", "é", "x", "a+b", "(x)[y]", "tag", "archive", "page=", "ref=", "a.b", "cart", "9", ".html"]
    urls = URLS + [
        f"http://{rng.choice(['m.', 'blog.', 'deep.sub.', ''])}{rng.choice(['b.net', 'net', 'example.org', 'x.com'])}/" + "".join(rng.choice(bits) + rng.choice("/?&^.-") for _ in range(4))
        for _ in range(200)
    ]
    assert judged(spark, urls, rules) == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_hot_urls_and_tokens_take_the_same_verdicts(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "HOT_ROWS", 5)
    monkeypatch.setattr(url_rules, "HOT_SHARE", 20)
    urls = URLS + ["http://example.org/es/hot"] * 60 + [None] * 40 + [f"http://h{i}.com/de/{i}" for i in range(50)]
    rules = [*url_rules.RULES, *MORE]
    assert judged(spark, urls, rules) == {i: plain_verdict(u, rules) for i, u in enumerate(urls)}


def test_a_rule_waits_under_its_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.org/es/x",), ("http://b.org/es/y",), ("http://c.org/fr/z",)], "url string")
    rules = url_rules.compiled(url_rules.rule_table(spark, [("place", "block", "org/es/"), ("place", "block", "a.org/es/"), ("pattern", "block", "/9*"), ("place", "block", "gone.org/")]))
    assert {r.text: (r.token, r.held) for r in url_rules.rule_index(urls, rules).collect()} == {
        "org/es/": ("es", 2), "a.org/es/": ("a", 1), "/9*": ("", None),
    }


def test_urls_of_empty_tables_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/de/", "kept", "too")], "page_id bigint, url string, host string, Verdict string")
    (row,) = url_rules.judge_urls(pages).collect()
    assert (row.host, row.Verdict, row["_host"], row["_verdict"], row.rule) == ("kept", "too", "a.com", "block", "com/de/")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    (row,) = url_rules.judge_urls(pages, url_rules.rule_table(spark).limit(0)).collect()
    assert (row["_verdict"], row.rule) == ("allow", None)


def test_urls_run_no_python(spark):
    plan = url_rules.op13_url_filters(spark, f"{ROOT}/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest", "op13_url_filters"])
def test_query_equals_oracle(spark, name):
    text, good = compare(spark, name, f"{ROOT}/sf0.001")
    assert good, text
