from datetime import datetime

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions import vectors
from tests.conftest import rows


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("v")).first()[0]


def test_titles(spark):
    cases = {
        "What is the capital of France?": "Capital of France",
        "Can you please explain how HNSW works?": "Explain how HNSW",
        "explain the attention mechanism in transformers. And more": "Attention Mechanism in Transformers",
        "```python\ncode\n```\n# Heading *here*": "Heading Here",
        "how does it work": "It",
        "please tell me about": "Please Tell me",
        "one two three four five six seven eight": "One two Three Four Five six",
        "": "New chat", "   \n  ": "New chat", "```only code```": "New chat", "???": "???",
        "a" * 80: "A" + "a" * 58 + "…",
    }
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    got = {r[0]: r[1] for r in rows(df.select("m", X.generate_title(F.col("m"))))}
    assert got == cases
    assert spark.sql("select cast(null as string) m").select(X.generate_title(F.col("m"))).first()[0] == "New chat"


def test_search_snippet(spark):
    text = "x" * 100 + "Needle" + "y" * 300
    got = one(spark, X.search_snippet(F.col("t"), F.col("q")), t=text, q="nEEDLE")
    assert got == "…" + text[60:220] + "…"
    assert one(spark, X.search_snippet(F.col("t"), F.col("q")), t="short text", q="zz") == "short text"


def test_search_term_limits(spark):
    df = spark.createDataFrame([(" a ",), ("  ab ",), ("%",), ("x" * 101,), (None,)], "t string")
    assert [r[0] for r in rows(df.select(X.search_term(F.col("t"))))] == [None, "ab", None, "x" * 100, None]
    assert one(spark, X.ilike_contains(F.col("t"), F.col("q")), t="Hello World", q="o_w") is True
    assert one(spark, X.ilike_contains(F.col("t"), F.col("q")), t="Hello", q="l%o") is True


def test_small_functions(spark):
    cases = [
        (X.normalise_model_id, [
            ("C:\\hub\\models--org--name\\snapshots\\x", "org/name"), ("/cache/models--a--b/s", "a/b"), ("/m/local/", "local"),
            ("org/name", "org/name"), ("", "unknown"), (None, "unknown"),
        ]),
        (X.host_of_url, [("https://www.Example.com:8080/a", "example.com"), ("not a url", None), ("http://x.org", "x.org")]),
        (X.critic_score, [("**Score: 7.5/10**", 7.5), ("Score: 7", None), ("**Score: 7.5.1/10**", None)]),
        (X.error_class, [
            ("HTTP 429", "LLM_RATE_LIMITED"), ("Rate Limit and 503", "LLM_RATE_LIMITED"), ("502 bad", "LLM_UNAVAILABLE"),
            ("Invalid API key", "LLM_AUTH_FAILED"), ("request timed out", "LLM_TIMEOUT"), ("boom", "LLM_FAILED"),
        ]),
        (X.display_name, [("a/b/report.final.PDF", "report.final"), (".env", ".env"), ("noext", "noext"), ("x" * 130 + ".txt", "x" * 120)]),
        (X.file_extension, [("A.TXT", ".txt"), (".env", ""), ("dir.v1/name", ""), ("a.tar.gz", ".gz")]),
    ]
    for function, pairs in cases:
        df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string").orderBy("i")
        assert [r[0] for r in rows(df.select(function(F.col("a"))))] == [b for _, b in pairs], function.__name__


def test_rewrite_bounds(spark):
    df = spark.createDataFrame([("q", x) for x in (' "better" ', "", None, "y" * 401, "y" * 400)], "q string, r string")
    assert [r[0] for r in rows(df.select(X.clean_rewrite(F.col("q"), F.col("r"))))] == ["better", "q", "q", "q", "y" * 400]


def test_relative_day(spark):
    now = datetime(2024, 3, 31, 1, 0)
    days = [datetime(2024, 4, 1), datetime(2024, 3, 31), datetime(2024, 3, 30, 23, 59), datetime(2024, 3, 24), datetime(2024, 3, 1), datetime(2024, 2, 29), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d timestamp").orderBy("i")
    got = [r[0] for r in rows(df.select(X.relative_day(F.col("d"), F.lit(now))))]
    assert got == ["Today", "Today", "Yesterday", "Previous 7 days", "Previous 30 days", "Older", "Older"]


def test_json_number_keeps_numbers_only(spark):
    df = spark.createDataFrame([('{"page":3}',), ('{"page":"3"}',), ('{"page":true}',), ("{bad",), ('{"x":1}',)], "j string")
    assert [r[0] for r in rows(df.select(X.json_number(F.col("j"), "page")))] == [3.0, None, None, None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = df.select(
        vectors.l2_norm(F.col("a")), vectors.cosine_distance(F.col("a"), F.col("b")), vectors.relevance(F.lit(-1.0)),
        vectors.vector_literal(F.col("a")), vectors.parse_vector_literal(F.lit("[1,2.5]")),
    ).first()
    assert row[0] == 5.0 and abs(row[1] - 0.04) < 1e-12 and row[2] == 1.0 and row[3] == "[3.0,4.0]" and row[4] == [1.0, 2.5]


def test_search_terms_with_wildcards_and_backslashes(spark):
    texts = ["path C:\\data", "path C:data", "100% sure", "100x sure", "a_b", "axb", "ends with %"]
    cases = {
        "c:\\data": ["path C:data"], "c:\\\\data": ["path C:\\data"], "100\\%": ["100% sure"], "100%": ["100% sure", "100x sure"],
        "a_b": ["a_b", "axb"], "a\\_b": ["a_b"], "with \\": ["ends with %"], "SURE": ["100% sure", "100x sure"],
    }
    df = spark.createDataFrame([(t, q) for t in texts for q in cases], "t string, q string")
    found = rows(df.filter(X.ilike_contains(F.col("t"), F.col("q"))), "q", "t")
    assert {q: sorted(t for k, t in found if k == q) for q in cases} == {q: sorted(v) for q, v in cases.items()}


def test_visible_text_of_awkward_pages(spark):
    from corpusflow.sources import web

    pages = {
        '<p title="a > b">x</p>': "x", "<a href='?x>y'>link</a> tail": "link tail", "<p>one<script>var a = 1;": "one",
        "<b class=it's>q</b>": "q", "a < b and c": "a < b and c", "<SCRIPT x='1'>no</script >yes": "yes",
    }
    df = spark.createDataFrame([(k,) for k in pages], "html string")
    assert dict(rows(df, "html", web.page_text(F.col("html")))) == pages
