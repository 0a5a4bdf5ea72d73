"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a place (`example.org/es/`: a host with its subdomains and the start of a path) or a
pattern (`/login^`: literal text, `*` for any run, `^` for one separator or the end). Every text
that a rule matches holds the rule's whole literal tokens, so each rule waits under the one of
them that the fewest URLs hold; the tokens of a URL fetch the rules that wait under them, and
only these are run as regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.staging import free_name, staged

#: Places whose verdicts are given (fixed values).
PLACES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
#: Patterns that decide where no place does: pages that lead elsewhere or repeat others, and exceptions.
PATTERNS = [
    ("block", "/login^"), ("block", "/signup^"), ("block", "/cart^"), ("block", "/checkout^"), ("block", "/wp-admin/"), ("block", "/tag/"),
    ("block", "/search?"), ("block", "?replytocom="), ("block", "sessionid="), ("block", "?page=*&ref="), ("block", "?utm_source=feed^"),
    ("allow", "/archive/*?page="), ("block", "//m.*/print/"), ("block", "/9*.html"), ("allow", "//blog.*?page="),
]
RULES = [*(("place", v, t) for v, t in PLACES), *(("pattern", v, t) for v, t in PATTERNS)]
DEFAULT_VERDICT = "allow"
#: A URL or a token of more than this share of all URLs is hot: there are at most this many times the tokens of a URL.
HOT_SHARE = 4096
#: Fewer occurrences than this are never hot.
HOT_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a token: letters and digits, and everything beyond ASCII.
_TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _low(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """Lower-cased host behind the first "://"; empty for null or a URL without one."""
    return _low(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path behind the host, without query and fragment; empty for null or a URL without "://"."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules (kind, verdict, text) as a table; any table of these columns serves as well."""
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(v).alias("verdict"), F.lit(t).alias("text")) for k, v, t in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their regular expression and their literal tokens (lower case, whole tokens only).

    A place is matched against "://", host, path; a pattern against "://", host, and all that follows
    it. A token counts if other characters of the rule bound it on both sides: beside a wildcard or an
    open end it may be part of a longer one. Null texts and unknown kinds are no rules.
    """
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}/])", r"\\$1")
    slash = F.instr("text", "/")
    host = F.when(slash > 0, F.expr("substr(text, 1, instr(text, '/') - 1)")).otherwise(F.col("text"))
    path = F.when(slash > 0, F.expr("substr(text, instr(text, '/'))")).otherwise(F.lit(""))
    place = F.concat(F.lit(r"^://(?:[^/?#]*\.)?"), quoted(_low(host)), F.when(slash > 0, quoted(path)).otherwise(F.lit("(?:/|$)")))
    pattern = F.concat(F.lit("(?is)"), F.array_join(F.transform(
        F.split("text", r"\*"), lambda run: F.array_join(F.transform(F.split(run, r"\^"), quoted), r"(?:[^\p{L}\p{N}_.%-]|$)"),
    ), ".*"))
    # A mark behind each token that is bounded; the marks of wildcards and open ends stand for what may continue a token.
    bounded = F.when(F.col("kind") == "place", F.concat(F.lit("."), F.col("text"), F.when(slash > 0, F.lit("*")).otherwise(F.lit("/"))))
    spread = F.regexp_replace(_low(F.coalesce(bounded, F.concat(F.lit("*"), F.col("text"), F.lit("*")))), f"({_TOKEN})", " $1 ")
    tokens = F.array_distinct(F.regexp_extract_all(F.regexp_replace(spread, r"\* [^ ]+ | [^ ]+ \*", "*"), F.lit(f" ({_TOKEN}) "), 1))
    return rules.where(F.col("text").isNotNull() & F.col("kind").isin("place", "pattern")).select(
        "kind", "verdict", "text", F.when(F.col("kind") == "place", place).otherwise(pattern).alias("regex"), tokens.alias("tokens"),
    ).distinct()


def url_tokens(url: Column) -> Column:
    """Distinct lower-cased tokens of a URL, and the empty one, under which rules without tokens wait."""
    found = F.array_distinct(F.regexp_extract_all(_low(url), F.lit(f"({_TOKEN})"), 1))
    return F.concat(F.array(F.lit("")), found)


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule that can match: its rarest token over `urls` (url) and how many hold it.

    A rule with a token that no URL holds can't match and has no row.
    """
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(url_tokens(F.col("url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    counts = wanted.join(held, "token", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    keyed = rules.select("*", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    rarest = keyed.join(counts, "token", "left").groupBy("kind", "verdict", "text", "regex").agg(
        F.min(F.struct("held", "token")).alias("best"),
    )
    return rarest.select("kind", "verdict", "text", "regex", "best.token", F.col("best.held").alias("held")).where(
        F.coalesce(F.col("held"), F.lit(1)) > 0
    )


def _fetched(urls: DataFrame, index: DataFrame, total: int) -> DataFrame:
    """URLs beside the rules their tokens fetch. Rules of hot tokens are copied, their URLs dealt to the copies.

    Tokens in more than 1 / HOT_SHARE of the URLs are at most HOT_SHARE times the tokens of a URL.
    """
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = [r.token for r in index.where((F.col("held") > most) | (F.col("token") == "")).select("token").distinct().collect()]
    spots = urls.select("url", "n", F.explode(url_tokens(F.col("url"))).alias("token"))
    if total <= most or not hot:
        return spots.join(index, "token")
    salts = 1 + total // most
    salted = spots.withColumn("salt", F.when(F.col("token").isin(hot), F.pmod(F.xxhash64("url"), F.lit(salts))).otherwise(0))
    copies = F.when(F.col("token").isin(hot), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return salted.join(index.withColumn("salt", F.explode(copies)), ["token", "salt"])


def url_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs that a rule matches: url, rule (the place, or null), pattern (or null) and verdict.

    Among matching places the longest decides, then the longer host; without one the longest pattern.
    Equal lengths and hosts: block before allow, then the greater text. `urls`: url, n (its rows).
    """
    total = urls.count()
    index = staged(rule_index(urls, compiled(rules)), "url-rule-index")
    url = F.col("url")
    after = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    head = F.concat(F.lit("://"), host_of(url))
    subject = F.concat(head, F.when(F.col("kind") == "place", path_of(url)).otherwise(after))
    matched = _fetched(urls, index, total).where(url.contains("://") & F.regexp(subject, F.col("regex")))
    rank = F.struct(
        (F.col("kind") == "place").alias("place"), F.length("text").alias("length"), F.instr(F.concat("text", F.lit("/")), "/").alias("host"),
        (F.col("verdict") == "block").alias("block"), "text", "verdict",
    )
    best = matched.groupBy("url", "n").agg(F.max(rank).alias("won"))
    return best.select(
        "url", "n", F.when(F.col("won.place"), F.col("won.text")).alias("rule"), F.when(~F.col("won.place"), F.col("won.text")).alias("pattern"), "won.verdict",
    )


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """All rows and columns of `pages`, host, path, rule, pattern and verdict.

    Each distinct URL is judged once, so a URL of a third of all rows is one row in every step but the
    last join; there the verdicts of the few hot URLs are broadcast (fewer than HOT_SHARE, by their
    share) and the others are joined. Null and empty URLs and those without "://" match nothing: empty
    host and path, null rule, the default verdict. Repeated rows stay; very long URLs are matched whole.
    No pages: no rows; no rules: all get the default. Clashing input columns stay; the new ones are prefixed with "_" then.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    url = F.col(url_col)
    urls = staged(pages.where(url.isNotNull()).groupBy(url.alias("url")).agg(F.count(F.lit(1)).alias("n")), "urls")
    rows = urls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_ROWS, rows // HOT_SHARE)
    judged = staged(url_verdicts(urls, rules).withColumnRenamed("url", "_judged_url"), "url-verdicts")
    kept = pages.columns
    host, path, rule, pattern, verdict = (free_name(pages, c) for c in ("host", "path", "rule", "pattern", "verdict"))

    def finished(found: DataFrame) -> DataFrame:
        return found.select(
            *[F.col(f"p.`{c}`") for c in kept], host_of(F.col(f"p.`{url_col}`")).alias(host), path_of(F.col(f"p.`{url_col}`")).alias(path),
            F.col("v.rule").alias(rule), F.col("v.pattern").alias(pattern), F.coalesce("v.verdict", F.lit(default)).alias(verdict),
        )

    def beside(part: DataFrame, verdicts: DataFrame) -> DataFrame:
        return finished(part.alias("p").join(verdicts.alias("v"), F.col(f"p.`{url_col}`") == F.col("v._judged_url"), "left"))

    if rows <= most:
        return beside(pages, judged)
    hot = urls.where(F.col("n") > most).select(F.col("url").alias("_hot_url"))
    known = pages.join(F.broadcast(hot), url == F.col("_hot_url"), "left_semi")
    # Null URLs fall on neither side of an anti join by value; they are spread by leaving the join out.
    others = pages.where(url.isNotNull()).join(F.broadcast(hot), url == F.col("_hot_url"), "left_anti")
    empty = pages.where(url.isNull()).alias("p").select(
        *[F.col(f"p.`{c}`") for c in kept], F.lit("").alias(host), F.lit("").alias(path), F.lit(None).cast("string").alias(rule),
        F.lit(None).cast("string").alias(pattern), F.lit(default).alias(verdict),
    )
    return beside(known, F.broadcast(judged.where(F.col("n") > most))).unionByName(beside(others, judged)).unionByName(empty)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*(.*)$', 1, 's'), '') AS rest, coalesce(contains(url, '://'), false) AS whole
  FROM pages),
p AS (SELECT *, '://' || host || rest AS subject, row_number() OVER () AS r FROM cut),
places(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT r, arg_max(h || f, length(h || f)) AS rule, arg_max(v, length(h || f)) AS verdict
  FROM p JOIN places ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) WHERE whole GROUP BY r),
patterns(t, x, v) AS (VALUES
  ('/login^', '/login([^a-z0-9_.%-]|$)', 'block'), ('/signup^', '/signup([^a-z0-9_.%-]|$)', 'block'), ('/cart^', '/cart([^a-z0-9_.%-]|$)', 'block'),
  ('/checkout^', '/checkout([^a-z0-9_.%-]|$)', 'block'), ('/wp-admin/', '/wp-admin/', 'block'), ('/tag/', '/tag/', 'block'), ('/search?', '/search[?]', 'block'),
  ('?replytocom=', '[?]replytocom=', 'block'), ('sessionid=', 'sessionid=', 'block'), ('?page=*&ref=', '[?]page=.*&ref=', 'block'),
  ('?utm_source=feed^', '[?]utm_source=feed([^a-z0-9_.%-]|$)', 'block'), ('/archive/*?page=', '/archive/.*[?]page=', 'allow'), ('//m.*/print/', '//m[.].*/print/', 'block'),
  ('/9*.html', '/9.*[.]html', 'block'), ('//blog.*?page=', '//blog[.].*[?]page=', 'allow')),
matches AS (
  SELECT r, t, v FROM p JOIN patterns ON regexp_matches(subject, x, 'is') WHERE whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY length(t) DESC, instr(t || '/', '/') DESC, v = 'block' DESC, t DESC) AS k FROM matches)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN m.t END AS pattern, coalesce(fits.verdict, m.v, 'allow') AS verdict
FROM p LEFT JOIN fits USING (r) LEFT JOIN (SELECT * FROM ranked WHERE k = 1) m USING (r)
"""
