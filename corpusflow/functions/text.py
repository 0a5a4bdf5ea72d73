"""Text expressions: titles, snippets, identifiers, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import schemas as S

# Every character that counts as white space when a text is trimmed, as a class and as a trim set.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACE_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body(value)``.

    Without this, a long chain of expressions that each mention the previous one several times is
    copied into every place a filter is pushed to.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(text, F.lit(SPACE_CHARS))


# Lead-in phrases removed from the front of a title (first match wins).
TITLE_LEAD_INS = [
    r"^(please\s+)?(can|could|would)\s+you\s+(please\s+)?",
    r"^(please\s+)?(tell|teach)\s+me\s+(about|how|why|what)?\s*",
    r"^(please\s+)?(explain|describe|summarise|summarize|compare|list|define)\s+(me\s+)?(the\s+|a\s+|an\s+)?",
    r"^(what|which)\s+(is|are|was|were|does|do|did)\s+(the\s+|a\s+|an\s+)?",
    r"^how\s+(does|do|did|can|could|would|is|are)\s+(the\s+|a\s+|an\s+)?",
    r"^(why|when|where|who)\s+(is|are|was|were|does|do|did|should)\s+(the\s+|a\s+|an\s+)?",
    r"^i\s+(want|need|would like)\s+to\s+(know|understand)\s+(about\s+)?",
    r"^give\s+me\s+(a\s+|an\s+)?",
]
# Words that add nothing at the end of a title.
TITLE_TRAILING_NOISE = [
    "work", "works", "working", "do", "does", "mean", "means", "used", "use", "about", "for",
    "in", "of", "the", "a", "an", "and", "or", "to", "is", "are",
]
TITLE_WORDS = 6


def _title_words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: F.length(w) > 0)


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.right(text, F.length(text) - 1))


def _without_lead_in(sentence: Column) -> Column:
    """The sentence without its first matching lead-in that leaves something."""
    stripped = F.array(*[F.regexp_replace(sentence, "(?i)" + p, "") for p in TITLE_LEAD_INS])
    shorter = F.filter(stripped, lambda x: (x != sentence) & (F.length(strip(x)) > 0))
    return F.coalesce(F.get(shorter, F.lit(0)), sentence)


def _useful_words(words: Column) -> Column:
    """Words up to the last one that is not noise; the first always stays."""
    noise = F.array(*[F.lit(w) for w in TITLE_TRAILING_NOISE])
    last = F.array_max(
        F.transform(words, lambda w, i: F.when(F.array_contains(noise, F.lower(w)), F.lit(1)).otherwise(i + 1))
    )
    return F.when(F.size(words) > 0, F.slice(words, F.lit(1), last)).otherwise(words)


def _finished_title(words: Column, fallback: str, max_length: int) -> Column:
    cased = F.transform(
        F.slice(words, 1, TITLE_WORDS), lambda w: F.when(F.length(w) > 3, _capital(w)).otherwise(w)
    )
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, max_length - 1)), F.lit("…"))
    full = let(F.array_join(cased, " "), lambda t: _capital(F.when(F.length(t) > max_length, cut(t)).otherwise(t)))
    return F.when(F.size(words) > 0, full).otherwise(F.lit(fallback))


def generate_title(message: Column, fallback: str = "New chat", max_length: int = S.MAX_TITLE_LENGTH) -> Column:
    """A short title from the first user message."""
    plain = F.regexp_replace(F.regexp_replace(message, r"(?s)```.*?```", " "), r"[#*_`>~|]", " ")
    line = F.get(F.filter(F.transform(F.split(plain, "\n"), strip), lambda x: F.length(x) > 0), F.lit(0))
    sentence = F.get(F.split(F.regexp_replace(line, SPACE, " "), r"(?<=[.?!]) "), F.lit(0))

    def titled(text: Column) -> Column:
        bare = F.regexp_replace(_without_lead_in(text), r"[?!.,;:]+$", "")
        return let(
            let(_title_words(bare), lambda w: F.when(F.size(w) > 0, _useful_words(w)).otherwise(_title_words(message))),
            lambda w: _finished_title(w, fallback, max_length),
        )

    return let(sentence, lambda text: F.when(text.isNull(), F.lit(fallback)).otherwise(titled(text)))


def search_snippet(text: Column, term: Column) -> Column:
    """160 characters starting 40 before the first literal hit, with ellipses on cut sides."""

    def cut(start: Column) -> Column:
        return F.concat(
            F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
            strip(F.substring(text, start + 1, F.lit(160))),
            F.when(start + 160 < F.length(text), F.lit("…")).otherwise(F.lit("")),
        )

    return let(F.greatest(F.lit(0), F.position(F.lower(term), F.lower(text)) - 41), cut)


def snippet(text: Column, n: int = S.SNIPPET_CHARS) -> Column:
    return F.substring(text, 1, n)


# A backslash before an ordinary character: the search language lets it pass, the engine refuses it.
_IDLE_ESCAPE = r"(?s)\G((?:[^\\]|\\[%_\\])*)\\([^%_\\])"


def ilike_contains(text: Column, term: Column) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the term act as wildcards, a backslash
    takes the next character literally (at the end of the term: the closing wildcard).

    Terms without these characters are plain substring tests; no pattern is built for them.
    """
    pattern = F.regexp_replace(F.concat(F.lit("%"), term, F.lit("%")), _IDLE_ESCAPE, "$1$2")
    plain = ~F.rlike(term, F.lit(r"[%_\\]"))
    return F.when(plain, F.contains(F.lower(text), F.lower(term))).otherwise(F.ilike(text, F.when(~plain, pattern)))


def search_term(term: Column) -> Column:
    """Trimmed term of at most 100 characters; null when shorter than two."""
    clean = strip(F.coalesce(term, F.lit("")))
    return F.when(F.length(clean) >= 2, F.substring(clean, 1, 100))


def normalise_model_id(value: Column) -> Column:
    """Hub id of a snapshot path, last segment of an absolute path, otherwise unchanged."""
    text = F.replace(value, F.lit("\\"), F.lit("/"))
    hub = F.replace(F.regexp_extract(text, r"models--([^/]*)", 1), F.lit("--"), F.lit("/"))
    last = F.regexp_extract(text, r"([^/]*)/*$", 1)
    absolute = F.contains(text, F.lit("/")) & (F.contains(text, F.lit(":")) | F.startswith(text, F.lit("/")))
    return (
        F.when(value.isNull() | (value == ""), F.lit("unknown"))
        .when(F.contains(text, F.lit("models--")), hub)
        .when(absolute, last)
        .otherwise(text)
    )


def file_extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty without one; a leading dot is part of the name."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+?(\.[^.]*)$", 1))


def display_name(name: Column) -> Column:
    """Base name without extension, at most 120 characters, or the file name itself."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.substring(stem, 1, 120), F.lit("")), name)


def storage_key(user_id: Column, name: Column, unique: Column) -> Column:
    """Per-user object key; ``unique`` (a content hash) makes repeated runs write the same key."""
    return F.concat(
        F.lit("users/"), user_id, F.lit("/"), F.substring(unique, 1, 32),
        F.substring(file_extension(name), 1, 12),
    )


def host_of_url(url: Column) -> Column:
    """Host name without ``www.``, null for an invalid address."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def clean_rewrite(question: Column, rewritten: Column) -> Column:
    """The rewritten query when it has 1 to 400 characters without its quotes, else the question."""
    clean = F.regexp_replace(strip(F.coalesce(rewritten, F.lit(""))), '^"+|"+$', "")
    return F.when(F.length(clean).between(1, 400), clean).otherwise(question)


def critic_score(text: Column) -> Column:
    found = F.regexp_extract(text, r"\*\*Score:\s*([\d.]+)/10\*\*", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


# Error codes with the marks that select them, in order of precedence.
# Marks in the first list are searched as written, marks in the second ignoring case.
ERROR_CLASSES = [
    ("LLM_RATE_LIMITED", ["429"], ["rate limit"]),
    ("LLM_UNAVAILABLE", ["503", "502"], ["unavailable"]),
    ("LLM_AUTH_FAILED", ["401"], ["unauthor", "api key"]),
    ("LLM_TIMEOUT", [], ["timeout", "timed out"]),
]


def error_class(text: Column) -> Column:
    lowered = F.lower(text)
    out = F.when(F.lit(False), F.lit(None))
    for code, exact, folded in ERROR_CLASSES:
        hit = F.lit(False)
        for mark in exact:
            hit = hit | F.contains(text, F.lit(mark))
        for mark in folded:
            hit = hit | F.contains(lowered, F.lit(mark))
        out = out.when(hit, F.lit(code))
    return out.otherwise(F.lit("LLM_FAILED"))


# Day labels in display order.
DAY_LABELS = ["Today", "Yesterday", "Previous 7 days", "Previous 30 days", "Older"]


def relative_day(ts: Column, as_of: Column) -> Column:
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    return (
        F.when(days <= 0, DAY_LABELS[0]).when(days == 1, DAY_LABELS[1])
        .when(days <= 7, DAY_LABELS[2]).when(days <= 30, DAY_LABELS[3]).otherwise(DAY_LABELS[4])
    )


def expires_at(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def retrieval_cache_key(user_id: Column, query: Column, document_ids: Column, allow_weak: Column) -> Column:
    """Private key: owner, query, sorted document scope and the weak-match flag."""
    ids = F.coalesce(F.array_join(F.sort_array(document_ids.cast("array<string>")), ","), F.lit(""))
    weak = F.when(allow_weak, F.lit("1")).otherwise(F.lit("0"))
    body = F.concat(query, F.lit("::"), ids, F.lit("::weak="), weak)
    return F.concat(F.lit("cache:retrieval:"), user_id, F.lit(":"), _short_hash(body))


def embedding_cache_key(text: Column) -> Column:
    return F.concat(F.lit("cache:embed:"), _short_hash(text))


def web_cache_key(query: Column) -> Column:
    return F.concat(F.lit("cache:web:"), _short_hash(strip(F.lower(query))))


def client_ip(forwarded: Column, address: Column) -> Column:
    """First forwarded address, else the socket address, else ``unknown``."""
    first = strip(F.get(F.split(F.nullif(forwarded, F.lit("")), ","), F.lit(0)))
    return F.coalesce(first, F.nullif(address, F.lit("")), F.lit("unknown"))


def json_number(json: Column, field: str) -> Column:
    """A numeric JSON field; strings and other types give null."""
    value = F.try_variant_get(F.try_parse_json(json), f"$.{field}", "double")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{field}", "variant"))
    return F.when(~kind.isin("STRING", "BOOLEAN"), value)


def json_text(json: Column, field: str) -> Column:
    return F.get_json_object(json, f"$.{field}")
