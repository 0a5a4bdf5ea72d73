"""Rule-based question routing as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import SPACE, let, strip

# Signal patterns, matched ignoring case (unless marked) on ASCII word boundaries.
DOCUMENT_SIGNALS = [
    r"\b(my|our|the|this|that|attached|uploaded)\s+(document|doc|file|pdf|paper|report|slides?|presentation|deck|contract|notes?|manual|book|spreadsheet)s?\b",
    r"\b(in|from|according to|based on)\s+(the|my|this|that)\s+(document|doc|file|pdf|paper|report|slides?|attachment)s?\b",
    r"\bi\s+(uploaded|attached|shared|added)\b",
    r"\b(summar[iy]|summarise|summarize)\s+(the|my|this)\s+(document|doc|file|pdf|paper|report|slides?)\b",
    r"\bwhat does (it|the (document|pdf|file|paper|report)) say\b",
    r"\b(page|chapter|section|slide)\s+\d+\b",
]
WEB_SIGNALS = [
    r"\b(latest|newest|recent|recently|current|currently|today|todays|tonight|yesterday|this (week|month|year)|right now|as of now|up to date|up-to-date)\b",
    r"\b(news|headlines|announcement|released?|launch(ed)?|update[ds]?)\b",
    r"\b(price|stock|share price|exchange rate|weather|forecast|score|standings|election|who won)\b",
    r"\b(box[- ]?office|collections?|gross(ed|ing)?|earnings|revenue|takings|ticket sales)\b",
    r"\b(opening (day|weekend|night)|first (day|weekend)|footfalls?)\b",
    r"\b(worldwide|domestic|overseas|lifetime)\s+(gross|collection|total|earnings|box[- ]?office)\b",
    r"\b(?-i:in|since|during)\s+20(2[4-9]|[3-9]\d)\b",
    r"\b(state of the art|sota)\b",
    r"\bwhat('s| is) (happening|new|going on)\b",
    r"\b(search|google|look ?up)\s+(the\s+)?(web|online|internet)\b",
]
FRESH_DATA_SIGNALS = [
    r"\b(box[- ]?office|collections?|gross(ed|ing)?|earnings|revenue|ticket sales)\b",
    r"\b(latest|current|currently|today|todays|recent|recently|right now|as of now)\b",
    r"\b(news|headlines|price|stock|share price|exchange rate|weather|forecast|score|standings)\b",
]
HYBRID_SIGNALS = [
    r"\bcompare\b[\s\S]{0,60}\b(with|to|against|versus|vs\.?)\b",
    r"\b(how does|how do)\b[\s\S]{0,40}\bcompare\b",
    r"\b(my|our|the|this)\s+\w*\s*(document|doc|file|pdf|paper|report|research|work|approach|method)\b[\s\S]{0,60}\b(latest|current|recent|modern|today|state of the art|industry|others?)\b",
    r"\b(latest|current|recent)\b[\s\S]{0,60}\b(my|our|the attached|the uploaded)\s+(document|doc|file|pdf|paper|report|research)\b",
]
GENERAL_SIGNALS = [
    r"^\s*(what|who|when|where|why|how)\s+(is|are|was|were|does|do|did|can|could|should)\b",
    r"^\s*(explain|define|describe|tell me about|teach me|give me an example)\b",
    r"\b(what is|define|meaning of)\s+\w+",
    r"\b(write|generate|create|draft|refactor|debug|fix|translate|rewrite)\b",
]
TRIVIAL_SIGNALS = [
    r"^\s*(hi|hey|hello|yo|thanks?|thank you|ok(ay)?|cool|nice|great|got it|sure|bye|good (morning|evening|night))\b[\s!.?]*$",
    r"^\s*(who are you|what can you do|help)\b[\s?]*$",
]
ROUTES = ["llm", "documents", "web", "hybrid"]


def plain_ascii(text: Column) -> Column:
    """Text on which word boundaries are ASCII ones: other letters become a separator mark."""
    return F.regexp_replace(F.regexp_replace(text, SPACE, " "), r"[^\x00-\x7F]", "·")


def signal_hits(text: Column, patterns: list[str]) -> Column:
    """How many patterns of a family occur in the (ASCII-normalised) text."""
    hits = F.lit(0)
    for pattern in patterns:
        hits = hits + F.rlike(text, F.lit("(?i)" + pattern)).cast("int")
    return hits


def needs_fresh_data(message: Column) -> Column:
    return let(
        plain_ascii(F.coalesce(message, F.lit(""))), lambda text: signal_hits(text, FRESH_DATA_SIGNALS) > 0
    )


def signals(message: Column) -> Column:
    """Struct of hit counts per family."""

    def counted(text: Column) -> Column:
        return F.struct(
            (F.length(text) == 0).alias("empty"),
            signal_hits(text, TRIVIAL_SIGNALS).alias("trivial_hits"),
            signal_hits(text, DOCUMENT_SIGNALS).alias("document_hits"),
            signal_hits(text, WEB_SIGNALS).alias("web_hits"),
            signal_hits(text, HYBRID_SIGNALS).alias("hybrid_hits"),
            signal_hits(text, GENERAL_SIGNALS).alias("general_hits"),
            signal_hits(text, FRESH_DATA_SIGNALS).alias("fresh_hits"),
        )

    return let(plain_ascii(strip(F.coalesce(message, F.lit("")))), counted)


def with_signals(df: DataFrame, message: str = "message") -> DataFrame:
    return df.withColumn("_s", signals(F.col(message))).select(*df.columns, "_s.*").drop("empty")


def _decision(route: Column | str, confidence: Column | float, reason: Column | str) -> Column:
    as_column = lambda value: value if isinstance(value, Column) else F.lit(value)
    return F.struct(
        as_column(route).alias("route"), as_column(confidence).alias("confidence"), as_column(reason).alias("reason")
    )


def rule_decision(hits: Column) -> Column:
    """Decision struct of the rules alone; null when the signals are too weak."""
    doc, web = hits["document_hits"], hits["web_hits"]
    both = "refers to the user documents and to current information"
    return (
        F.when(hits["empty"], _decision("llm", 1.0, "empty message"))
        .when(hits["trivial_hits"] > 0, _decision("llm", 0.99, "conversational message"))
        .when(hits["hybrid_hits"] > 0, _decision("hybrid", 0.9, both))
        .when((doc > 0) & (web > 0), _decision("hybrid", 0.75, both))
        .when(doc > 1, _decision("documents", 0.95, "refers to the user documents"))
        .when(doc > 0, _decision("documents", 0.85, "refers to the user documents"))
        .when(web > 1, _decision("web", 0.95, "asks for current information"))
        .when(web > 0, _decision("web", 0.8, "asks for current information"))
        .when(hits["general_hits"] > 0, _decision("llm", 0.7, "general knowledge question"))
    )


def apply_availability(decision: Column, has_documents: Column, web_enabled: Column) -> Column:
    """Downgrade a route that cannot be served."""
    no_documents, no_web = "; no documents available", "; web search unavailable"

    def judged(d: Column) -> Column:
        def moved(target: str, note: str) -> Column:
            return _decision(target, d["confidence"], F.concat(d["reason"], F.lit(note)))

        hybrid = d["route"] == "hybrid"
        return (
            F.when(hybrid & ~has_documents & web_enabled, moved("web", no_documents))
            .when(d["route"].isin("documents", "hybrid") & ~has_documents, moved("llm", no_documents))
            .when(hybrid & ~web_enabled, moved("documents", no_web))
            .when((d["route"] == "web") & ~web_enabled, moved("llm", no_web))
            .otherwise(d)
        )

    return let(decision, judged)


def _fresh_override(decision: Column, fresh: Column, has_documents: Column, web_enabled: Column) -> Column:
    """A figure that changes daily is never answered from memory while a search is possible."""

    def judged(d: Column) -> Column:
        upgraded = _decision(
            F.when((d["route"] == "documents") & has_documents, F.lit("hybrid")).otherwise(F.lit("web")),
            F.greatest(d["confidence"], F.lit(0.9)),
            F.concat(d["reason"], F.lit("; overridden - needs current information")),
        )
        return F.when(web_enabled & fresh & ~d["route"].isin("web", "hybrid"), upgraded).otherwise(d)

    return let(decision, judged)


def route_decision(
    message: Column, has_documents: Column, has_attachment: Column, web_enabled: Column, force_web: Column,
    label: Column | None = None,
) -> Column:
    """Struct (route, confidence, reason, requires_fresh_data) of one message.

    ``label`` is the answer of a classifier for messages the rules leave open.
    """
    default = F.when(
        has_documents, _decision("documents", 0.4, "defaulting to the user documents")
    ).otherwise(_decision("llm", 0.5, "no retrieval signal detected"))
    if label is not None:
        found = F.nullif(F.regexp_extract(F.lower(label), "llm|documents|web|hybrid", 0), F.lit(""))
        default = let(
            found,
            lambda f: F.when(f.isNotNull(), _decision(f, 0.7, "classified by the language model")).otherwise(default),
        )
    force = force_web & web_enabled

    def decided(hits: Column) -> Column:
        fresh = hits["fresh_hits"] > 0
        wants_web = ((hits["web_hits"] > 0) | (hits["hybrid_hits"] > 0)) & web_enabled
        forced = _decision(
            F.when(has_attachment, F.lit("hybrid")).otherwise(F.lit("web")), 1.0, "the user asked for a web search"
        )
        attached = _decision(
            F.when(wants_web, F.lit("hybrid")).otherwise(F.lit("documents")), 0.99,
            "a document was attached to this message",
        )
        base = F.coalesce(rule_decision(hits), default)
        ruled = apply_availability(
            _fresh_override(base, fresh, has_documents, web_enabled), has_documents, web_enabled
        )
        final = F.when(force, forced).when(has_attachment, attached).otherwise(ruled)
        # The attachment shortcut carries no freshness flag.
        flag = F.when(force, F.lit(True)).when(has_attachment, F.lit(None).cast("boolean")).otherwise(fresh)
        return F.struct(final.alias("d"), flag.alias("requires_fresh_data"))

    return let(signals(message), decided)


def route_messages(messages: DataFrame, message: str = "message", labels: DataFrame | None = None) -> DataFrame:
    """Route of every message.

    Input flags (missing ones take the default): has_documents, has_attachment, force_web (false),
    web_enabled (true). ``labels`` (message_id, label) answers for messages the rules leave open,
    in place of a model call.
    """
    df, label = messages, None
    if labels is not None:
        df = df.join(labels.select("message_id", F.col("label").alias("_label")), "message_id", "left")
        label = F.col("_label")

    def flag(name: str, default: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in messages.columns else F.lit(default)

    decision = route_decision(
        F.col(message), flag("has_documents", False), flag("has_attachment", False),
        flag("web_enabled", True), flag("force_web", False), label,
    )
    return df.withColumn("_r", decision).select(
        *messages.columns, F.col("_r.d.route").alias("route"), F.col("_r.d.confidence").alias("confidence"),
        F.col("_r.d.reason").alias("reason"), F.col("_r.requires_fresh_data").alias("requires_fresh_data"),
    )


def retrieval_mode(route: Column) -> Column:
    """Route to the retrieval mode of the answering step."""
    modes = {"documents": "document", "web": "web", "hybrid": "hybrid"}
    table = F.create_map(*[F.lit(x) for pair in modes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, route), F.lit("llm"))
