"""Registered queries: each applies one operator to the whole model tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow import views as V
from corpusflow.functions import text as TX
from corpusflow.functions import vectors as VF
from corpusflow.operators import anchored as AN
from corpusflow.operators import chunk_store as CS
from corpusflow.operators import chunking as CH
from corpusflow.operators import constraints as C
from corpusflow.operators import context as X
from corpusflow.operators import conversations as K
from corpusflow.operators import embedding as EM
from corpusflow.operators import folds as FO
from corpusflow.operators import library as L
from corpusflow.operators import mutations as M
from corpusflow.operators import retrieval as R
from corpusflow.operators import routing as RT
from corpusflow.plans import ingest as I
from corpusflow.plans import turns as T
from corpusflow.session import shared_dir, staged
from corpusflow.sources import event_logs as SE
from corpusflow.sources import files as SF
from corpusflow.sources import office as SO
from corpusflow.sources import pages as SP
from corpusflow.sources import text_files as ST
from corpusflow.sources import web as SW
from corpusflow.streaming import jobs as J

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- retrieval ---------------------------------------------------------------


def _plain_questions(spark, folder):
    return V.questions(spark, folder).drop("scope", "allow_weak")


@query
def knn_topk(spark, folder):
    found = R.cosine_knn(_plain_questions(spark, folder), V.chunks(spark, folder), V.documents(spark, folder))
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 4).alias("distance"))


@query
def retrieve_sources(spark, folder):
    found = R.retrieve(_plain_questions(spark, folder), V.chunks(spark, folder), V.documents(spark, folder))
    return found.select(
        "query_id", "index", "chunk_id", "document_id", "document_name", "page", "slide",
        "paragraph", "line", "section", "slide_title", "chunk_index", "snippet", "score", "distance",
    )


@query
def retrieve_no_weak(spark, folder):
    found = R.retrieve(
        _plain_questions(spark, folder), V.chunks(spark, folder), V.documents(spark, folder),
        max_distance=0.6, allow_weak=False,
    )
    return found.select("query_id", "index", "chunk_id", "score", "distance")


@query
def retrieve_scoped(spark, folder):
    found = R.retrieve(
        V.questions(spark, folder), V.chunks(spark, folder), V.documents(spark, folder), max_distance=0.5
    )
    return found.select("query_id", "index", "chunk_id", "score", "distance")


@query
def knn_l2(spark, folder):
    return R.l2_retrieve(_plain_questions(spark, folder), V.chunks(spark, folder), max_distance=0.9)


@query
def score_threshold(spark, folder):
    return R.score_threshold_retrieve(_plain_questions(spark, folder), V.chunks(spark, folder))


@query
def approx_knn(spark, folder):
    found = R.approx_knn(_plain_questions(spark, folder), V.chunks(spark, folder), nlist=8, nprobe=3)
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 4).alias("distance"))


def _chunk_store(spark, folder):
    """The chunks of the model written into a store of their own."""
    chunks = V.chunks(spark, folder).drop("status")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    store = CS.open_store(spark, f"{shared_dir(spark)}/corpusflow/chunk-store-{uuid.uuid4().hex}", schema)
    store.append(chunks, V.documents(spark, folder))
    return store


@query
def stored_citations(spark, folder):
    """Retrieval over the written chunk table."""
    found = R.retrieve_stored(_plain_questions(spark, folder), _chunk_store(spark, folder), V.documents(spark, folder))
    return found.select("query_id", "index", "chunk_id", "document_id", "document_name", "chunk_index", "snippet", "score", "distance")


@query
def stored_chunks_after_delete(spark, folder):
    """The written chunk table, read again after deletion requests."""
    store = _chunk_store(spark, folder)
    store.delete(_wanted_documents(spark, folder))
    return store.table().select("chunk_id", "document_id", "user_id", F.md5(F.col("content")).alias("digest"))


@query
def embedding_guard(spark, folder):
    return C.embedding_guard(V.chunks(spark, folder), 64)


@query
def vector_norms(spark, folder):
    rows = V.chunks(spark, folder).select("chunk_id", "embedding")
    again = VF.parse_vector_literal(VF.vector_literal(F.col("embedding")))
    return rows.select(
        "chunk_id", F.round(VF.l2_norm(F.col("embedding")), 6).alias("norm"),
        VF.dimension(again).alias("dim"),
        F.round(VF.l2_norm(VF.flatten_vector(F.array(again))), 6).alias("literal_norm"),
    )


@query
def space_compatibility(spark, folder):
    one = V.chunks(spark, folder).select(F.col("chunk_id").alias("text_id"), "embedding", "embedding_model")
    # A second provider of the same model that delivers three decimals.
    other = one.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 3)))
    out = C.space_compatibility(one, other)
    return out.withColumn("min_similarity", F.round("min_similarity", 6))


@query
def citations_resolved(spark, folder):
    return R.resolved_citations(V.sources(spark, folder), V.chunks(spark, folder), V.documents(spark, folder)).select(
        "message_id", "position", "type", "chunk_id", "chunk_index", "document_id", "original_filename"
    )


@query
def citation_locators(spark, folder):
    chunks = V.chunks(spark, folder)
    return chunks.select("chunk_id", F.array_join(R.locators(F.col("metadata")), " | ").alias("locators"))


@query
def retrieval_hints(spark, folder):
    return K.retrieval_hint(V.sources(spark, folder))


@query
def sources_of_messages(spark, folder):
    full = K.get_messages(V.messages(spark, folder), V.conversations(spark, folder), V.sources(spark, folder))
    return full.select(
        "message_id", "conversation_id", "user_id", "role",
        F.concat(F.lit("["), F.array_join("sources", ","), F.lit("]")).alias("sources"),
    )


# --- library -------------------------------------------------------------------


@query
def list_documents(spark, folder):
    return L.list_documents(V.documents(spark, folder)).select(
        "document_id", "user_id", "name", "status", "file_size", F.col("created_at").cast("string").alias("created_at")
    )


@query
def tenant_documents(spark, folder):
    """Documents of the users who hold conversations on a document."""
    askers = V.conversations(spark, folder).filter("document_id is not null")
    return R.tenant_scope(V.documents(spark, folder), askers).select("document_id", "user_id")


@query
def scoped_chunks(spark, folder):
    """Chunks in the scope of documents that conversations are pinned to."""
    pinned = V.conversations(spark, folder).filter("document_id is not null")
    return R.document_scope(V.chunks(spark, folder), pinned).select("chunk_id", "document_id")


@query
def chunks_with_documents(spark, folder):
    joined = R.chunks_with_documents(V.chunks(spark, folder).drop("status"), V.documents(spark, folder))
    return R.ready_only(joined).select("chunk_id", "document_id", "user_id", "document_name")


@query
def ready_counts(spark, folder):
    return L.count_ready_documents(V.documents(spark, folder))


@query
def in_flight(spark, folder):
    return R.in_flight(V.documents(spark, folder)).select("document_id", "user_id", "status")


@query
def count_chunks(spark, folder):
    return L.count_chunks(V.chunks(spark, folder))


@query
def count_messages(spark, folder):
    return L.count_messages(V.messages(spark, folder), V.conversations(spark, folder))


@query
def usage_stats(spark, folder):
    return L.usage_stats(
        V.users(spark, folder), V.conversations(spark, folder), V.documents(spark, folder),
        V.chunks(spark, folder), V.messages(spark, folder),
    )


@query
def library_totals(spark, folder):
    return L.library_totals(V.documents(spark, folder))


@query
def dedupe_actions(spark, folder):
    """Every stored text uploaded again by the user after the original one."""
    new = V.documents(spark, folder).select(
        F.col("document_id").alias("file_id"),
        F.expr("concat('src', (cast(substr(user_id, 4) as int) + document_id % 2) % 20)").alias("user_id"),
        "content_hash",
    )
    return L.dedupe_against_library(new, V.documents(spark, folder)).select("file_id", "user_id", "action", "existing_id")


@query
def duplicate_documents(spark, folder):
    return L.duplicate_documents(V.documents(spark, folder))


@query
def distinct_user_files(spark, folder):
    return L.distinct_user_files(V.documents(spark, folder))


@query
def catalog_files(spark, folder):
    """Documents of every source as one listing per folder, with chunks counted by content."""
    docs = V.documents(spark, folder)
    listing = docs.select(
        F.expr("concat('/', user_id, '/', original_filename)").alias("path"),
        F.col("original_filename").alias("name"), F.col("file_size").alias("size"), "content_hash",
    )
    chunks = V.chunks(spark, folder).join(docs.select("document_id", "content_hash"), "document_id")
    return L.catalog_files(SF.union_directories(listing, listing), chunks)


@query
def validate_files(spark, folder):
    return L.validate_files(V.uploads(spark, folder)).select("document_id", "extension", "kind", "code", "ok")


@query
def extractable(spark, folder):
    docs = V.documents(spark, folder).select("document_id", F.col("original_filename").alias("name"), F.col("file_size").alias("length"))
    return L.extractable(docs, V.chunks(spark, folder)).select("document_id", "n_chunks", "reason")


@query
def unavailable_formats(spark, folder):
    """Extensions of uploads for which no accepted upload exists."""
    checked = L.validate_files(V.uploads(spark, folder))
    return L.unavailable_formats(
        checked.select("extension").distinct(), checked.filter("ok").select("extension").distinct()
    )


@query
def describe_progress(spark, folder):
    return L.describe_progress(V.processing(spark, folder)).select(
        "document_id", "stage", "label", "detail", "percent", "tone", "done"
    )


@query
def progress_percent(spark, folder):
    docs = V.processing(spark, folder)
    return docs.select("document_id", L.computed_percent(F.col("progress.stage"), F.col("progress")).alias("percent"))


@query
def progress_ticks(spark, folder):
    pages = SP.pages_with_recognition(V.page_table(spark, folder))
    return L.progress_ticks(pages).select("document_id", "page")


@query
def batch_counters(spark, folder):
    return L.batch_counters(V.chunks(spark, folder), batch_size=2)


@query
def batch_totals(spark, folder):
    return L.batch_totals(V.chunks(spark, folder), batch_size=2)


# --- conversations ---------------------------------------------------------------


@query
def list_conversations(spark, folder):
    rows = K.list_conversations(V.conversations(spark, folder), V.messages(spark, folder), V.documents(spark, folder))
    return rows.select(
        "conversation_id", "user_id", "title", "mode", "pinned", "document_id", "document_name", "message_count",
        F.col("updated_at").cast("string").alias("updated_at"),
    )


@query
def conversation_ranks(spark, folder):
    return K.conversation_ranks(V.conversations(spark, folder)).select("conversation_id", "user_id", "list_rank")


@query
def conversation_messages(spark, folder):
    rows = K.messages_owned(V.messages(spark, folder), V.conversations(spark, folder))
    return rows.orderBy("created_at", "message_id").select("message_id", "conversation_id", "user_id", "role", "content")


@query
def search_conversations(spark, folder):
    rows = K.search_conversations(
        V.search_terms(spark, folder), V.conversations(spark, folder), V.messages(spark, folder), V.documents(spark, folder)
    )
    return rows.select(
        "user_id", "term", "conversation_id", "match_source", "snippet", "document_name", "message_count", "position"
    )


@query
def search_snippets(spark, folder):
    """Preview of every message around the last word of its conversation's title."""
    titles = V.conversations(spark, folder).select(
        "conversation_id", F.expr("regexp_extract(title, '([^ ]+)$', 1)").alias("term")
    )
    rows = V.messages(spark, folder).join(titles, "conversation_id")
    return rows.select("message_id", TX.search_snippet(F.col("content"), F.col("term")).alias("snippet"))


@query
def day_groups(spark, folder):
    return K.day_groups(V.conversations(spark, folder), V.as_of()).select("conversation_id", "user_id", "label", "label_order")


@query
def day_group_sizes(spark, folder):
    rows = K.day_groups(V.conversations(spark, folder), V.as_of())
    return rows.groupBy("user_id", "label", "label_order").agg(F.count("*").alias("conversations"))


@query
def tail_messages(spark, folder):
    return X.tail_messages(V.messages(spark, folder), 3).select("message_id", "conversation_id")


# --- context and prompts -----------------------------------------------------------


@query
def history_window(spark, folder):
    rows = X.build_history(V.messages(spark, folder), max_chars=1500, max_chars_per_message=400)
    return rows.select("conversation_id", "message_id", "role", "content", "recency")


@query
def format_history(spark, folder):
    return X.format_history(V.messages(spark, folder))


@query
def context_budget(spark, folder):
    return X.context_blocks(V.message_sources(spark, folder), max_chars=4000).select(
        "query_id", "number", "used_chars"
    )


@query
def build_context(spark, folder):
    return X.build_context(V.message_sources(spark, folder), start_index=3)


@query
def join_context_plain(spark, folder):
    return X.join_context_plain(V.message_sources(spark, folder).filter("type = 'document'"))


@query
def hybrid_sources(spark, folder):
    full = V.message_sources(spark, folder)
    docs = full.filter("type = 'document'").drop("url")
    web = full.filter("type = 'web'").select("query_id", F.lit(1).alias("index"), "title", "url", "snippet")
    return R.hybrid_sources(docs, web).select("query_id", "index", "type", "title", "url")


@query
def assemble_prompts(spark, folder):
    return T.prompts_of_turns(spark, folder)


@query
def turn_report(spark, folder):
    return T.turn_report_query(spark, folder)


# --- routing -------------------------------------------------------------------------


def _routed(spark, folder):
    return RT.route_messages(V.questions_asked(spark, folder))


@query
def route_messages(spark, folder):
    return _routed(spark, folder).select("message_id", "route", "confidence", "reason", "requires_fresh_data")


@query
def route_with_labels(spark, folder):
    routed = RT.route_messages(V.questions_asked(spark, folder), labels=V.route_labels(spark, folder))
    return routed.select("message_id", "route", "confidence", "reason", "requires_fresh_data")


@query
def retrieval_modes(spark, folder):
    rows = _routed(spark, folder).withColumn("mode", RT.retrieval_mode(F.col("route")))
    return rows.groupBy("route", "mode").agg(F.count("*").alias("messages"))


@query
def needs_fresh_data(spark, folder):
    return V.questions_asked(spark, folder).select("message_id", RT.needs_fresh_data(F.col("message")).alias("fresh"))


@query
def signal_hits(spark, folder):
    return RT.with_signals(V.questions_asked(spark, folder)).select(
        "message_id", "trivial_hits", "document_hits", "web_hits", "hybrid_hits", "general_hits", "fresh_hits"
    )


@query
def route_summary(spark, folder):
    return K.route_summary(T.turn_outcomes(spark, folder))


# --- text ----------------------------------------------------------------------------


@query
def generate_titles(spark, folder):
    return V.questions_asked(spark, folder).select("message_id", TX.generate_title(F.col("message")).alias("title"))


@query
def display_names(spark, folder):
    names = V.uploads(spark, folder)
    return names.select(
        "document_id", TX.display_name(F.col("name")).alias("display"), TX.file_extension(F.col("name")).alias("extension")
    )


@query
def content_hashes(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", TX.content_hash(F.col("text").cast("binary")).alias("hash"))


@query
def cache_keys(spark, folder):
    asked = V.questions(spark, folder)
    text = F.concat(F.lit("Question "), F.col("query_id").cast("string"))
    return asked.select(
        "query_id", TX.retrieval_cache_key(F.col("user_id"), text, F.col("scope"), F.col("allow_weak")).alias("retrieval"),
        TX.embedding_cache_key(text).alias("embed"), TX.web_cache_key(F.concat(text, F.lit("  "))).alias("web"),
    )


@query
def model_ids(spark, folder):
    """Model paths as written by different machines, one per stored vector."""
    raw = V.table(spark, folder, "embeddings").select("vec_id", F.expr(V.MODEL_PATH).alias("path"))
    return raw.select("vec_id", TX.normalise_model_id(F.col("path")).alias("model_id"))


@query
def clean_rewrites(spark, folder):
    rows = V.turns(spark, folder).select("message_id", "content")
    return rows.select(
        "message_id",
        TX.clean_rewrite(F.lit("original"), F.concat(F.lit(' "'), F.col("content"), F.lit('" '))).alias("query"),
    )


@query
def critic_scores(spark, folder):
    text = F.expr("concat('Review', chr(10), '**Score: ', cast(value as string), if(event_id % 5 = 0, ' of 10**', '/10**'))")
    return V.table(spark, folder, "events").select("event_id", TX.critic_score(text).alias("score"))


@query
def error_classes(spark, folder):
    rows = V.table(spark, folder, "events").select("event_id", F.expr(V.ERROR_TEXT).alias("text"))
    return rows.select("event_id", TX.error_class(F.col("text")).alias("code"))


@query
def client_ips(spark, folder):
    rows = V.table(spark, folder, "events").select(
        "event_id",
        F.expr("case when event_id % 3 = 0 then concat(' 10.0.0.', user_id, ' , 10.1.1.1') when event_id % 3 = 1 then '' end").alias("forwarded"),
        F.expr("case when event_id % 2 = 0 then concat('192.168.0.', user_id) end").alias("address"),
    )
    return rows.select("event_id", TX.client_ip(F.col("forwarded"), F.col("address")).alias("ip"))


@query
def json_fields(spark, folder):
    props = F.expr("if(event_id % 4 = 0, concat('{\"k\": \"', event_id, '\"}'), props)")
    return V.table(spark, folder, "events").select(
        "event_id", TX.json_number(props, "k").alias("k"), TX.json_text(props, "k").alias("k_text")
    )


@query
def chunk_metadata(spark, folder):
    rows = V.chunks(spark, folder)
    meta = CH.sparse_metadata(F.col("metadata"), F.col("metadata.documentName"), F.lit("file"))
    return rows.select("chunk_id", meta.alias("metadata"))


# --- web -------------------------------------------------------------------------------


@query
def strip_html(spark, folder):
    return V.pages(spark, folder).select("page_id", SW.strip_html(F.col("html")).alias("text"))


@query
def page_hosts(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", TX.host_of_url(F.col("url")).alias("host"))


@query
def web_sources(spark, folder):
    return T.web_sources(spark, folder).select("query_id", "index", "title", "url", "snippet", "score", "scraped")


@query
def web_listing(spark, folder):
    return X.web_listing(T.web_hits(spark, folder).withColumn("index", F.col("rank")))


# --- text sources ------------------------------------------------------------------------


@query
def txt_blocks(spark, folder):
    rows = ST.extract_txt_blocks(V.paragraph_texts(spark, folder))
    return rows.select("document_id", "block_no", "text", F.col("metadata.line").alias("line"))


@query
def markdown_blocks(spark, folder):
    rows = ST.extract_markdown_blocks(V.markdown_texts(spark, folder))
    return rows.select(
        "document_id", "block_no", "text", F.col("metadata.line").alias("line"), F.col("metadata.section").alias("section")
    )


@query
def markdown_info(spark, folder):
    return ST.markdown_info(V.markdown_texts(spark, folder))


@query
def page_text_blocks(spark, folder):
    rows = SP.page_text_blocks(V.page_table(spark, folder))
    return rows.select("document_id", "block_no", "text", F.col("metadata.page").alias("page"))


@query
def page_info(spark, folder):
    return SP.page_info(V.page_table(spark, folder))


@query
def decode_text_files(spark, folder):
    files = V.texts(spark, folder).select(
        "doc_id",
        F.expr(
            "case when doc_id % 3 = 0 then concat(unhex('EFBBBF'), encode(text, 'UTF-8'))"
            " when doc_id % 3 = 1 then concat(unhex('FFFE'), encode(text, 'UTF-16LE'))"
            " else encode(text, 'UTF-8') end"
        ).alias("content"),
    )
    decoded = ST.decode_text_files(files)
    return decoded.select("doc_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def docx_blocks(spark, folder):
    rows = SO.docx_blocks(SO.docx_elements(V.docx_files(spark, folder)))
    return rows.select(
        F.col("document_id").cast("bigint").alias("document_id"), "text", F.col("metadata.paragraph").alias("paragraph"),
        F.col("metadata.table").alias("table_no"), F.col("metadata.section").alias("section"),
    )


@query
def pptx_blocks(spark, folder):
    rows = SO.pptx_blocks(SO.pptx_elements(V.pptx_files(spark, folder)))
    return rows.select(
        F.col("document_id").cast("bigint").alias("document_id"), "text",
        F.col("metadata.slide").alias("slide"), F.col("metadata.title").alias("title"),
    )


# --- chunks and vectors --------------------------------------------------------------------


def _chunks(spark, folder):
    return CH.chunk_blocks(ST.extract_txt_blocks(V.paragraph_texts(spark, folder)))


@query
def chunk_documents(spark, folder):
    return _chunks(spark, folder).select("document_id", "block_no", "chunk_index", "content")


@query
def chunk_stats(spark, folder):
    return _chunks(spark, folder).groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"),
        F.max(F.length("content")).alias("longest"),
    )


@query
def embed_documents(spark, folder):
    texts = EM.drop_blank_texts(V.texts(spark, folder).select("doc_id", F.col("text").alias("content")))
    rows = EM.hashing_embeddings(texts)
    return rows.select(
        "doc_id", F.size("embedding").alias("dim"), F.round(VF.l2_norm(F.col("embedding")), 3).alias("norm"), "embedding_model"
    )


VOWELS = "aeiou"


@query
def embed_with_provider(spark, folder):
    """The provider hook with a provider of known vectors: counts of the vowels and the length, scaled to one."""

    def embed(texts):
        raw = [[*(float(t.count(c)) for c in VOWELS), float(len(t))] for t in texts]
        norms = [sum(x * x for x in v) ** 0.5 for v in raw]
        return [[x / n for x in v] for v, n in zip(raw, norms, strict=True)]

    texts = EM.drop_blank_texts(V.table(spark, folder, "documents").select("doc_id", F.col("text").alias("content")))
    rows = EM.embed_chunks(texts, embed, "vowels-6", dimension=len(VOWELS) + 1)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    return rows.select("doc_id", rounded.alias("embedding"), "embedding_model")


@query
def observed_progress(spark, folder):
    """Rows of each ingestion stage as a listener saw them pass, beside the rows counted afterwards."""
    seen, counts = {}, []

    def stage(name, rows):
        counted, counter = I.observed(rows, name)
        written = staged(counted, f"observed-{name}")
        I.report_progress(counter, lambda event: seen.update({name: event["rows"]}))
        I.report_progress(counter, lambda event: 1 / 0)
        counts.append((name, seen[name], written.count()))
        return written

    files = stage("files", V.paragraph_texts(spark, folder))
    blocks = stage("blocks", ST.extract_txt_blocks(files))
    stage("chunks", CH.chunk_blocks(blocks))
    return spark.createDataFrame(counts, "stage string, observed bigint, recounted bigint")


def _raw_folder(spark, label):
    return f"{shared_dir(spark)}/corpusflow/{label}-{uuid.uuid4().hex}"


@query
def scan_raw_files(spark, folder):
    """Every stored text written as a file and scanned; files above the limit keep their row without bytes."""
    path = _raw_folder(spark, "raw-files")
    V.write_raw_files(V.raw_texts(spark, folder), path)
    files = SF.scan_raw_files(spark, path, glob="*.txt", max_bytes=4000)
    return files.select(
        F.regexp_extract("path", "document_id=([0-9]+)/", 1).cast("bigint").alias("document_id"), V.owner_of(F.col("path")).alias("user_id"),
        "extension", "length", F.when(F.col("content").isNotNull(), TX.content_hash(F.col("content"))).alias("content_hash"),
    )


@query
def incremental_ingest(spark, folder):
    """Files that arrive in two parts, each ingested once by a stream; a third run finds nothing new."""
    path, target = _raw_folder(spark, "arriving"), _raw_folder(spark, "ingested")
    texts = V.raw_texts(spark, folder)
    for part in ("document_id % 2 = 0", "document_id % 2 = 1", None):
        if part:
            V.write_raw_files(texts.filter(part), path)
        session = J.stream_session(spark, spark.sparkContext.defaultParallelism)
        stream = SF.scan_raw_files(session, path, glob="*.txt", stream=True, max_files=100_000).drop("document_id")
        J.incremental_ingest(stream.drop("user_id"), target, f"{target}/checkpoint", user_of=V.owner_of).awaitTermination()
    documents = J.current_documents(spark, target)
    chunks = spark.read.parquet(f"{target}/chunks")
    contents = chunks.groupBy("document_id").agg(X.ordered_concat("content", "chunk_index", "\n").alias("contents"))
    return documents.join(contents, "document_id", "left").select(
        "user_id", "content_hash", "status", F.col("chunk_count").cast("int").alias("chunk_count"), F.md5(F.coalesce("contents", F.lit(""))).alias("chunks_digest")
    )


@query
def embedding_mismatches(spark, folder):
    """Vector batches checked against text batches of 64 by position."""
    texts = V.table(spark, folder, "documents").select(F.expr("doc_id div 64").alias("batch"), F.expr("doc_id % 64").alias("position"))
    vectors = V.table(spark, folder, "embeddings").select(F.expr("vec_id div 64").alias("batch"), F.expr("vec_id % 64").alias("position"))
    return EM.embedding_mismatches(texts, vectors)


@query
def zip_embeddings(spark, folder):
    texts = V.table(spark, folder, "documents").select(
        "doc_id", F.expr("doc_id div 64").alias("batch"), F.expr("doc_id % 64").alias("position")
    )
    vectors = V.table(spark, folder, "embeddings").select(
        F.expr("vec_id div 64").alias("batch"), F.expr("vec_id % 64").alias("position"), "embedding",
        F.lit("m").alias("embedding_model"),
    )
    return EM.zip_embeddings(texts, vectors).select("doc_id", F.size("embedding").alias("dim"), "embedding_model")


@query
def ingest_documents(spark, folder):
    return T.ingest_query(spark, folder)


# --- events ----------------------------------------------------------------------------------


@query
def parse_events(spark, folder):
    return SE.parse_event_log(V.log_lines(spark, folder), V.LOG_SCHEMA)


@query
def parse_sse(spark, folder):
    return SE.parse_sse_frames(V.sse_frames(spark, folder))


def _written_sse(spark, folder):
    """The events as files of server-sent frames, each ended by a blank line."""
    path = _raw_folder(spark, "sse")
    V.sse_frames(spark, folder).select("value").write.option("lineSep", "\n\n").text(path)
    return path


@query
def read_sse(spark, folder):
    return SE.read_sse(spark, _written_sse(spark, folder))


@query
def read_sse_stream(spark, folder):
    session = J.stream_session(spark, spark.sparkContext.defaultParallelism)
    return J.drain(SE.read_sse(session, _written_sse(spark, folder), stream=True), spark, "sse-frames")


@query
def document_state(spark, folder):
    return FO.document_state(V.processing_events(spark, folder))


@query
def latest_events(spark, folder):
    rows = V.table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return FO.latest_per_key(rows, ["user_id"], "event_id")


@query
def assemble_answers(spark, folder):
    return FO.assemble_answers(V.answer_events(spark, folder))


@query
def fixed_window_limits(spark, folder):
    rows = AN.fixed_window_limits(V.requests(spark, folder), points=2, window_seconds=86400)
    return rows.select("request_id", "used", "allowed", "remaining", "reset_seconds")


@query
def ttl_cache_hits(spark, folder):
    rows = V.requests(spark, folder)
    asked = rows.filter("event_type != 'purchase'").select(
        F.col("key").alias("owner"), F.col("event_type").alias("key"), "request_id", "at",
        F.expr("k % 4 != 0").alias("storable"),
    )
    clears = rows.filter("event_type = 'purchase'").select(F.col("key").alias("owner"), "request_id", "at")
    return AN.ttl_cache_hits(asked, clears, 3 * 86400).select("request_id", "hit")


@query
def progress_throttle(spark, folder):
    rows = V.requests(spark, folder).select(
        F.col("key").alias("document_id"), "request_id", "at", F.expr("event_type = 'signup'").alias("stage_change")
    )
    return AN.throttled_writes(rows, 86_400_000).select("request_id", "written")


# --- changes -----------------------------------------------------------------------------------


@query
def append_chunks(spark, folder):
    """Chunks of documents that no longer exist are not appended: bad documents count as removed."""
    live = V.documents(spark, folder).filter("status != 'failed'")
    return M.append_chunks(V.chunks(spark, folder), live).select("chunk_id", "document_id", "user_id", "embedding_model")


@query
def append_sources(spark, folder):
    turns = V.message_sources(spark, folder).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("index", "document_id", "chunk_id"))).alias("sources")
    ).select(
        F.col("query_id").alias("message_id"), F.lit(0).alias("conversation_id"), F.lit("assistant").alias("role"),
        F.lit("").alias("content"), F.lit("{}").alias("metadata"), F.lit(None).cast("timestamp").alias("created_at"), "sources",
    )
    return M.append_messages_with_sources(turns)[1]


@query
def append_documents(spark, folder):
    rows = M.append_documents(V.documents(spark, folder), V.as_of())
    return rows.select("document_id", "user_id", "name", "status", "chunk_count")


@query
def append_conversations(spark, folder):
    asked = V.conversations(spark, folder).select(
        "conversation_id", "user_id", F.expr("if(conversation_id % 2 = 0, title, null)").alias("title"),
        F.expr("if(conversation_id % 3 = 0, mode, null)").alias("mode"), "document_id",
    )
    return M.append_conversations(asked, V.as_of()).select("conversation_id", "title", "mode", "pinned")


@query
def apply_document_status(spark, folder):
    """Label rows as status changes."""
    changes = V.table(spark, folder, "labels").select(
        F.col("doc_id").alias("document_id"), F.expr("if(quality = 1, 'ready', 'failed')").alias("status"),
        F.expr("if(quality = 0, 'bad text', null)").alias("error_message"),
        F.expr("if(toxic = 1, 7, null)").alias("chunk_count"),
    )
    rows = M.apply_document_status(V.documents(spark, folder), changes, V.as_of())
    return rows.select(
        "document_id", "status", "error_message", "error_code", "chunk_count", F.col("updated_at").cast("string").alias("updated_at")
    )


@query
def fail_stale(spark, folder):
    rows = M.fail_stale_documents(V.documents(spark, folder), V.as_of())
    return rows.select("document_id", "status", "error_message", "error_code", F.col("updated_at").cast("string").alias("updated_at"))


def _wanted_documents(spark, folder):
    """Deletion requests: toxic documents, some of them asked for by somebody else."""
    toxic = V.table(spark, folder, "labels").filter("toxic = 1 or quality = 0").select(F.col("doc_id").alias("document_id"))
    docs = V.documents(spark, folder).select("document_id", "user_id")
    return toxic.join(docs, "document_id").withColumn("user_id", F.expr("if(document_id % 5 = 0, 'nobody', user_id)"))


@query
def delete_documents(spark, folder):
    return M.delete_documents(V.documents(spark, folder), V.chunks(spark, folder), _wanted_documents(spark, folder))[2]


@query
def delete_documents_kept(spark, folder):
    kept, chunks, _ = M.delete_documents(V.documents(spark, folder), V.chunks(spark, folder), _wanted_documents(spark, folder))
    left = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return kept.select("document_id").join(left, "document_id", "left")


def _cascaded(spark, folder):
    gone = V.users(spark, folder).filter("password_hash is null and google_id is null")
    tables = {
        "users": V.users(spark, folder), "sessions": V.sessions(spark, folder), "documents": V.documents(spark, folder),
        "chunks": V.chunks(spark, folder), "conversations": V.conversations(spark, folder),
        "messages": V.messages(spark, folder), "sources": V.sources(spark, folder),
    }
    return M.cascade_delete(tables, gone)


@query
def cascade_delete(spark, folder):
    """Rows left per table after removing the users that have no sign-in method."""
    out = None
    for name, rows in _cascaded(spark, folder).items():
        part = rows.agg(F.count("*").alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        out = part if out is None else out.unionByName(part)
    return out


@query
def cascade_sources(spark, folder):
    return _cascaded(spark, folder)["sources"].select("message_id", "position", "chunk_id", "document_id")


@query
def references_after_delete(spark, folder):
    """Conversations and citations after every fifth document of its owner has been deleted with its chunks."""
    asked = V.documents(spark, folder).filter("document_id % 5 = 0").select(
        "document_id", F.expr("if(document_id % 10 = 0, user_id, 'nobody')").alias("user_id")
    )
    out = M.delete_with_references(
        {"documents": V.documents(spark, folder), "chunks": V.chunks(spark, folder),
         "conversations": V.conversations(spark, folder), "sources": V.sources(spark, folder)}, asked,
    )
    none = F.lit(None).cast("bigint")
    talks = out["conversations"].select(
        F.lit("conversation").alias("kind"), F.col("conversation_id").alias("row_id"), none.alias("position"),
        "document_id", none.alias("chunk_id"),
    )
    return talks.unionByName(out["sources"].select(
        F.lit("citation").alias("kind"), F.col("message_id").alias("row_id"), F.col("position").cast("bigint").alias("position"),
        "document_id", "chunk_id",
    ))


@query
def delete_conversations(spark, folder):
    asked = V.conversations(spark, folder).filter("mode = 'web'").select(
        "conversation_id", F.expr("if(pinned, 'nobody', user_id)").alias("user_id")
    )
    kept, messages, sources = M.delete_conversations(
        V.conversations(spark, folder), V.messages(spark, folder), V.sources(spark, folder), asked
    )
    left = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    return kept.select("conversation_id").join(left, "conversation_id", "left")


@query
def clear_messages(spark, folder):
    asked = V.conversations(spark, folder).filter("mode = 'hybrid'").select("conversation_id", "user_id")
    return M.clear_messages(V.conversations(spark, folder), V.messages(spark, folder), asked)[1]


@query
def patch_conversations(spark, folder):
    patches = V.conversations(spark, folder).filter("mode != 'auto'").select(
        "conversation_id", "user_id", F.expr("if(pinned, 'Renamed', null)").alias("title"),
        F.expr("if(mode = 'web', 'auto', null)").alias("mode"), F.lit(None).cast("bigint").alias("document_id"),
        F.expr("mode = 'hybrid'").alias("has_document_id"),
    )
    rows = M.patch_conversations(V.conversations(spark, folder), patches, V.as_of())
    return rows.select("conversation_id", "title", "mode", "document_id", F.col("updated_at").cast("string").alias("updated_at"))


@query
def touch_conversations(spark, folder):
    talks = V.conversations(spark, folder)
    rows = M.touch_conversations(talks, talks.filter("pinned"), V.as_of())
    return rows.select("conversation_id", F.col("updated_at").cast("string").alias("updated_at"))


@query
def apply_progress(spark, folder):
    """Counters of every second document, each changed twice: the later change holds."""
    documents = V.processing(spark, folder).select(
        "document_id", F.col("progress.chunks").alias("progress"), V.as_of().alias("updated_at")
    )
    changes = documents.filter("document_id % 2 = 0").select(
        "document_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), (F.col("progress") * 10).alias("progress")),
                                         F.struct(F.lit(2).alias("at"), (F.col("progress") + 1).alias("progress")))).alias("c"),
    ).select("document_id", "c.at", "c.progress")
    return M.apply_progress(documents, changes, V.as_of(), order="at").select("document_id", "progress")


@query
def set_pinned(spark, folder):
    pins = V.conversations(spark, folder).select("conversation_id", "user_id", F.expr("mode = 'auto'").alias("pinned"))
    rows = M.set_pinned(V.conversations(spark, folder), pins, V.as_of())
    return rows.select("conversation_id", "pinned", F.col("pinned_at").cast("string").alias("pinned_at"))


@query
def purge_sessions(spark, folder):
    return M.purge_expired_sessions(V.sessions(spark, folder), V.session_time()).select("session_id", "user_id")


@query
def revoke_sessions(spark, folder):
    gone = V.users(spark, folder).filter("google_id is null")
    return M.revoke_user_sessions(V.sessions(spark, folder), gone)[1]


@query
def sessions_with_users(spark, folder):
    return M.sessions_with_users(V.sessions(spark, folder), V.users(spark, folder), V.session_time()).select(
        "session_id", "user_id", "name", "email"
    )


@query
def users_by_email(spark, folder):
    asked = V.table(spark, folder, "documents").select(F.expr("concat(source, '@example.COM')").alias("email"))
    return M.users_by_email(V.users(spark, folder), asked).select("user_id", "email")


@query
def session_expiry(spark, folder):
    rows = V.table(spark, folder, "events")
    return rows.select("event_id", F.date_format(TX.expires_at(F.col("ts"), 30), "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query
def rollback_conversations(spark, folder):
    outcomes = T.turn_outcomes(spark, folder).groupBy("conversation_id", "user_id").agg(
        F.lit(True).alias("is_new"), F.lit(False).alias("had_messages"),
        F.bool_or("has_answer").alias("has_answer"), F.bool_or("has_error").alias("has_error"),
    )
    return M.rollback_empty_conversations(V.conversations(spark, folder), outcomes).select("conversation_id")


@query
def check_constraints(spark, folder):
    reports = [
        C.check_constraints(V.users(spark, folder), "users", "user_id"),
        C.check_constraints(V.sessions(spark, folder), "sessions", "session_id"),
        C.check_constraints(V.documents(spark, folder), "documents", "document_id"),
        C.check_constraints(V.conversations(spark, folder), "conversations", "conversation_id"),
        C.check_constraints(V.turns(spark, folder), "messages", "message_id"),
    ]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


@query
def unique_violations(spark, folder):
    docs = V.documents(spark, folder)
    return C.unique_violations(docs, [F.col("user_id"), F.col("content_hash")], "documents_user_content_key")


# --- streams: the stored events replayed through the streaming operators ---------------------------


def _event_stream(spark, folder):
    session = J.stream_session(spark, spark.sparkContext.defaultParallelism)
    schema = V.table(spark, folder, "events").schema
    stream = session.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return V.request_rows(stream)


@query
def rate_limit_stream(spark, folder):
    stream = J.replay(V.requests(spark, folder).select("key", "request_id", "at"), "at", "requests")
    return J.drain(J.rate_limit_stream(stream, 2, 86400), spark, "rate-limit")


@query
def ttl_memo_stream(spark, folder):
    rows = _event_stream(spark, folder).select(
        F.col("key").alias("owner"), F.col("event_type").alias("key"), "request_id", "at",
        F.expr("k % 4 != 0").alias("storable"), F.expr("event_type = 'purchase'").alias("clears"),
    )
    return J.drain(J.ttl_memo_stream(rows, 3 * 86400), spark, "memo")


@query
def progress_throttle_stream(spark, folder):
    rows = V.requests(spark, folder).select(
        F.col("key").alias("document_id"), "request_id", "at", F.expr("event_type = 'signup'").alias("stage_change")
    )
    return J.drain(J.progress_throttle_stream(J.replay(rows, "at", "ticks"), 86_400_000), spark, "throttle")


@query
def document_state_stream(spark, folder):
    stream = V.processing_rows(_event_stream(spark, folder))
    return J.drain(J.ingest_progress_stream(stream), spark, "document-state", "update", "document_id")


@query
def document_runs(spark, folder):
    return FO.document_state(V.processing_runs(spark, folder))


@query
def document_runs_stream(spark, folder):
    """Documents from their first event to their end, each forgotten after it."""
    stream = J.replay(V.processing_runs(spark, folder), "at", "runs")
    return J.drain(J.document_progress_stream(stream), spark, "document-runs", "update", "document_id")


@query
def asked_spaces(spark, folder):
    """Chunks whose owner and model occur among the questions that accept weak matches."""
    asked = V.questions(spark, folder).filter("allow_weak")
    return R.same_space(V.chunks(spark, folder), asked).select("chunk_id", "user_id", "embedding_model")


@query
def retrieve_distinct(spark, folder):
    """Retrieval of repeated questions: each distinct request is searched once and joined back."""
    asked = V.questions(spark, folder).drop("scope", "allow_weak")
    asked = asked.withColumn("query", F.col("query_id").cast("string"))
    # Negative ids can't collide with stored ones.
    every = asked.unionByName(asked.withColumn("query_id", -1 - F.col("query_id")))
    grouped = R.distinct_questions(every)
    firsts = grouped.filter("query_id = asked_as")
    found = R.retrieve(firsts.drop("asked_as"), V.chunks(spark, folder), V.documents(spark, folder), k=2)
    kept = found.select(F.col("query_id").alias("asked_as"), "index", "chunk_id")
    return grouped.select("query_id", "asked_as").join(kept, "asked_as").select("query_id", "index", "chunk_id")


@query
def extraction_info(spark, folder):
    """Reports of the stored texts read as Markdown, with the chunks stored for them."""
    measured = ST.markdown_info(V.markdown_texts(spark, folder)).withColumn("error_code", F.lit(None).cast("string"))
    return I.extraction_info(measured, V.chunks(spark, folder)).select("document_id", "chunk_count", "extraction_info")


@query
def token_stream(spark, folder):
    """Answers assembled while their tokens arrive."""
    stream = J.replay(V.answer_events(spark, folder), "at", "tokens")
    return J.drain(J.token_stream_assembly(stream), spark, "answers")
