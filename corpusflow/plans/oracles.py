"""Oracle SQL (DuckDB dialect) for the registered queries."""

from __future__ import annotations

from corpusflow.functions.text import TITLE_LEAD_INS, TITLE_TRAILING_NOISE
from corpusflow.operators import context, routing
from corpusflow.views import ROUTE_ANSWERS

# Model tables as common table expressions, independent of the Spark definitions.
def _document(vector: str) -> str:
    return f"({vector}) % z.held * z.step + ({vector}) % z.held % z.step"


VIEWS = {
    "sizes": """
        select d, v, held, greatest(d // held, 1) as step, (select max(turn) + 2 from conversations) as ids,
               (select greatest((count(*) + 4) // 5, 1) from pages) as page_groups
        from (select d, v, greatest(least(d, (v + 2) // 3), 1) as held
              from (select (select count(*) from documents) as d, (select count(*) from embeddings) as v))""",
    "lib_documents": """
        select d.doc_id as document_id, d.source as user_id, 'doc_' || d.doc_id as name,
               'doc_' || d.doc_id || '.txt' as original_filename, d.n_chars as file_size,
               'users/' || d.source || '/' || d.doc_id || '.txt' as storage_key,
               sha256(d.text) as content_hash,
               case when l.quality = 0 then 'failed' when l.toxic = 1 then 'extracting' else 'ready' end as status,
               case when l.quality = 0 then 'No readable text' end as error_message,
               case when l.quality = 0 then 'NO_TEXT_EXTRACTED' end as error_code,
               d.text, timestamp '2024-01-01' + to_minutes(d.doc_id::int) as created_at
        from documents d left join labels l on l.doc_id = d.doc_id""",
    "placed_vectors": f"""
        select e.*, {_document('vec_id')} as document_id, (vec_id // z.held)::int as number from embeddings e, sizes z""",
    "lib_chunks": """
        select e.vec_id as chunk_id, e.document_id, d.user_id, e.number as chunk_index, d.text as content, d.status,
               d.original_filename as document_name, e.embedding::double[] as embedding,
               'm' || (e.label % 2) as embedding_model,
               case when e.vec_id % 3 = 0 then e.number + 1 end as page,
               case when e.vec_id % 3 = 1 then e.number + 1 end as slide,
               case when e.vec_id % 2 = 0 then e.number + 1 end as paragraph,
               case when e.vec_id % 3 = 2 then e.number + 1 end as line,
               case when e.vec_id % 5 = 1 then 'Section ' || e.label end as section,
               case when e.vec_id % 3 = 1 then 'Slide ' || e.label end as slide_title
        from placed_vectors e join lib_documents d on d.document_id = e.document_id""",
    "questions": f"""
        select e.vec_id as query_id, d.user_id, e.embedding::double[] as embedding,
               'm' || (e.label % 2) as embedding_model, e.vec_id % 2 = 0 as allow_weak,
               case when e.vec_id % 3 = 0
                    then [e.document_id, {_document('e.vec_id + 20')}, {_document('e.vec_id + 40')}] end as scope
        from placed_vectors e join lib_documents d on d.document_id = e.document_id, sizes z""",
    "users": """
        select source as user_id, source as name, upper(source) || '@Example.com' as email,
               case when source not like '%7' and min(doc_id) % 2 = 0 then 'hash' end as password_hash,
               case when source not like '%7' and min(doc_id) % 2 = 1 then source end as google_id
        from documents group by source""",
    "sessions": """
        select 's' || event_id as session_id, 'src' || (user_id % 20) as user_id, ts as created_at,
               ts + interval 14 day as expires_at
        from events""",
    "turns": """
        select conv_id * z.ids + turn as message_id, conv_id as conversation_id, role, text as content,
               turn as position, timestamp '2024-01-01' + to_minutes((conv_id * 100 + turn)::int) as created_at
        from conversations, sizes z""",
    "messages": "select * from turns where role in ('user', 'assistant')",
    "convs": """
        select conversation_id, 'src' || (conversation_id % 20) as user_id,
               coalesce(arg_min(content, position) filter (where role = 'user'), 'New chat') as title,
               (['auto', 'document', 'web', 'hybrid'])[conversation_id % 4 + 1] as mode,
               case when conversation_id % 3 = 0 then conversation_id % (select d from sizes) end as document_id,
               conversation_id % 7 = 0 as pinned,
               case when conversation_id % 14 = 0 then max(created_at) end as pinned_at,
               min(created_at) as created_at, max(created_at) as updated_at
        from turns group by conversation_id""",
    "sources": f"""
        select message_id, position, type, chunk_id, case when chunk_id is not null then {_document('chunk_id')} end as document_id,
               '{{"index":' || (position + 1) || '}}' as metadata
        from (select m.message_id, p.position,
                     case when p.position = 2 and m.message_id % 2 = 1 then 'web' else 'document' end as type,
                     case when p.position = 2 and m.message_id % 2 = 1 then null
                          else (m.message_id * 7 + p.position * 13) % (select v from sizes) end as chunk_id
              from messages m, (values (0), (1), (2)) p(position) where m.role = 'assistant'), sizes z""",
    "web_results": """
        select page_id, url, html, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title,
               case when page_id % 3 = 0 then null else (page_id % 97) / 97.0::double end as score,
               regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1) as query_id
        from pages""",
}

NEEDS = {
    "placed_vectors": ["sizes"],
    "lib_chunks": ["lib_documents", "placed_vectors"],
    "questions": ["lib_documents", "placed_vectors"],
    "turns": ["sizes"],
    "messages": ["turns"],
    "convs": ["turns", "sizes"],
    "sources": ["turns", "messages", "sizes"],
}

SQL: dict[str, tuple[list[str], str]] = {}


def add(name: str, views: str, body: str) -> None:
    SQL[name] = (views.split(), body)


def _closed(names):
    ordered = []

    def visit(name):
        for parent in NEEDS.get(name, []):
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def all_sql() -> dict[str, str]:
    out = {}
    for name, (names, body) in SQL.items():
        parts = [f"{view} as ({VIEWS[view]})" for view in _closed(names)]
        body = body.strip()
        if not parts:
            out[name] = body
        elif body.lower().startswith("with recursive"):
            out[name] = "with recursive " + ", ".join(parts) + ", " + body[len("with recursive"):]
        elif body.lower().startswith("with"):
            out[name] = "with " + ", ".join(parts) + ", " + body[len("with"):]
        else:
            out[name] = "with " + ", ".join(parts) + " " + body
    return out


# --- retrieval ---------------------------------------------------------------


def _ranked(distance="round(list_cosine_distance(q.embedding, c.embedding), 12)", where="c.status = 'ready'", n=12):
    return f"""
    with pairs as (
        select q.query_id, q.allow_weak, c.* exclude (embedding), {distance} as d
        from questions q join lib_chunks c
          on c.user_id = q.user_id and c.embedding_model = q.embedding_model
        where {where}),
    ranked as (
        select *, row_number() over (partition by query_id order by d, chunk_id) as rank
        from pairs qualify rank <= {n})"""


def _kept(limit, weak):
    return f""",
    flagged as (select *, max((d <= {limit})::int) over (partition by query_id) as any_near from ranked),
    kept as (
        select *, row_number() over (partition by query_id order by d, chunk_id)::int as idx
        from flagged where d <= {limit} or (any_near = 0 and {weak}) qualify idx <= 5)"""


_SCORES = "round(1 - d, 4) as score, round(d, 4) as distance"

add("knn_topk", "lib_chunks questions", _ranked() + """
    select query_id, chunk_id, rank::int as rank, round(d, 4) as distance from ranked""")
add("retrieve_sources", "lib_chunks questions", _ranked() + _kept(0.75, "true") + f"""
    select query_id, idx as index, chunk_id, document_id, document_name, page, slide, paragraph, line,
           section, slide_title, chunk_index, substr(content, 1, 600) as snippet, {_SCORES} from kept""")
add("stored_citations", "lib_chunks questions", _ranked() + _kept(0.75, "true") + f"""
    select query_id, idx as index, chunk_id, document_id, document_name, chunk_index, substr(content, 1, 600) as snippet, {_SCORES} from kept""")
add("retrieve_no_weak", "lib_chunks questions", _ranked() + _kept(0.6, "false") + f"""
    select query_id, idx as index, chunk_id, {_SCORES} from kept""")
add("retrieve_scoped", "lib_chunks questions",
    _ranked(where="c.status = 'ready' and (q.scope is null or list_contains(q.scope, c.document_id))")
    + _kept(0.5, "allow_weak") + f"""
    select query_id, idx as index, chunk_id, {_SCORES} from kept""")
add("knn_l2", "lib_chunks questions",
    _ranked("round(list_distance(q.embedding, c.embedding), 6)", "true") + _kept(0.9, "true") + """
    select query_id, idx as index, chunk_id, round(1 / (1 + d), 4) as score, round(d, 4) as distance from kept""")
add("score_threshold", "lib_chunks questions", _ranked(where="true", n=5) + """
    select query_id, rank::int as index, chunk_id, round(1 - d, 4) as score from ranked where 1 - d >= 0.1""")


# --- vectors and citations ------------------------------------------------------

add("embedding_guard", "lib_chunks", """
    select document_id, count(*) as chunks, count(embedding) as vectors,
           min(embedding_model) != max(embedding_model) as mixed_models,
           min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim,
           case when min(embedding_model) != max(embedding_model) then 'MIXED_MODELS' else '' end as violations
    from lib_chunks group by document_id""")
add("vector_norms", "lib_chunks", """
    select chunk_id, round(sqrt(list_inner_product(embedding, embedding)), 6) as norm, len(embedding)::int as dim,
           round(sqrt(list_inner_product(embedding, embedding)), 6) as literal_norm from lib_chunks""")
add("space_compatibility", "lib_chunks", """
    with both_sides as (
        select embedding as a, list_transform(embedding, lambda x: round(x, 3)) as b from lib_chunks)
    select count(*) as texts, round(min(1 - list_cosine_distance(a, b)), 6) as min_similarity,
           true as same_model, min(1 - list_cosine_distance(a, b)) > 0.999 as compatible from both_sides""")
add("citations_resolved", "sources lib_chunks lib_documents", """
    select s.message_id, s.position, s.type, s.chunk_id, c.chunk_index, s.document_id, d.original_filename
    from sources s left join lib_chunks c on c.chunk_id = s.chunk_id
    left join lib_documents d on d.document_id = s.document_id""")
add("citation_locators", "lib_chunks", """
    select chunk_id, array_to_string(list_filter([
        'p. ' || page, 'slide ' || slide,
        case when page is null and slide is null then '¶ ' || paragraph end,
        case when page is null and slide is null then 'line ' || line end, section], lambda x: x is not null), ' | ') as locators
    from lib_chunks""")
add("retrieval_hints", "sources", """
    select message_id, case when bool_or(type = 'document') and bool_or(type = 'web') then 'Used your documents + web'
        when bool_or(type = 'document') then 'Used your documents'
        when bool_or(type = 'web') then 'Searched the web' end as hint
    from sources group by message_id""")
add("sources_of_messages", "messages convs sources", """
    select m.message_id, m.conversation_id, c.user_id, m.role,
           '[' || coalesce((select string_agg(s.metadata, ',' order by s.position) from sources s
                            where s.message_id = m.message_id), '') || ']' as sources
    from messages m join convs c on c.conversation_id = m.conversation_id""")

# --- library ---------------------------------------------------------------------

add("list_documents", "lib_documents", """
    select document_id, user_id, name, status, file_size, created_at::varchar as created_at from lib_documents""")
add("tenant_documents", "lib_documents convs", """
    select document_id, user_id from lib_documents
    where user_id in (select user_id from convs where document_id is not null)""")
add("scoped_chunks", "lib_chunks convs", """
    select chunk_id, document_id from lib_chunks
    where document_id in (select document_id from convs where document_id is not null)""")
add("chunks_with_documents", "lib_chunks lib_documents", """
    select c.chunk_id, c.document_id, c.user_id, d.original_filename as document_name
    from lib_chunks c join lib_documents d on d.document_id = c.document_id and d.user_id = c.user_id
    where d.status = 'ready'""")
add("ready_counts", "lib_documents", """
    select user_id, count(*) as total from lib_documents where status = 'ready' group by user_id""")
add("in_flight", "lib_documents", """
    select document_id, user_id, status from lib_documents where status not in ('ready', 'failed')""")
add("count_chunks", "lib_chunks", "select user_id, count(*) as total from lib_chunks group by user_id")
add("count_messages", "messages convs", """
    select c.user_id, m.conversation_id, count(*) as total
    from messages m join convs c on c.conversation_id = m.conversation_id group by all""")
add("usage_stats", "users convs lib_documents lib_chunks messages", """
    select u.user_id,
           (select count(*) from convs c where c.user_id = u.user_id) as conversations,
           (select count(*) from messages m join convs c on c.conversation_id = m.conversation_id
            where c.user_id = u.user_id) as messages,
           (select count(*) from lib_documents d where d.user_id = u.user_id) as documents,
           (select count(*) from lib_chunks k where k.user_id = u.user_id) as chunks
    from users u""")
add("library_totals", "lib_documents", """
    select user_id, count(*) as documents, sum(file_size)::bigint as total_bytes from lib_documents group by user_id""")
add("dedupe_actions", "lib_documents", """
    with fresh as (
        select document_id as file_id, 'src' || ((substr(user_id, 4)::int + document_id % 2) % 20) as user_id, content_hash
        from lib_documents),
    best as (
        select f.file_id, f.user_id, d.document_id, d.status,
               row_number() over (partition by f.file_id order by
                   case d.status when 'ready' then 0 when 'failed' then 2 else 1 end, d.document_id) as rn
        from fresh f left join lib_documents d on d.user_id = f.user_id and d.content_hash = f.content_hash)
    select file_id, user_id, case when document_id is null then 'new' when status = 'ready' then 'reuse'
           when status = 'failed' then 'replace' else 'conflict' end as action, document_id as existing_id
    from best where rn = 1""")
add("duplicate_documents", "lib_documents", """
    select user_id, content_hash, count(*) as copies, min(document_id) as kept_id
    from lib_documents group by user_id, content_hash having count(*) > 1""")
add("distinct_user_files", "lib_documents", """
    select user_id, content_hash, min(document_id) as document_id from lib_documents group by all""")
add("catalog_files", "lib_documents lib_chunks", """
    with files as (
        select distinct '/' || user_id || '/' || original_filename as path, original_filename as name,
               file_size as size_bytes, content_hash from lib_documents),
    firsts as (select * from files qualify row_number() over (partition by content_hash order by path) = 1),
    counts as (select d.content_hash, count(*) as n from lib_chunks c
               join lib_documents d on d.document_id = c.document_id group by 1)
    select f.content_hash as id, name, path, size_bytes, coalesce(n, 0) > 0 as indexed, coalesce(n, 0) as chunks
    from firsts f left join counts c on c.content_hash = f.content_hash""")

VIEWS["uploads"] = """
    select doc_id as document_id, source as user_id,
           'folder.v1/doc.' || doc_id || (['.txt', '.md', '.pdf', '.docx', '.exe', '.TXT', ''])[doc_id % 7 + 1] as name,
           case when doc_id % 13 = 0 then '#!' || text when doc_id % 14 = 2 then '%PDF' || text
                when doc_id % 14 = 3 then 'PK' || chr(3) || chr(4) || text
                when doc_id % 17 = 0 then '' else text end as body,
           case when doc_id % 11 = 0 then 'image/png' when doc_id % 11 = 1 then 'application/octet-stream'
                else 'text/plain' end as mime_type
    from documents"""
# Extension '' of 'folder.v1/doc.N' is the numeric suffix: a name ends at its last dot.
VIEWS["judged"] = """
    select *, case when ok_ext is null then 'UNSUPPORTED_FILE_TYPE' when strlen(body) > 26214400 then 'FILE_TOO_LARGE'
                   when mime_type = 'image/png' then 'UNSUPPORTED_MIME_TYPE' when kind = 'executable' then 'DANGEROUS_FILE'
                   when kind = 'empty' then 'EMPTY_FILE' when kind != ok_ext then 'CONTENT_MISMATCH' end as code
    from (
        select *, case extension when '.txt' then 'text' when '.md' then 'text' when '.pdf' then 'pdf'
                                 when '.docx' then 'zip' end as ok_ext,
               case when body[1:2] in ('#!', 'MZ') then 'executable' when body[1:4] = '%PDF' then 'pdf'
                    when body[1:4] = 'PK' || chr(3) || chr(4) then 'zip' when body = '' then 'empty'
                    when hex(encode(body))[8193:8193] in ('8', '9', 'A', 'B') then 'unknown' else 'text' end as kind
        from (select *, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) as extension from uploads))"""
NEEDS["judged"] = ["uploads"]

add("validate_files", "judged", "select document_id, extension, kind, code, code is null as ok from judged")
add("unavailable_formats", "judged", """
    select distinct extension from judged where extension not in (select extension from judged where code is null)""")
add("extractable", "lib_documents lib_chunks", """
    with counts as (select document_id, count(*) as n from lib_chunks group by 1)
    select d.document_id, coalesce(n, 0) as n_chunks,
           case when d.file_size = 0 then 'EMPTY_DOCUMENT' when n is null then 'NO_TEXT_EXTRACTED' end as reason
    from lib_documents d left join counts c on c.document_id = d.document_id""")

VIEWS["processing"] = """
    select doc_id as document_id,
           (['pending', 'uploading', 'extracting', 'ocr', 'chunking', 'embedding', 'processing', 'ready', 'failed'])[doc_id % 9 + 1] as status,
           case when doc_id % 5 != 0 then (['uploading', 'extracting', 'ocr', 'chunking', 'embedding', 'failed'])[doc_id % 6 + 1] end as p_stage,
           case when doc_id % 2 = 0 then doc_id % 10 end as page, case when doc_id % 4 = 0 then n_chars end as pages,
           case when doc_id % 7 = 0 then doc_id % 10 end as ocr_pages, case when doc_id % 3 = 0 then doc_id % 10 end as block,
           case when doc_id % 3 != 1 then n_chars end as blocks, case when doc_id % 4 != 1 then doc_id % 10 end as batches,
           case when doc_id % 8 < 4 then n_chars end as batches_total, n_chars as chunks,
           case when doc_id % 6 = 0 then 0 when doc_id % 6 = 1 then 1 when doc_id % 6 = 2 then n_chars else n_chars end as shown,
           case when doc_id % 2 = 0 then 'boom' end as error_message,
           case when doc_id % 4 = 1 then (doc_id % 150)::double + 0.25 - 10 end as upload_percent, doc_id % 23 = 0 as backgrounded
    from documents"""
_PERCENT = """case
        when {s} in ('ocr', 'extracting') and page is not null and coalesce(pages, 0) != 0
            then greatest(0, least(100, round(page / pages * 100)))
        when {s} = 'embedding' and batches is not null and coalesce(batches_total, 0) != 0
            then greatest(0, least(100, round(batches / batches_total * 100)))
        when {s} = 'extracting' and block is not null and coalesce(blocks, 0) != 0
            then greatest(0, least(100, round(block / blocks * 100))) end::int"""
add("progress_percent", "processing", f"select document_id, {_PERCENT.format(s='p_stage')} as percent from processing")
add("describe_progress", "processing", f"""
    with staged as (
        select *, case when backgrounded or status in ('failed', 'ready') or (status = 'uploading' and upload_percent is not null)
                       then status when p_stage is not null and p_stage != 'failed' then p_stage else status end as stage
        from processing)
    select document_id, stage,
        case when backgrounded then 'Still processing' else
            case stage when 'pending' then 'Queued' when 'uploading' then 'Uploading' when 'extracting' then 'Extracting text'
                when 'ocr' then 'Reading scanned pages' when 'chunking' then 'Splitting into chunks'
                when 'embedding' then 'Generating embeddings' when 'ready' then 'Ready' when 'failed' then 'Failed'
                else 'Processing' end end as label,
        case when backgrounded then 'This keeps running in the background - check your Library shortly.'
             when status = 'failed' then error_message
             when status = 'ready' then case when shown != 0 then 'Indexed ' || shown || case when shown = 1 then ' chunk' else ' chunks' end end
             when status = 'uploading' and upload_percent is not null then round(upload_percent)::int || '%'
             when stage in ('ocr', 'extracting') and page is not null and coalesce(pages, 0) != 0 then 'page ' || page || ' of ' || pages
             when stage = 'ocr' and ocr_pages is not null then ocr_pages || case when ocr_pages = 1 then ' page so far' else ' pages so far' end
             when stage = 'extracting' and block is not null and coalesce(blocks, 0) != 0 then 'section ' || block || ' of ' || blocks
             when stage = 'extracting' and coalesce(blocks, 0) != 0 then blocks || case when blocks = 1 then ' section' else ' sections' end
             when stage = 'embedding' and batches is not null then 'batch ' || batches || case when coalesce(batches_total, 0) != 0 then ' of ' || batches_total else '' end
             when stage = 'embedding' then chunks || ' chunks indexed'
             when stage = 'chunking' then chunks || case when chunks = 1 then ' chunk so far' else ' chunks so far' end end as detail,
        case when backgrounded or status = 'failed' then null when status = 'ready' then 100
             when status = 'uploading' and upload_percent is not null then greatest(0, least(100, round(upload_percent)))::int
             else {_PERCENT.format(s='stage')} end as percent,
        case when backgrounded then 'active' when status = 'failed' then 'error' when status = 'ready' then 'done' else 'active' end as tone,
        not backgrounded and status in ('failed', 'ready') as done
    from staged""")

VIEWS["page_table"] = """
    select doc_id as document_id, g.pos::int + 1 as page, string_split(text, chr(10))[g.pos + 1] as text,
           case when doc_id % 10 = 3 and g.pos = 0 then null when g.pos % 3 = 0 then ''
                else 'Scan ' || string_split(text, chr(10))[g.pos + 1] end as recognised_text
    from documents, unnest(range(len(string_split(text, chr(10))))) g(pos)"""
VIEWS["judged_pages"] = """
    select document_id, page, length(trim(text)) < 40 as scanned,
           length(trim(text)) < 40 and coalesce(recognised_text, '') != '' as recognised,
           length(trim(text)) < 40 and recognised_text is null as unread,
           case when length(trim(text)) < 40 and coalesce(recognised_text, '') != '' then recognised_text else trim(text) end as text
    from page_table"""
NEEDS["judged_pages"] = ["page_table"]
add("page_text_blocks", "judged_pages", """
    select document_id, page as block_no, page, text from judged_pages where trim(text) != ''""")
add("page_info", "judged_pages", """
    select document_id, count(*) as page_count, bool_or(recognised) as used_ocr, count(*) filter (recognised) as ocr_pages,
           case when bool_or(unread) then 'OCR_UNAVAILABLE' end as error_code from judged_pages group by document_id""")
add("progress_ticks", "judged_pages", """
    select document_id, page from (select *, max(page) over (partition by document_id) as last_page from judged_pages)
    where page % 10 = 0 or page = last_page or scanned""")
add("batch_counters", "lib_chunks", """
    select document_id, (chunk_index // 2 + 1)::int as batch, count(*) as batch_chunks,
           (sum(count(*)) over (partition by document_id order by chunk_index // 2))::bigint as chunks_so_far
    from lib_chunks group by document_id, chunk_index // 2""")
add("batch_totals", "lib_chunks", """
    select document_id, count(*) as chunks, ceil(count(*) / 2)::bigint as batches from lib_chunks group by document_id""")

# --- conversations ------------------------------------------------------------------

VIEWS["listed"] = """
    select c.*, d.name as document_name,
           (select count(*) from messages m where m.conversation_id = c.conversation_id) as message_count
    from convs c left join lib_documents d on d.document_id = c.document_id and d.user_id = c.user_id"""
NEEDS["listed"] = ["turns", "messages", "convs", "lib_documents"]
add("list_conversations", "listed", """
    select conversation_id, user_id, title, mode, pinned, document_id, document_name, message_count,
           updated_at::varchar as updated_at from listed""")
add("conversation_ranks", "convs", """
    select conversation_id, user_id, row_number() over (partition by user_id
        order by pinned desc, pinned_at desc nulls last, updated_at desc, conversation_id) as list_rank from convs""")
add("conversation_messages", "messages convs", """
    select m.message_id, m.conversation_id, c.user_id, m.role, m.content
    from messages m join convs c on c.conversation_id = m.conversation_id""")
VIEWS["search_terms"] = """
    select user_id, unnest([' ' || word, substr(word, 1, 2) || '_' || substr(word, 4), 'x']) as term
    from (select 'src' || (conversation_id % 20) as user_id, max(lower(regexp_extract(content, '^([^ .,]+)', 1))) as word
          from messages where role = 'user' group by 1)"""
NEEDS["search_terms"] = ["turns", "messages"]
_SNIPPET = """(case when s > 0 then '…' else '' end || trim(substr({text}, s + 1, 160), ' ' || chr(10))
           || case when s + 160 < length({text}) then '…' else '' end)"""
add("search_conversations", "search_terms listed", """
    with asked as (select distinct user_id, trim(term) as term from search_terms where length(trim(term)) >= 2),
    matches as (
        select c.conversation_id, a.user_id, a.term,
               max(case when c.title ilike '%' || a.term || '%' then 2 else 1 end) as rank,
               max(case when c.title ilike '%' || a.term || '%' then 'title' else 'message' end) as match_source,
               arg_max(m.content, m.created_at) filter (where m.content ilike '%' || a.term || '%') as found
        from asked a join convs c on c.user_id = a.user_id
        left join messages m on m.conversation_id = c.conversation_id
        where c.title ilike '%' || a.term || '%' or m.content ilike '%' || a.term || '%'
        group by all),
    placed as (
        select m.*, l.document_name, l.message_count, row_number() over (partition by m.user_id, m.term
               order by l.pinned desc, m.rank desc, l.updated_at desc, m.conversation_id) as position,
               greatest(0, instr(lower(found), lower(m.term)) - 41) as s
        from matches m join listed l on l.conversation_id = m.conversation_id)
    select user_id, term, conversation_id, match_source, document_name, message_count, position::int as position,
           """ + _SNIPPET.format(text="found") + """ as snippet
    from placed where position <= 30""")
add("search_snippets", "messages convs", """
    with asked as (
        select m.message_id, m.content,
               greatest(0, instr(lower(m.content), lower(regexp_extract(c.title, '([^ ]+)$', 1))) - 41) as s
        from messages m join convs c on c.conversation_id = m.conversation_id)
    select message_id, """ + _SNIPPET.format(text="content") + """ as snippet from asked""")
VIEWS["day_labels"] = """
    select conversation_id, user_id, case when n <= 0 then 'Today' when n = 1 then 'Yesterday' when n <= 7 then 'Previous 7 days'
               when n <= 30 then 'Previous 30 days' else 'Older' end as label,
           case when n <= 0 then 1 when n = 1 then 2 when n <= 7 then 3 when n <= 30 then 4 else 5 end::bigint as label_order
    from (select *, date_diff('day', updated_at::date, date '2024-03-01') as n from convs)"""
NEEDS["day_labels"] = ["turns", "convs"]
add("day_groups", "day_labels", "select * from day_labels")
add("day_group_sizes", "day_labels", """
    select user_id, label, label_order, count(*) as conversations from day_labels group by all""")
add("tail_messages", "messages", """
    select message_id, conversation_id from messages
    qualify row_number() over (partition by conversation_id order by created_at desc, message_id desc) <= 3""")

# --- context ---------------------------------------------------------------------------

add("history_window", "messages", """
    with recent as (
        select *, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as recency
        from messages where trim(content) != '' qualify recency <= 6),
    cut as (select * exclude (content), case when length(content) > 400 then substr(content, 1, 400) || ' ...' else content end as content
            from recent),
    summed as (select *, sum(length(content)) over (partition by conversation_id order by recency) as total from cut)
    select conversation_id, message_id, role, content, recency::int as recency from summed where recency = 1 or total <= 1500""")
add("format_history", "messages", """
    with recent as (
        select *, row_number() over (partition by conversation_id order by created_at desc, message_id desc) as recency
        from messages qualify recency <= 6),
    lines as (select conversation_id, recency, case role when 'user' then 'User: ' else 'Assistant: ' end
              || case when length(trim(content)) > 800 then substr(trim(content), 1, 800) || ' ...' else trim(content) end as line
              from recent where trim(content) != '')
    select conversation_id, string_agg(line, chr(10) order by recency desc) as history from lines group by conversation_id""")
VIEWS["message_sources"] = """
    select s.message_id as query_id, s.position + 1 as idx, s.type, s.document_id, s.chunk_id, c.content, c.page,
           case when s.type = 'web' then 'Page ' || s.message_id else 'doc_' || s.document_id || '.txt' end as title,
           case when s.type = 'web' then 'https://example.com/' || s.message_id end as url
    from sources s left join lib_chunks c on c.chunk_id = s.chunk_id"""
NEEDS["message_sources"] = ["turns", "messages", "sources", "lib_documents", "lib_chunks"]
_BLOCKS = """
    with blocks as (
        select query_id, idx + {shift} as number, '[' || (idx + {shift}) || '] ' || case when type = 'web' then title || ' - ' || url
                   else title || case when page > 0 then ', page ' || page else '' end end || chr(10)
                   || case when type = 'web' then 'Snippet ' || query_id else content end as block
        from message_sources),
    fitted as (select *, sum(length(block)) over (partition by query_id order by number) as used_chars from blocks
               qualify used_chars <= {limit})"""
add("context_budget", "message_sources", _BLOCKS.format(shift=0, limit=4000) + """
    select query_id, number::int as number, used_chars::bigint as used_chars from fitted""")
add("build_context", "message_sources", _BLOCKS.format(shift=2, limit=12000) + """
    select query_id, string_agg(block, chr(10) || chr(10) order by number) as context from fitted group by query_id""")
add("join_context_plain", "message_sources", """
    select query_id, string_agg(content, chr(10) || chr(10) order by idx) as context
    from message_sources where type = 'document' group by query_id""")
add("hybrid_sources", "message_sources", """
    select query_id, (row_number() over (partition by query_id order by type, idx))::int as index, type, title, url from message_sources""")

# --- routing ---------------------------------------------------------------------------

VIEWS["asked"] = """
    select m.message_id, m.conversation_id, m.position, 'src' || (m.conversation_id % 20) as user_id,
           case when phrase in ('hello', 'thanks!') then phrase else phrase || content end as message,
           coalesce((select count(*) from lib_documents d where d.status = 'ready'
                     and d.user_id = 'src' || (m.conversation_id % 20)), 0) > 0 and m.conversation_id % 4 != 1 as has_documents,
           m.message_id % 10 = 7 as has_attachment, m.conversation_id % 5 != 2 as web_enabled, m.message_id % 9 = 4 as force_web
    from (select *, (['What is the latest news about ', 'Summarize my document: ', 'Compare my report with the latest research on ',
              'hello', 'explain ', '', 'According to the report on page 4, ', 'box office collection of ', 'In 2025, ',
              'Please tell me about the ', 'I uploaded a contract - ', 'thanks!', 'since 2026 ',
              '```code``` # Can you please describe the ', 'What does it say? How does this work'])[(message_id // 3) % 15 + 1] as phrase
          from messages where role = 'user') m"""
NEEDS["asked"] = ["turns", "messages", "lib_documents"]


def _hits(family: str) -> str:
    patterns = [p.replace("'", "''") for p in _SIGNALS[family]]
    return " + ".join(f"regexp_matches(text, '{p}', 'i')::int" for p in patterns)


# The patterns are fixed values and stand in one place; what the oracle states anew is the decision.
_SIGNALS = {
    "document": routing.DOCUMENT_SIGNALS, "web": routing.WEB_SIGNALS, "fresh": routing.FRESH_DATA_SIGNALS,
    "hybrid": routing.HYBRID_SIGNALS, "general": routing.GENERAL_SIGNALS, "trivial": routing.TRIVIAL_SIGNALS,
}
VIEWS["hits"] = (
    "select * exclude (text), "
    + ", ".join(f"({_hits(f)})::int as {f}_hits" for f in ("trivial", "document", "web", "hybrid", "general", "fresh"))
    + " from (select *, trim(message) as text from asked)"
)
NEEDS["hits"] = ["asked"]
_BOTH = "refers to the user documents and to current information"
VIEWS["routed"] = f"""
    select message_id, conversation_id, position, message, user_id,
        case when force_web and web_enabled then case when has_attachment then 'hybrid' else 'web' end
             when has_attachment then case when (web_hits > 0 or hybrid_hits > 0) and web_enabled then 'hybrid' else 'documents' end
             when up in ('documents', 'hybrid') and not has_documents then case when up = 'hybrid' and web_enabled then 'web' else 'llm' end
             when up in ('web', 'hybrid') and not web_enabled then case when up = 'hybrid' then 'documents' else 'llm' end
             else up end as route,
        case when force_web and web_enabled then 1.0 when has_attachment then 0.99
             when up != base then greatest(conf, 0.9) when over then greatest(conf, 0.9) else conf end::double as confidence,
        case when force_web and web_enabled then 'the user asked for a web search'
             when has_attachment then 'a document was attached to this message'
             else why || case when over then '; overridden - needs current information' else '' end
                  || case when up in ('documents', 'hybrid') and not has_documents then '; no documents available'
                          when up in ('web', 'hybrid') and not web_enabled then '; web search unavailable' else '' end end as reason,
        case when force_web and web_enabled then true when has_attachment then null else fresh_hits > 0 end as requires_fresh_data
    from (
        select *, web_enabled and fresh_hits > 0 and base not in ('web', 'hybrid') as over,
               case when web_enabled and fresh_hits > 0 and base not in ('web', 'hybrid')
                    then case when base = 'documents' and has_documents then 'hybrid' else 'web' end else base end as up
        from (
            select *,
                case when trim(message) = '' or trivial_hits > 0 then 'llm' when hybrid_hits > 0 or (document_hits > 0 and web_hits > 0) then 'hybrid'
                     when document_hits > 0 then 'documents' when web_hits > 0 then 'web' when general_hits > 0 then 'llm'
                     when has_documents then 'documents' else 'llm' end as base,
                case when trim(message) = '' then 1.0 when trivial_hits > 0 then 0.99 when hybrid_hits > 0 then 0.9
                     when document_hits > 0 and web_hits > 0 then 0.75 when document_hits > 1 then 0.95 when document_hits > 0 then 0.85
                     when web_hits > 1 then 0.95 when web_hits > 0 then 0.8 when general_hits > 0 then 0.7
                     when has_documents then 0.4 else 0.5 end as conf,
                case when trim(message) = '' then 'empty message' when trivial_hits > 0 then 'conversational message'
                     when hybrid_hits > 0 or (document_hits > 0 and web_hits > 0) then '{_BOTH}'
                     when document_hits > 0 then 'refers to the user documents' when web_hits > 0 then 'asks for current information'
                     when general_hits > 0 then 'general knowledge question' when has_documents then 'defaulting to the user documents'
                     else 'no retrieval signal detected' end as why
            from hits))"""
NEEDS["routed"] = ["hits"]
# With labels: an answer that names a route decides where no rule does.
_ANSWERS = "[" + ", ".join(f"'{a}'" for a in ROUTE_ANSWERS) + "]"
_LABELLED = VIEWS["routed"]
for _old, _new in (
    ("when has_documents then 'documents' else 'llm' end as base", "when label is not null then label"),
    ("when has_documents then 0.4 else 0.5 end as conf", "when label is not null then 0.7"),
    ("when has_documents then 'defaulting to the user documents'", "when label is not null then 'classified by the language model'"),
):
    _LABELLED = _LABELLED.replace(_old, f"{_new} {_old}")
VIEWS["routed_by_label"] = _LABELLED.replace("from hits)", f"""from (
                select *, case when message_id % 4 != 0 then nullif(regexp_extract(
                    lower({_ANSWERS}[message_id % {len(ROUTE_ANSWERS)} + 1]), 'llm|documents|web|hybrid'), '') end as label from hits))""")
NEEDS["routed_by_label"] = ["hits"]
add("route_with_labels", "routed_by_label", "select message_id, route, confidence, reason, requires_fresh_data from routed_by_label")
_MODE = "case route when 'documents' then 'document' when 'web' then 'web' when 'hybrid' then 'hybrid' else 'llm' end"
add("signal_hits", "hits", """
    select message_id, trivial_hits, document_hits, web_hits, hybrid_hits, general_hits, fresh_hits from hits""")
add("needs_fresh_data", "hits", "select message_id, fresh_hits > 0 as fresh from hits")
add("route_messages", "routed", "select message_id, route, confidence, reason, requires_fresh_data from routed")
add("retrieval_modes", "routed", f"select route, {_MODE} as mode, count(*) as messages from routed group by route")

# --- text --------------------------------------------------------------------------------

# Fixed values of the titles, from their one list.
_LEAD_INS, _NOISE = TITLE_LEAD_INS, TITLE_TRAILING_NOISE
_STRIPPED = ", ".join(f"regexp_replace(sentence, '{p}', '', 'i')" for p in _LEAD_INS)
add("generate_titles", "asked", f"""
    with lines as (
        select message_id, message, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
            message, '(?s)```.*?```', ' ', 'g'), '[#*_`>~|]', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x != '')[1] as line
        from asked),
    sentences as (select *, coalesce(nullif(regexp_extract(line, '^(.*?[.?!]) ', 1), ''), line) as sentence from lines),
    bodies as (select *, coalesce(list_filter([{_STRIPPED}], lambda x: x != sentence and trim(x) != '')[1], sentence) as body from sentences),
    worded as (select *, list_filter(regexp_split_to_array(regexp_replace(body, '[?!.,;:]+$', ''), '\\s+'), lambda w: w != '') as words from bodies),
    useful as (select *, greatest(1, coalesce(list_max(list_transform(range(1, len(words) + 1),
        lambda i: case when lower(words[i]) in {tuple(_NOISE)} then 1 else i end)), 1)) as n from worded),
    cased as (select message_id, line, array_to_string(list_transform(words[1:least(n, 6)],
        lambda w: case when length(w) > 3 then replace(upper(substr(w, 1, 1)), chr(7838), 'SS') || substr(w, 2) else w end), ' ') as t from useful)
    select message_id, case when line is null then 'New chat' else
        upper(substr(c, 1, 1)) || substr(c, 2) end as title
    from (select *, case when length(t) > 60 then rtrim(substr(t, 1, 59)) || '…' else t end as c from cased)""")
add("display_names", "uploads", """
    select document_id, 'doc' || case when doc_suffix then '' else '.' || document_id end as display,
           lower(regexp_extract(name, '(\\.[^.]*)$', 1)) as extension
    from (select *, document_id % 7 = 6 as doc_suffix from uploads)""")
add("content_hashes", "", "select doc_id, sha256(text) as hash from documents")
add("cache_keys", "questions", """
    select query_id,
        'cache:retrieval:' || user_id || ':' || substr(sha256('Question ' || query_id || '::'
            || coalesce(array_to_string(list_sort(list_transform(scope, lambda x: x::varchar)), ','), '')
            || '::weak=' || allow_weak::int), 1, 32) as retrieval,
        'cache:embed:' || substr(sha256('Question ' || query_id), 1, 32) as embed,
        'cache:web:' || substr(sha256('question ' || query_id), 1, 32) as web
    from questions""")
add("model_ids", "", """
    select vec_id, case vec_id % 6 when 0 then 'org/model-' || label when 1 then 'a/b' || label when 2 then 'local-' || label
        when 3 then 'org/model-' || label when 4 then 'plain' || label else 'unknown' end as model_id from embeddings""")
add("clean_rewrites", "turns", """
    select message_id, case when length(trim(content)) between 1 and 398 then trim(content) || ''
        when length(content) between 1 and 400 then content else 'original' end as query from turns""")
add("critic_scores", "", "select event_id, case when event_id % 5 != 0 then value end as score from events")
add("error_classes", "", """
    with texts as (
        select event_id, 'Upstream status ' || (404 + json_extract_string(props, '$.k')::int)
            || case event_type when 'error' then ' Unauthorized' when 'view' then ' Request timed out'
               when 'click' then ' Rate Limit' else '' end as text from events)
    select event_id, case when contains(text, '429') or contains(lower(text), 'rate limit') then 'LLM_RATE_LIMITED'
        when contains(text, '503') or contains(text, '502') then 'LLM_UNAVAILABLE'
        when contains(lower(text), 'unauthor') then 'LLM_AUTH_FAILED'
        when contains(lower(text), 'timed out') then 'LLM_TIMEOUT' else 'LLM_FAILED' end as code from texts""")
add("client_ips", "", """
    select event_id, case when event_id % 3 = 0 then '10.0.0.' || user_id when event_id % 2 = 0 then '192.168.0.' || user_id
        else 'unknown' end as ip from events""")
add("json_fields", "", """
    select event_id, case when event_id % 4 != 0 then json_extract_string(props, '$.k')::double end as k,
           case when event_id % 4 = 0 then event_id::varchar else json_extract_string(props, '$.k') end as k_text from events""")
add("chunk_metadata", "lib_chunks", """
    select chunk_id, '{"documentName":"doc_' || document_id || '.txt"' || coalesce(',"page":' || page, '')
        || coalesce(',"slide":' || slide, '') || coalesce(',"paragraph":' || paragraph, '') || coalesce(',"line":' || line, '')
        || coalesce(',"section":"' || section || '"', '') || coalesce(',"title":"' || slide_title || '"', '') || '}' as metadata
    from lib_chunks""")

# --- web -----------------------------------------------------------------------------------

# Entities that occur in the stored pages, written as replacements (ampersand last).
VIEWS["page_texts"] = r"""
    select page_id, url, trim(regexp_replace(replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|noscript)\b[^>]*>.*?</(?:script|style|noscript)\s*>', ' ', 'g'),
        '<[!/?a-zA-Z][^>]*>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp([^;])', '&\1', 'g'), '&amp;', '&'),
        '\s+', ' ', 'g')) as text
    from pages"""
add("strip_html", "page_texts", """
    select page_id, case when length(text) > 8000 then substr(text, 1, 8000) || '... [truncated]' else text end as text from page_texts""")
add("page_hosts", "", r"""
    select page_id, lower(regexp_extract(url, '^[a-z]+://(?:www\.)?([^/:?#]+)', 1)) as host from pages""")
add("web_sources", "web_results page_texts", """
    select w.query_id, row_number() over (partition by w.query_id order by w.page_id)::int as index, coalesce(w.title, w.url) as title,
           w.url, substr(t.text, 1, 600) as snippet, round(w.score, 4) as score,
           row_number() over (partition by w.query_id order by w.page_id) = 1 and w.url like 'https:%' as scraped
    from web_results w join page_texts t on t.page_id = w.page_id
    qualify row_number() over (partition by w.query_id order by w.page_id) <= 5""")
add("web_listing", "web_results page_texts", """
    select w.query_id, string_agg(chr(10) || '            Title : ' || coalesce(w.title, '') || chr(10) || '            URL : ' || w.url
        || chr(10) || '            Content : ' || substr(t.text, 1, 500) || chr(10) || '            ', chr(10) || '---' || chr(10)
        order by w.page_id) as listing
    from (select * from web_results qualify row_number() over (partition by query_id order by page_id) <= 5) w
    join page_texts t on t.page_id = w.page_id group by w.query_id""")

# --- text sources ------------------------------------------------------------------------------

VIEWS["paragraphs"] = """
    select doc_id as document_id, g.pos, string_split(body, chr(10) || chr(10))[g.pos + 1] as raw
    from (select doc_id, replace(text, chr(10), case when doc_id % 5 = 0 then chr(10) || chr(10) || ' ' || chr(10) || chr(10)
                 else chr(10) || chr(10) end) as body from documents),
         unnest(range(len(string_split(body, chr(10) || chr(10))))) g(pos)"""
VIEWS["blocks"] = """
    select document_id, trim(raw, ' ' || chr(10)) as text,
           (1 + coalesce(sum(len(string_split(raw, chr(10))) + 1) over before, 0))::bigint as line,
           coalesce(sum((trim(raw, ' ' || chr(10)) != '')::int) over before, 0)::int as block_no
    from paragraphs window before as (partition by document_id order by pos rows between unbounded preceding and 1 preceding)"""
NEEDS["blocks"] = ["paragraphs"]
add("txt_blocks", "blocks", "select document_id, block_no, text, line::int as line from blocks where text != ''")
# Splitting of one-line blocks: a window takes words while they fit in 1000 characters; the next one begins at
# most 100 characters before its end. Bounds are 0, every blank and the end; words are shorter than a window.
VIEWS["chunk_rows"] = """
    select document_id, block_no, (row_number() over (partition by document_id order by block_no, k) - 1)::int as chunk_index, content
    from (
        with recursive bounded as (
            select document_id, block_no, text, list_concat([0], list_filter(range(1, length(text)), lambda p: text[p + 1] = ' '), [length(text)]) as b
            from blocks where text != ''),
        spans as (
            select document_id, block_no, text, b, 0 as k, 1::bigint as f,
                   list_min(list_filter(range(2, len(b)), lambda i: b[i + 1] - b[1] > 1000)) as i from bounded
            union all
            select document_id, block_no, text, b, k + 1, g, list_min(list_filter(range(g + 1, len(b)), lambda x: b[x + 1] - b[g] > 1000))
            from (select *, list_min(list_filter(range(f, i + 1), lambda j: j = i or (b[i] - b[j] <= 100 and b[i + 1] - b[j] <= 1000))) as g
                  from spans where i is not null))
        select document_id, block_no, k, trim(substr(text, b[f] + 1, coalesce(b[i], b[len(b)]) - b[f])) as content from spans)
    where content != ''"""
NEEDS["chunk_rows"] = ["blocks"]
add("chunk_documents", "chunk_rows", "select document_id, block_no, chunk_index, content from chunk_rows")
add("chunk_stats", "chunk_rows", """
    select document_id, count(*) as chunks, max(chunk_index) as last_index, max(length(content))::int as longest from chunk_rows group by document_id""")
_RAW = """
    with raw as (
        select doc_id as document_id, source as user_id, replace(text, chr(10), case when doc_id % 5 = 0 then chr(10) || chr(10) || ' ' || chr(10) || chr(10)
               else chr(10) || chr(10) end) || chr(10) as body from documents)"""
add("scan_raw_files", "", _RAW + """
    select document_id, user_id, '.txt' as extension, strlen(body)::bigint as length,
           case when strlen(body) <= 4000 then sha256(body) end as content_hash from raw""")
add("incremental_ingest", "chunk_rows", _RAW + """,
    firsts as (select user_id, sha256(body) as content_hash, min(document_id) as document_id from raw
        -- A file whose first 4096 bytes end inside a character is not taken for text.
        where hex(encode(body))[8193:8193] not in ('8', '9', 'A', 'B') group by all)
    select f.user_id, f.content_hash, case when count(c.content) > 0 then 'ready' else 'failed' end as status, count(c.content)::int as chunk_count,
           md5(coalesce(string_agg(c.content, chr(10) order by c.chunk_index), '')) as chunks_digest
    from firsts f left join chunk_rows c on c.document_id = f.document_id group by all""")
add("observed_progress", "blocks chunk_rows", """
    select 'files' as stage, count(*) as observed, count(*) as recounted from documents
    union all select 'blocks', count(*), count(*) from blocks where text != ''
    union all select 'chunks', count(*), count(*) from chunk_rows""")
_VECTOR = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::double" for c in "aeiou") + ", length(text)::double]"
add("embed_with_provider", "", f"""
    select doc_id, list_transform({_VECTOR}, lambda x: round(x / sqrt(list_inner_product({_VECTOR}, {_VECTOR})), 4)) as embedding,
           'vowels-6' as embedding_model from documents where trim(text, ' ' || chr(10)) != ''""")
VIEWS["md_lines"] = r"""
    select document_id, pos, line, starts_with(ltrim(line), '```') as fence
    from (select document_id, g.pos, string_split(body, chr(10))[g.pos + 1] as line
          from (select doc_id as document_id, regexp_replace(regexp_replace(regexp_replace(text, '(?m)^(E[a-z])', '## \1', 'g'),
                       '(?m)^(Th[a-f])', '```\1', 'g'), '(?m)^(An?[a-z])', ' # \1', 'g') as body from documents),
               unnest(range(len(string_split(body, chr(10))))) g(pos))"""
VIEWS["md_marked"] = """
    select *, sum(heading::int) over upto as block from (
        select *, not fence and coalesce(sum(fence::int) over earlier, 0) % 2 = 0 and starts_with(ltrim(line), '#') as heading
        from md_lines window earlier as (partition by document_id order by pos rows between unbounded preceding and 1 preceding))
    window upto as (partition by document_id order by pos)"""
NEEDS["md_marked"] = ["md_lines"]
add("markdown_blocks", "md_marked", """
    with named as (
        select *, last_value(case when heading then nullif(trim(ltrim(line, '#')), '') end ignore nulls)
                  over (partition by document_id order by pos) as section from md_marked)
    select document_id, block::int as block_no, trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) as text,
           (min(pos) + 1)::int as line, arg_max(section, pos) as section
    from named group by document_id, block having trim(string_agg(line, chr(10) order by pos), ' ' || chr(10)) != ''""")
add("markdown_info", "md_marked", """
    select document_id, sum(heading::int)::bigint as headings, count(*) as lines from md_marked group by document_id""")
add("decode_text_files", "", "select doc_id, length(text)::int as n_chars, md5(text) as digest from documents")
VIEWS["text_lines"] = """
    select doc_id as document_id, g.pos::int as pos, string_split(text, chr(10))[g.pos + 1] as line
    from documents, unnest(range(len(string_split(text, chr(10))))) g(pos)"""
add("docx_blocks", "text_lines", """
    with kept as (
        select document_id, trim(line) as line, pos, pos % 5 = 0 as heading, pos > 0 and pos % 5 != 0 and pos % 4 = 0 as item,
               row_number() over (partition by document_id order by pos)::int as paragraph
        from text_lines where trim(line) != ''),
    named as (select *, last_value(case when heading then line end ignore nulls) over (partition by document_id order by pos) as section from kept)
    select document_id, case when pos = 0 then '# ' when heading then '## ' when item then '- ' else '' end || line as text,
           paragraph, null::int as table_no, section from named
    union all
    select document_id, string_agg(trim(line), ' | ' order by pos), null, 1,
           (select arg_max(k.line, k.pos) from kept k where k.document_id = t.document_id and k.heading)
    from text_lines t where pos < 2 group by document_id having bool_or(trim(line) != '')""")
add("pptx_blocks", "text_lines", """
    select document_id, (pos + 1) as slide, case when pos % 3 != 2 then nullif(trim(line), '') end as title,
           concat_ws(chr(10), case when pos % 3 != 2 then '# ' || trim(line) end,
                     case when pos % 2 = 0 then '- ' || trim(line) || chr(10) || repeat('  ', pos % 3) || '- ' || trim(line) end,
                     case when pos % 4 = 1 then 'row | ' || trim(line) end,
                     case when pos % 5 = 0 then 'Speaker notes: ' || trim(line) end) as text
    from text_lines where trim(line) != '' and (pos % 3 != 2 or pos % 2 = 0 or pos % 4 = 1 or pos % 5 = 0)""")
add("embed_documents", "", """
    select doc_id, 768 as dim, 1.0::double as norm, 'hashing-tf-768' as embedding_model from documents""")
add("embedding_mismatches", "", """
    with t as (select doc_id // 64 as batch, count(*) as texts from documents group by 1),
    v as (select vec_id // 64 as batch, count(*) as vectors from embeddings group by 1)
    select coalesce(t.batch, v.batch) as batch, coalesce(texts, 0) as texts, coalesce(vectors, 0) as vectors
    from t full join v on t.batch = v.batch where coalesce(texts, 0) != coalesce(vectors, 0)""")
add("zip_embeddings", "", """
    select d.doc_id, len(e.embedding)::int as dim, case when e.vec_id is not null then 'm' end as embedding_model
    from documents d left join embeddings e on e.vec_id = d.doc_id""")

# --- events ------------------------------------------------------------------------------------

_K = "json_extract_string(props, '$.k')::int"
add("parse_events", "", f"""
    select event_id, 'status' as type, event_type as stage, {_K}::bigint as page from events where event_id % 13 != 0""")
add("parse_sse", "", """
    select event_id, case when event_id % 10 = 1 then 'message' else event_type end as event,
           case when event_id % 10 = 2 then '{"k":' || chr(10) || '1}' else props end as data
    from events where event_id % 10 not in (0, 3)""")
add("read_sse", "", """
    select case when event_id % 10 = 1 then 'message' else event_type end as event,
           case when event_id % 10 = 2 then '{"k":' || chr(10) || '1}' else props end as data
    from events where event_id % 10 not in (0, 3)""")
SQL["read_sse_stream"] = SQL["read_sse"]
add("latest_events", "", """
    select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by event_id desc) = 1""")
VIEWS["processing_events"] = f"""
    select user_id as document_id, event_id as seq,
        case when event_type = 'click' then 'chunks' when event_type = 'purchase' and k < 4 then 'result'
             when event_type = 'error' and k >= 97 then 'error' else 'status' end as type,
        event_type = 'signup' and k < 10 as ocr, case when event_type != 'click' and k % 2 = 0 then k end as page,
        case when event_type != 'click' and k % 5 = 0 then k + 100 end as pages, case when event_type = 'signup' then k end as ocr_pages,
        case when event_type = 'view' and k % 3 = 0 then k end as block, case when event_type = 'view' and k % 7 = 0 then k + 50 end as blocks,
        k % 64 as n, event_id as idx, k + 1 as batches, case when k = 98 then null else 'E' || k end as code, 'failed at ' || k as message,
        ts
    from (select *, {_K} as k from events)"""
VIEWS["processing_runs"] = """
    select * replace (document_id || '-' || coalesce(sum((type in ('result', 'error'))::int) over (
        partition by document_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as document_id)
    from processing_events"""
NEEDS["processing_runs"] = ["processing_events"]
add("document_state", "processing_events", """
    with folded as (
        select document_id,
            arg_max(page, seq) filter (type = 'status' and page is not null) as page,
            arg_max(pages, seq) filter (type = 'status' and pages is not null) as pages,
            arg_max(ocr_pages, seq) filter (type = 'status' and ocr_pages is not null) as ocr_pages,
            arg_max(block, seq) filter (type = 'status' and block is not null) as block,
            arg_max(blocks, seq) filter (type = 'status' and blocks is not null) as blocks,
            coalesce(bool_or(ocr) filter (type = 'status'), false) as ocr, bool_or(type = 'chunks') as emb,
            bool_or(type = 'result') as res, bool_or(type = 'error') as err,
            list(code order by seq) filter (type = 'error') as codes, list(message order by seq) filter (type = 'error') as notes,
            coalesce(sum(n) filter (type = 'chunks'), 0) as chunks, arg_max(idx, seq) filter (type = 'chunks') as frames,
            max(batches) filter (type = 'result') as total
        from processing_events group by document_id),
    judged as (select *, err or (res and chunks = 0) as failed, res and not (err or chunks = 0) as done from folded)
    select document_id, case when failed then 'failed' when done then 'ready' when emb then 'embedding' when ocr then 'ocr' else 'extracting' end as status,
        case when err then coalesce(codes[1], 'EXTRACTION_FAILED') when failed then 'NO_TEXT_EXTRACTED' end as error_code,
        case when err then notes[1] when failed then 'Could not extract readable text from this document.' end as error_message,
        case when failed then 0 else chunks end::bigint as chunk_count,
        case when done then pages when not failed then page end::bigint as page, case when not failed then pages end::bigint as pages,
        case when not failed then ocr_pages end::bigint as ocr_pages, case when not failed and not done then block end::bigint as block,
        case when not failed and not done then blocks end::bigint as blocks,
        case when done then coalesce(total, frames) when not failed then frames end::bigint as batches,
        case when done then coalesce(total, frames) end::bigint as batches_total, case when done then chunks end::bigint as chunks_total
    from judged""")
SQL["document_runs"] = (["processing_runs"], SQL["document_state"][1].replace("processing_events", "processing_runs"))
VIEWS["answers"] = """
    select message_id, conversation_id, content, critique, tokens,
        case when empty and err is null and reason = 'stop' then 'error' else reason end as finish_reason,
        case when empty and err is null and reason = 'stop' then 'EMPTY_RESPONSE' else err end as error_code
    from (select *, trim(content) = '' as empty,
              case when base != 'error' and message_id % 7 = 0 then 'aborted' else base end as reason,
              case when base = 'error' then case when message_id % 22 = 0 then 'LLM_TIMEOUT' else 'RAG_ERROR' end end as err
          from (select m.message_id, m.conversation_id, case when m.message_id % 11 = 0 then 'error' else 'stop' end as base,
                    coalesce(string_agg(word, '' order by pos) filter (not crit), '') as content,
                    nullif(case when trim(coalesce(string_agg(word, '' order by pos) filter (crit), '')) != ''
                           then string_agg(word, '' order by pos) filter (crit) end, '') as critique,
                    count(*) filter (not crit) as tokens
                from (select message_id, conversation_id, g.pos, m2.message_id % 5 = 0 and g.pos % 10 = 9 as crit,
                             case when m2.message_id % 13 = 0 then ' ' else string_split(m2.content, ' ')[g.pos + 1] || ' ' end as word
                      from messages m2, unnest(range(len(string_split(m2.content, ' ')))) g(pos) where m2.role = 'assistant') m
                group by all))"""
NEEDS["answers"] = ["turns", "messages"]
add("assemble_answers", "answers", "select * exclude (conversation_id) from answers")
VIEWS["outcomes"] = f"""
    select a.message_id, a.conversation_id, r.user_id, r.route, {_MODE.replace('route', 'r.route')} as mode, a.finish_reason,
           trim(a.content) != '' as has_answer, a.error_code is not null as has_error
    from routed r join answers a on a.message_id = r.message_id + 1"""
NEEDS["outcomes"] = ["routed", "answers"]
add("route_summary", "outcomes", "select route, mode, finish_reason, count(*) as turns from outcomes group by all")
add("turn_report", "routed answers message_sources", f"""
    with used as (select query_id, count(*) filter (type = 'document') as d, count(*) filter (type = 'web') as w
                  from message_sources group by 1),
    titles as ({SQL['generate_titles'][1].strip()})
    select r.message_id, r.route, {_MODE.replace('route', 'r.route')} as mode, coalesce(d, 0) as document_sources, coalesce(w, 0) as web_sources,
           a.finish_reason, a.error_code, trim(a.content) != '' as has_answer,
           (case when r.message_id % 4 = 0 then r.message || '?' else r.message end) != r.message
               and length(trim(r.message || '?', ' ' || chr(10))) between 1 and 400
             or (r.message_id % 4 != 0 and trim(r.message, ' ' || chr(10)) != r.message and length(trim(r.message, ' ' || chr(10))) between 1 and 400) as rewritten,
           case when r.position = 0 then t.title end as new_title
    from routed r left join answers a on a.message_id = r.message_id + 1 left join used on query_id = r.message_id + 1
    left join titles t on t.message_id = r.message_id""")

# Window starts by recursion per key: the next window opens at the first able event after the last one ended.
VIEWS["requests"] = f"""
    select user_id as key, event_id as request_id, event_type, {_K} as k, epoch_us(ts) as us from events"""
add("fixed_window_limits", "requests", """
    with recursive opened(key, start) as (
        select key, min(us) from requests group by key
        union all
        select r.key, min(r.us) from opened o join requests r on r.key = o.key and r.us >= o.start + 86400000000 group by r.key, o.start),
    placed as (
        select r.*, (select max(start) from opened o where o.key = r.key and o.start <= r.us) as start from requests r),
    counted as (select *, row_number() over (partition by key, start order by us, request_id) as used from placed)
    select request_id, used, used <= 2 as allowed, greatest(2 - used, 0) as remaining,
           case when (start + 86400000000 - us + 500000) // 1000000 > 0 then (start + 86400000000 - us + 500000) // 1000000 else 86400 end::bigint as reset_seconds
    from counted""")
VIEWS["cache_requests"] = """
    select key as owner, event_type as name, request_id, us, k % 4 != 0 as able,
           (select count(*) from requests c where c.key = r.key and c.event_type = 'purchase'
            and (c.us, c.request_id) <= (r.us, r.request_id)) as epoch
    from requests r where event_type != 'purchase'"""
NEEDS["cache_requests"] = ["requests"]
add("ttl_cache_hits", "cache_requests", """
    with recursive fills(owner, name, epoch, us) as (
        select owner, name, epoch, min(us) from cache_requests where able group by all
        union all
        select r.owner, r.name, r.epoch, min(r.us) from fills f join cache_requests r
          on r.owner = f.owner and r.name = f.name and r.epoch = f.epoch and r.able and r.us >= f.us + 3 * 86400000000
        group by r.owner, r.name, r.epoch, f.us)
    select request_id, exists (
        select 1 from fills f where f.owner = r.owner and f.name = r.name and f.epoch = r.epoch
          and f.us < r.us and r.us < f.us + 3 * 86400000000) as hit
    from cache_requests r""")
VIEWS["ticks"] = """
    select key, request_id, us, event_type = 'signup' as stage_change,
           sum((event_type = 'signup')::int) over (partition by key order by us, request_id) as epoch from requests"""
NEEDS["ticks"] = ["requests"]
add("progress_throttle", "ticks", """
    with recursive writes(key, epoch, us) as (
        select key, epoch, min(us) from ticks group by all
        union all
        select t.key, t.epoch, min(t.us) from writes w join ticks t
          on t.key = w.key and t.epoch = w.epoch and t.us >= w.us + 86400000000 group by t.key, t.epoch, w.us)
    select t.request_id, exists (select 1 from writes w where w.key = t.key and w.epoch = t.epoch and w.us = t.us) as written
    from ticks t""")

# --- changes -------------------------------------------------------------------------------------

add("append_chunks", "lib_chunks", """
    select chunk_id, document_id, user_id, embedding_model from lib_chunks where status != 'failed'""")
add("append_sources", "message_sources", """
    select query_id as message_id, document_id, chunk_id, (idx - 1)::int as position,
           '{"index":' || idx || coalesce(',"document_id":' || document_id, '') || coalesce(',"chunk_id":' || chunk_id, '') || '}' as metadata
    from message_sources""")
add("append_documents", "lib_documents", """
    select sha256(user_id || '|' || content_hash) as document_id, user_id, name, 'pending' as status, 0 as chunk_count from lib_documents""")
add("append_conversations", "convs", """
    select conversation_id, case when conversation_id % 2 = 0 then title else 'New chat' end as title,
           case when conversation_id % 3 = 0 then mode else 'document' end as mode, false as pinned from convs""")
_NOW = "'2024-03-01 12:00:00'"
add("apply_document_status", "lib_documents", f"""
    select d.document_id, case when l.quality = 1 then 'ready' when l.quality = 0 then 'failed' else d.status end as status,
           case when l.doc_id is null then d.error_message when l.quality = 0 then 'bad text' end as error_message,
           case when l.doc_id is null then d.error_code end as error_code,
           case when l.toxic = 1 then 7 else 0 end as chunk_count,
           case when l.doc_id is null then d.created_at::varchar else {_NOW} end as updated_at
    from lib_documents d left join labels l on l.doc_id = d.document_id""")
add("fail_stale", "lib_documents", f"""
    select document_id, case when status in ('ready', 'failed') then status else 'failed' end as status,
           case when status in ('ready', 'failed') then error_message
                else 'Processing was interrupted. Please upload the document again.' end as error_message,
           case when status in ('ready', 'failed') then error_code else 'INTERRUPTED' end as error_code,
           case when status in ('ready', 'failed') then created_at::varchar else {_NOW} end as updated_at
    from lib_documents""")
VIEWS["doomed"] = """
    select document_id, user_id from lib_documents d join labels l on l.doc_id = d.document_id
    where (toxic = 1 or quality = 0) and document_id % 5 != 0"""
NEEDS["doomed"] = ["lib_documents"]
add("delete_documents", "doomed lib_chunks lib_documents", """
    select d.document_id, d.user_id, d.storage_key,
           (select count(*) from lib_chunks c where c.document_id = d.document_id) as deleted_chunks
    from lib_documents d where d.document_id in (select document_id from doomed)""")
add("delete_documents_kept", "doomed lib_chunks lib_documents", """
    select d.document_id, nullif((select count(*) from lib_chunks c where c.document_id = d.document_id), 0) as chunks
    from lib_documents d where d.document_id not in (select document_id from doomed)""")
add("stored_chunks_after_delete", "doomed lib_chunks", """
    select chunk_id, document_id, user_id, md5(content) as digest from lib_chunks
    where document_id not in (select document_id from doomed)""")
VIEWS["left_users"] = "select user_id from users where password_hash is not null or google_id is not null"
NEEDS["left_users"] = ["users"]
VIEWS["left_sources"] = """
    select s.message_id, s.position,
           case when s.chunk_id in (select chunk_id from lib_chunks where user_id in (select user_id from left_users)) then s.chunk_id end as chunk_id,
           case when s.document_id in (select document_id from lib_documents where user_id in (select user_id from left_users)) then s.document_id end as document_id
    from sources s join messages m on m.message_id = s.message_id join convs c on c.conversation_id = m.conversation_id
    where c.user_id in (select user_id from left_users)"""
NEEDS["left_sources"] = ["left_users", "turns", "messages", "sources", "convs", "lib_documents", "lib_chunks"]
add("cascade_sources", "left_sources", "select * from left_sources")
add("cascade_delete", "left_sources sessions", """
    select 'users' as table_name, count(*) as rows_left from left_users
    union all select 'sessions', count(*) from sessions where user_id in (select user_id from left_users)
    union all select 'documents', count(*) from lib_documents where user_id in (select user_id from left_users)
    union all select 'chunks', count(*) from lib_chunks where user_id in (select user_id from left_users)
    union all select 'conversations', count(*) from convs where user_id in (select user_id from left_users)
    union all select 'messages', count(*) from messages m join convs c on c.conversation_id = m.conversation_id
              where c.user_id in (select user_id from left_users)
    union all select 'sources', count(*) from left_sources""")
add("references_after_delete", "turns messages convs sources lib_chunks lib_documents", """
    with gone as (select document_id from lib_documents where document_id % 10 = 0),
    gone_chunks as (select chunk_id from lib_chunks where document_id in (select document_id from gone))
    select 'conversation' as kind, conversation_id as row_id, null::bigint as position,
           case when document_id not in (select document_id from gone) then document_id end as document_id, null::bigint as chunk_id
    from convs
    union all
    select 'citation', message_id, position, case when document_id not in (select document_id from gone) then document_id end,
           case when chunk_id not in (select chunk_id from gone_chunks) then chunk_id end
    from sources""")
add("apply_progress", "", """
    select doc_id as document_id, case when doc_id % 2 = 0 then n_chars + 1 else n_chars end as progress from documents""")
add("delete_conversations", "convs messages", """
    select conversation_id, nullif((select count(*) from messages m where m.conversation_id = c.conversation_id), 0) as messages
    from convs c where mode != 'web' or pinned""")
add("clear_messages", "convs messages", """
    select m.conversation_id, count(*) as deleted from messages m join convs c on c.conversation_id = m.conversation_id
    where c.mode = 'hybrid' group by 1""")
add("patch_conversations", "convs", f"""
    select conversation_id, case when mode != 'auto' and pinned then 'Renamed' else title end as title,
           case when mode = 'web' then 'auto' else mode end as mode, case when mode != 'hybrid' then document_id end as document_id,
           case when mode = 'auto' then updated_at::varchar else {_NOW} end as updated_at from convs""")
add("touch_conversations", "convs", f"""
    select conversation_id, case when pinned then {_NOW} else updated_at::varchar end as updated_at from convs""")
add("set_pinned", "convs", f"""
    select conversation_id, mode = 'auto' as pinned, case when mode = 'auto' then {_NOW} end as pinned_at from convs""")
add("purge_sessions", "sessions", "select session_id, user_id from sessions where expires_at > timestamp '2024-01-29'")
add("revoke_sessions", "sessions users", """
    select session_id, user_id from sessions where user_id in (select user_id from users where google_id is null)""")
add("sessions_with_users", "sessions users", """
    select s.session_id, s.user_id, u.name, u.email from sessions s join users u on u.user_id = s.user_id
    where s.expires_at > timestamp '2024-01-29'""")
add("users_by_email", "users", """
    select user_id, email from users where lower(email) in (select lower(source || '@example.COM') from documents)""")
add("session_expiry", "", """
    select event_id, strftime(ts + interval 30 day, '%Y-%m-%d %H:%M:%S') as expires_at from events""")
add("rollback_conversations", "outcomes convs", """
    select conversation_id from convs where conversation_id not in (
        select conversation_id from outcomes group by conversation_id having bool_or(has_error) and not bool_or(has_answer))""")
add("check_constraints", "users turns", """
    select 'users' as table_name, 'auth_method_present' as rule, user_id as row_key from users
    where password_hash is null and google_id is null
    union all select 'messages', 'role_known', message_id::varchar from turns where role not in ('user', 'assistant')""")
add("unique_violations", "lib_documents", """
    select 'documents_user_content_key' as rule, user_id || '|' || content_hash as row_key, count(*) as holders
    from lib_documents group by user_id, content_hash having count(*) > 1""")
add("ingest_documents", "judged lib_documents", """
    with files as (
        select *, 'src' || ((substr(user_id, 4)::int + document_id % 2) % 20) as sender, sha256(body) as hash from judged),
    firsts as (select *, min(name) filter (code is null) over (partition by sender, hash) as first_name from files),
    known as (
        select user_id, content_hash, min(case status when 'ready' then 0 when 'failed' then 2 else 1 end) as best
        from lib_documents group by all),
    acted as (
        select f.*, case when code is not null then 'reject' when name != first_name then 'reuse' when best = 0 then 'reuse'
                         when best = 1 then 'conflict' when best = 2 then 'replace' else 'new' end as action
        from firsts f left join known k on k.user_id = f.sender and k.content_hash = f.hash)
    select sender as user_id, name, code, action,
           case when action in ('new', 'replace') then case when extension in ('.txt', '.md') then 'ready' else 'failed' end end as status,
           case when action in ('new', 'replace') then case when extension = '.docx' then 'PARSE_FAILED'
                when extension not in ('.txt', '.md') then 'UNSUPPORTED_FORMAT' end end as error_code
    from acted""")

# --- streams give what their batch forms give -------------------------------------------------------

for _stream, _batch in (
    ("rate_limit_stream", "fixed_window_limits"), ("ttl_memo_stream", "ttl_cache_hits"),
    ("progress_throttle_stream", "progress_throttle"), ("document_state_stream", "document_state"),
    ("document_runs_stream", "document_runs"),
):
    SQL[_stream] = SQL[_batch]

# --- prompts -------------------------------------------------------------------------------------------

_NOTICE = "'" + context.NO_CURRENT_DATA.replace("'", "''") + "'"
VIEWS["turns_asked"] = f"""
    select r.message_id as query_id, r.conversation_id, r.user_id, r.message as question, r.requires_fresh_data, m.created_at,
           {_MODE.replace('route', 'r.route')} as mode, e.embedding::double[] as embedding, 'm' || (e.label % 2) as embedding_model
    from routed r join messages m on m.message_id = r.message_id join embeddings e on e.vec_id = r.message_id % (select v from sizes)"""
NEEDS["turns_asked"] = ["routed", "messages", "sizes"]
add("assemble_prompts", "turns_asked lib_chunks page_texts", f"""
    with spoken as (
        select q.query_id, m.*, row_number() over (partition by q.query_id order by m.created_at desc, m.message_id desc) as back
        from turns_asked q join messages m on m.conversation_id = q.conversation_id and m.created_at < q.created_at
        where trim(m.content) != '' qualify back <= 6),
    cut as (select query_id, role, back, case when length(content) > 1200 then substr(content, 1, 1200) || ' ...' else content end as content from spoken),
    fitted as (select *, sum(length(content)) over (partition by query_id order by back) as total from cut qualify back = 1 or total <= 6000),
    history as (
        select query_id, string_agg(case role when 'user' then 'User: ' else 'Assistant: ' end
            || case when length(trim(content, ' ' || chr(10))) > 800 then substr(trim(content, ' ' || chr(10)), 1, 800) || ' ...'
                    else trim(content, ' ' || chr(10)) end, chr(10) order by back desc) as history from fitted group by query_id),
    pairs as (
        select q.query_id, q.mode, c.chunk_id, c.content, c.document_name, c.page,
               round(list_cosine_distance(q.embedding, c.embedding), 12) as d
        from turns_asked q join lib_chunks c on c.user_id = q.user_id and c.embedding_model = q.embedding_model
        where c.status = 'ready' and q.mode in ('document', 'hybrid')),
    ranked as (select * from pairs qualify row_number() over (partition by query_id order by d, chunk_id) <= 12),
    flagged as (select *, max((d <= 0.75)::int) over (partition by query_id) as any_near from ranked),
    kept as (
        select *, row_number() over (partition by query_id order by d, chunk_id) as number from flagged
        where d <= 0.75 or (any_near = 0 and mode = 'document') qualify number <= 5),
    doc_blocks as (
        select query_id, number, '[' || number || '] ' || document_name || case when page > 0 then ', page ' || page else '' end
               || chr(10) || content as block from kept),
    doc_context as (
        select query_id, string_agg(block, chr(10) || chr(10) order by number) as context
        from (select *, sum(length(block)) over (partition by query_id order by number) as used from doc_blocks qualify used <= 12000)
        group by query_id),
    doc_counts as (select query_id, count(*) as n from kept group by query_id),
    page_hits as (
        select p.page_id % (select page_groups from sizes) as grp, coalesce(nullif(regexp_extract(p.html, '<title>([^<]*)</title>', 1), ''), p.url) as title, p.url,
               substr(t.text, 1, 600) as snippet, substr(t.text, 1, 8000) as body,
               row_number() over (partition by p.page_id % (select page_groups from sizes) order by p.page_id) as pos
        from pages p join page_texts t on t.page_id = p.page_id qualify pos <= 5),
    web as (
        select q.query_id, q.mode, h.pos, h.snippet, h.body, coalesce(n, 0) + h.pos as number, h.title, h.url
        from turns_asked q join page_hits h on h.grp = q.query_id % (select page_groups from sizes) left join doc_counts dc on dc.query_id = q.query_id
        where q.mode in ('web', 'hybrid')),
    web_context as (
        select query_id, string_agg('[' || number || '] ' || title || ' - ' || url || chr(10) || snippet, chr(10) || chr(10) order by number) as context,
               max(body) filter (pos = 1) as scraped
        from web group by query_id),
    whole as (
        select q.*, coalesce(h.history, '(no previous messages)') as past,
               coalesce(nullif(substr(d.context, 1, 12000), ''), '(no relevant passages found)') as doc_part,
               coalesce(nullif(substr(coalesce(w.context, '')
                   || case when w.scraped != '' then chr(10) || chr(10) || 'Full text of the most relevant page:' || chr(10) || w.scraped else '' end
                   || case when q.requires_fresh_data and w.query_id is null then {_NOTICE} else '' end, 1, 12000), ''),
                   '(no web results found)') as web_part
        from turns_asked q left join history h on h.query_id = q.query_id left join doc_context d on d.query_id = q.query_id
        left join web_context w on w.query_id = q.query_id)
    select query_id, mode, 'Conversation so far (for pronouns and follow-up context only):' || chr(10) || past || chr(10) || chr(10)
        || case mode when 'llm' then 'Question:' || chr(10) || question
           when 'document' then 'Retrieved context:' || chr(10) || doc_part || chr(10) || chr(10) || 'Question:' || chr(10) || question
                || chr(10) || chr(10) || 'Answer the question from the retrieved context.'
           when 'web' then 'Web research:' || chr(10) || web_part || chr(10) || chr(10) || 'Question:' || chr(10) || question
                || chr(10) || chr(10) || 'Answer the question from the web research.'
           else 'Document research:' || chr(10) || doc_part || chr(10) || chr(10) || 'Web research:' || chr(10) || web_part || chr(10) || chr(10)
                || 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer the question using both sources.' end as prompt
    from whole""")

add("asked_spaces", "lib_chunks questions", """
    select chunk_id, user_id, embedding_model from lib_chunks
    where (user_id, embedding_model) in (select (user_id, embedding_model) from questions where allow_weak)""")
add("retrieve_distinct", "lib_chunks questions", _ranked() + _kept(0.75, "true") + """
    select case twin when 0 then query_id else -1 - query_id end as query_id, idx as index, chunk_id
    from kept, (values (0), (1)) t(twin) where idx <= 2""")

add("extraction_info", "md_marked lib_chunks", """
    with measured as (select document_id, sum(heading::int) as headings, count(*) as lines from md_marked group by document_id),
    counts as (select document_id, count(*) as n, max(embedding_model) as model from lib_chunks group by document_id)
    select m.document_id, coalesce(n, 0)::int as chunk_count,
           '{"headings":' || headings || ',"lines":' || lines || ',"chunks":' || coalesce(n, 0)
           || coalesce(',"embeddingModel":"' || model || '"', '') || '}' as extraction_info
    from measured m left join counts c on c.document_id = m.document_id""")

SQL["token_stream"] = SQL["assemble_answers"]
