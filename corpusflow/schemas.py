"""Table schemas, enumerations and tuning defaults."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations the stored rows must use.
DOCUMENT_STATUSES = [
    "pending", "uploading", "extracting", "ocr", "chunking",
    "embedding", "processing", "ready", "failed",
]
TERMINAL_STATUSES = ["ready", "failed"]
PROGRESS_STAGES = ["uploading", "extracting", "ocr", "chunking", "embedding", "ready"]
CONVERSATION_MODES = ["auto", "document", "web", "hybrid"]
MESSAGE_ROLES = ["user", "assistant"]

# Tuning defaults.
RETRIEVAL_K = 5
RETRIEVAL_FETCH_K = 12
MAX_COSINE_DISTANCE = 0.75
MAX_L2_DISTANCE = 1.5
EMBEDDING_DIMENSION = 768
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 100
BATCH_SIZE = 64
CONTEXT_CHARS = 12000
SNIPPET_CHARS = 600
SCRAPE_CHARS = 8000
HISTORY_MESSAGES = 6
HISTORY_CHARS = 6000
HISTORY_CHARS_PER_MESSAGE = 1200
PROMPT_HISTORY_CHARS = 800
MAX_TITLE_LENGTH = 60
MAX_MESSAGE_LENGTH = 8000
SEARCH_LIMIT = 30
OCR_CHAR_THRESHOLD = 40
PAGE_TICK = 10
PROGRESS_INTERVAL_MS = 700
UPLOAD_MAX_BYTES = 25 * 1024 * 1024
CACHE_TTL_SECONDS = {"retrieval": 300, "embedding": 3600, "web": 900}
RATE_LIMITS = {
    "login": (5, 15 * 60),
    "signup": (5, 60 * 60),
    "oauth": (20, 15 * 60),
    "chat": (20, 60),
    "upload": (10, 60 * 60),
    "api": (300, 60),
}

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOL, TS = T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


LOCATORS = _struct(
    page=INT, slide=INT, paragraph=INT, line=INT, table=INT, section=STRING, title=STRING
)
BLOCKS = _struct(document_id=STRING, block_no=INT, text=STRING, metadata=LOCATORS)
PROGRESS = _struct(
    stage=STRING, page=LONG, pages=LONG, ocrPages=LONG, block=LONG, blocks=LONG,
    batches=LONG, batchesTotal=LONG, chunks=LONG, chunksTotal=LONG,
)
EXTRACTION_INFO = _struct(
    pageCount=LONG, usedOcr=BOOL, ocrPages=LONG, paragraphs=LONG, tables=LONG,
    slideCount=LONG, headings=LONG, lines=LONG, chunks=LONG, embeddingModel=STRING,
)

USERS = _struct(
    user_id=STRING, name=STRING, email=STRING, password_hash=STRING, google_id=STRING,
    avatar_url=STRING, created_at=TS, updated_at=TS,
)
SESSIONS = _struct(
    session_id=STRING, user_id=STRING, user_agent=STRING, ip=STRING, created_at=TS, expires_at=TS
)
DOCUMENTS = _struct(
    document_id=STRING, user_id=STRING, name=STRING, original_filename=STRING, mime_type=STRING,
    file_size=LONG, storage_key=STRING, content_hash=STRING, status=STRING, error_message=STRING,
    error_code=STRING, extraction_info=EXTRACTION_INFO, progress=PROGRESS, chunk_count=INT,
    created_at=TS, updated_at=TS,
)
CHUNKS = _struct(
    chunk_id=STRING, document_id=STRING, user_id=STRING, chunk_index=INT, content=STRING,
    metadata=STRING, embedding=VECTOR, embedding_model=STRING, created_at=TS,
)
CONVERSATIONS = _struct(
    conversation_id=STRING, user_id=STRING, title=STRING, mode=STRING, document_id=STRING,
    pinned=BOOL, pinned_at=TS, created_at=TS, updated_at=TS,
)
MESSAGES = _struct(
    message_id=STRING, conversation_id=STRING, role=STRING, content=STRING, metadata=STRING,
    created_at=TS,
)
MESSAGE_SOURCES = _struct(
    message_id=STRING, document_id=STRING, chunk_id=STRING, position=INT, metadata=STRING,
    created_at=TS,
)

INGEST_EVENTS = _struct(
    type=STRING, stage=STRING, page=LONG, pages=LONG, ocrPages=LONG, block=LONG, blocks=LONG,
    count=LONG, index=LONG, batches=LONG, code=STRING, message=STRING,
)
ANSWER_EVENTS = _struct(
    type=STRING, text=STRING, stage=STRING, label=STRING, code=STRING, message=STRING,
    finishReason=STRING,
)
