import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import anchored, folds
from corpusflow.streaming import jobs, processors
from tests.conftest import rows

SECOND = 1_000_000


def fold_limits(requests, points, seconds):
    state, out = {}, {}
    for at, request, key in sorted((a, r, k) for k, r, a in requests):
        start, used = state.get(key, (None, 0))
        if start is None or at >= start + seconds * SECOND:
            start, used = at, 0
        used += 1
        state[key] = (start, used)
        reset = (start + seconds * SECOND - at + 500_000) // SECOND
        out[request] = (used, used <= points, max(points - used, 0), reset or seconds)
    return out


def random_requests(seed, n=600):
    generator = random.Random(seed)
    # Key 0 owns most requests; some times coincide.
    return [
        (0 if i % 3 else i % 5, i, generator.randrange(0, 400) * SECOND + generator.choice([0, 0, 250_000])) for i in range(n)
    ]


def test_window_starts_at_the_first_request(spark):
    requests = [(1, 1, 0), (1, 2, 59 * SECOND), (1, 3, 61 * SECOND), (1, 4, 118 * SECOND), (1, 5, 121 * SECOND), (1, 6, 60 * SECOND)]
    df = spark.createDataFrame(requests, "key int, request_id int, at long")
    got = dict((r[0], r[1:]) for r in rows(anchored.fixed_window_limits(df, 2, 60), "request_id", "used", "allowed"))
    assert got == {1: (1, True), 2: (2, True), 6: (1, True), 3: (2, True), 4: (3, False), 5: (1, True)}


@pytest.mark.parametrize("hot_rows", [1_000_000, 100, 7])
@pytest.mark.parametrize("seconds", [1, 13, 90])
def test_slabs_of_hot_keys_give_the_same_windows(spark, hot_rows, seconds):
    requests = random_requests(seconds)
    df = spark.createDataFrame(requests, "key int, request_id int, at long")
    got = anchored.fixed_window_limits(df, 3, seconds, hot_rows=hot_rows)
    found = {r[0]: r[1:] for r in rows(got, "request_id", "used", "allowed", "remaining", "reset_seconds")}
    assert found == fold_limits(requests, 3, seconds)


def fold_cache(events, ttl):
    fills, out = {}, {}
    for at, request, owner, key, storable, clears in sorted(events):
        if clears:
            fills = {k: v for k, v in fills.items() if k[0] != owner}
            continue
        filled = fills.get((owner, key))
        hit = filled is not None and at < filled + ttl * SECOND
        if not hit and storable:
            fills[(owner, key)] = at
        out[request] = hit
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_cache_hits(spark, hot_rows):
    generator = random.Random(9)
    events = [
        (generator.randrange(0, 300) * SECOND, i, 1 if i % 4 else i % 3, generator.choice("ab"), generator.random() < 0.7, generator.random() < 0.05)
        for i in range(800)
    ]
    df = spark.createDataFrame(events, "at long, request_id int, owner int, key string, storable boolean, clears boolean")
    got = anchored.ttl_cache_hits(df.filter("not clears"), df.filter("clears"), 40, hot_rows=hot_rows)
    assert dict(rows(got, "request_id", "hit")) == fold_cache(events, 40)


def test_progress_writes(spark):
    ms = 1000
    events = [(1, 0, False), (2, 500, False), (3, 699, True), (4, 1300, False), (5, 1399, False), (6, 1400, True), (7, 2100, False)]
    df = spark.createDataFrame([("d", i, at * ms, c) for i, at, c in events], "document_id string, request_id int, at long, stage_change boolean")
    got = dict(rows(anchored.throttled_writes(df, 700), "request_id", "written"))
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True, 7: True}


EVENTS = "message_id long, seq long, type string, text string, finish_reason string, code string, aborted boolean"


def answer_rows():
    tokens = [(1, i, "token", f"w{i} ", None, None, False) for i in range(3000)]
    return [
        *tokens, (1, 5000, "done", None, None, None, False),
        (2, 1, "token", "part", None, None, True), (2, 2, "done", None, "stop", None, False),
        (3, 1, "token", "  ", None, None, False), (3, 2, "done", None, "stop", None, False),
        (4, 1, "token", "x", None, None, False), (4, 2, "error", None, None, "LLM_TIMEOUT", True),
        (5, 1, "error", None, None, "", False),
        (6, 1, "token", "answer", None, None, False), (6, 2, "critique_token", "fine", None, None, False), (6, 3, "done", None, "length", None, False),
    ]


WANT = {
    1: ("".join(f"w{i} " for i in range(3000)), None, 3000, "stop", None), 2: ("part", None, 1, "aborted", None),
    3: ("  ", None, 1, "error", "EMPTY_RESPONSE"), 4: ("x", None, 1, "error", "LLM_TIMEOUT"), 5: ("", None, 0, "error", "RAG_ERROR"),
    6: ("answer", "fine", 1, "length", None),
}
COLUMNS = ("message_id", "content", "critique", "tokens", "finish_reason", "error_code")


def test_answers(spark):
    got = folds.assemble_answers(spark.createDataFrame(answer_rows(), EVENTS))
    assert {r[0]: r[1:] for r in rows(got, *COLUMNS)} == WANT


def replay(spark, folder, batches, schema):
    """A stream whose micro-batches are the given lists of rows."""
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{number}")
    session = jobs.stream_session(spark, 3)
    return session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_streams_equal_batch_forms(spark, tmp_path):
    requests = sorted(random_requests(4, 200), key=lambda r: (r[2], r[1]))
    schema = "key long, request_id long, at long"
    stream = replay(spark, str(tmp_path / "limits"), [requests[:70], requests[70:110], requests[110:]], schema)
    got = jobs.drain(jobs.rate_limit_stream(stream, 3, 20), spark, "limits")
    assert {r[0]: r[1:] for r in rows(got, "request_id", "used", "allowed", "remaining", "reset_seconds")} == fold_limits(requests, 3, 20)

    events = answer_rows()
    stream = replay(spark, str(tmp_path / "answers"), [events[:1000], events[1000:]], EVENTS)
    got = jobs.drain(jobs.token_stream_assembly(stream), spark, "answers")
    assert {r[0]: r[1:] for r in rows(got, *COLUMNS)} == WANT


def state_rows(progress):
    return [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]


def test_state_ends_with_its_windows(spark):
    """Thousands of keys, each with one window: the state of all but the last windows is gone when the replay ends."""
    requests = [(k, k, (86_400 + k * 10) * SECOND) for k in range(4000)]
    df = spark.createDataFrame(requests, "key long, request_id long, at long")
    progress = []
    got = jobs.drain(jobs.rate_limit_stream(jobs.replay(df, "at", "ends"), 3, 20, late_seconds=5), spark, "ends", progress=progress)
    assert got.count() == 4000
    sizes = state_rows(progress)
    assert max(sizes) >= 1000 and sizes[-1] <= 20

    ticks = df.selectExpr("key as document_id", "request_id", "at", "false as stage_change")
    progress = []
    got = jobs.drain(jobs.progress_throttle_stream(jobs.replay(ticks, "at", "tick-ends"), 700, late_seconds=5), spark, "tick-ends", progress=progress)
    assert got.filter("written").count() == 4000
    sizes = state_rows(progress)
    assert max(sizes) >= 1000 and sizes[-1] <= 20


@pytest.mark.parametrize("hot", [False, True])
def test_throttle_stream_equals_batch_form(spark, hot):
    generator = random.Random(8)
    ticks = [(0 if hot else i % 5, i, (100_000 + generator.randrange(0, 100_000)) * 1000, generator.random() < 0.1) for i in range(900)]
    df = spark.createDataFrame(ticks, "document_id long, request_id long, at long, stage_change boolean")
    want = dict(rows(anchored.throttled_writes(df, 700), "request_id", "written"))
    got = jobs.drain(jobs.progress_throttle_stream(jobs.replay(df, "at", "hot"), 700), spark, "hot")
    assert dict(rows(got, "request_id", "written")) == want


def test_answers_leave_the_state(spark):
    """Ended answers are forgotten after late tokens, unfinished ones are given out when their life ends."""
    events = []
    for m in range(400):
        at = (86_400 + m * 60) * SECOND
        events += [(m, 0, "token", f"t{m}", None, None, False, at), (m, 1, "critique_token", "c", None, None, False, at + 1)]
        if m % 4:
            events.append((m, 2, "done", None, None, None, m % 8 == 1, at + 2))
            events.append((m, 3, "token", "late", None, None, False, at + 3 * 60 * SECOND))
    df = spark.createDataFrame(events, EVENTS + ", at long")
    progress = []
    stream = jobs.token_stream_assembly(jobs.replay(df, "at", "lives"), late_seconds=600, life_seconds=1200)
    answers = rows(jobs.drain(stream, spark, "lives", progress=progress), *COLUMNS)
    got = {r[0]: r[1:] for r in answers}
    assert len(got) == len(answers)
    # A token after the end counts only if it came in the same micro-batch; it never makes a second answer.
    for m in range(400):
        if m % 4:
            assert got[m][0] in (f"t{m}", f"t{m}late") and got[m][1] == "c" and got[m][3:] == ("aborted" if m % 8 == 1 else "stop", None)
    # Answers without an end come out with what they had, but for the last ones, whose life has not ended.
    assert {m for m in range(0, 370, 4)} <= set(got) and got[0] == ("t0", "c", 1, "stop", None)
    sizes = state_rows(progress)
    assert sizes[-1] < max(sizes)


def test_ended_documents_leave_the_state(spark):
    schema = (
        "document_id string, seq long, type string, stage string, page long, pages long, ocrPages long, block long, "
        "blocks long, count long, index long, batches long, code string, message string, at long"
    )
    log = []
    for d in range(300):
        at, name = (86_400 + d * 100) * SECOND, f"d{d}"
        log.append((name, 4 * d, "status", "ocr" if d % 3 else "extracting", d, None, None, None, None, None, None, None, None, None, at))
        log.append((name, 4 * d + 1, "chunks", None, None, None, None, None, None, d % 5, 1, None, None, None, at + 50 * SECOND))
        if d % 2:
            log.append((name, 4 * d + 2, "result", None, None, None, None, None, None, None, None, 1, None, None, at + 2000 * SECOND))
        elif d % 4:
            log.append((name, 4 * d + 2, "error", None, None, None, None, None, None, None, None, None, "E", "m", at + 2000 * SECOND))
    df = spark.createDataFrame(log, schema)
    progress = []
    stream = jobs.document_progress_stream(jobs.replay(df, "at", "docs"), late_seconds=60, life_seconds=5000)
    got = jobs.drain(stream, spark, "docs", "update", "document_id", progress=progress)
    want = folds.document_state(df)
    assert sorted(map(str, rows(got.select(want.columns)))) == sorted(map(str, rows(want)))
    sizes = state_rows(progress)
    assert sizes[-1] < max(sizes) / 2


def test_document_state_as_stream(spark, tmp_path):
    schema = (
        "document_id string, seq long, type string, stage string, page long, pages long, ocrPages long, block long, "
        "blocks long, count long, index long, batches long, code string, message string"
    )

    def event(doc, seq, type_, **values):
        names = ["stage", "page", "pages", "ocrPages", "block", "blocks", "count", "index", "batches", "code", "message"]
        return (doc, seq, type_, *[values.get(n) for n in names])

    log = [
        event("a", 1, "status", stage="extracting"), event("a", 2, "status", stage="ocr", page=1, pages=3, ocrPages=1),
        event("a", 3, "status", stage="extracting", page=3, pages=3), event("a", 4, "chunks", count=64, index=1),
        event("a", 5, "chunks", count=6, index=2), event("a", 6, "result", count=70, batches=2),
        event("b", 1, "chunks", count=64, index=1), event("b", 2, "error", code="PARSE_FAILED", message="no"),
        event("c", 1, "status", stage="ocr", page=1, pages=9), event("d", 1, "result", count=0, batches=0),
    ]
    want = {
        "a": ("ready", None, 70, 3, 2, 2), "b": ("failed", "PARSE_FAILED", 0, None, None, None),
        "c": ("ocr", None, 0, 1, None, None), "d": ("failed", "NO_TEXT_EXTRACTED", 0, None, None, None),
    }
    columns = ("document_id", "status", "error_code", "chunk_count", "page", "batches", "batches_total")
    batch = folds.document_state(spark.createDataFrame(log, schema))
    assert {r[0]: r[1:] for r in rows(batch, *columns)} == want
    stream = replay(spark, str(tmp_path / "state"), [log[:4], log[4:]], schema)
    got = jobs.drain(jobs.ingest_progress_stream(stream), spark, "state", "update", "document_id")
    assert {r[0]: r[1:] for r in rows(got, *columns)} == want


def test_latest_row(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "b")], "k int, seq int, v string")
    assert rows(folds.latest_per_key(df, ["k"], "seq"), "k", "seq", "v") == [(1, 3, None)]
    assert df.groupBy("k").agg(folds.latest_value("v", "seq")).first()[1] == "b"
    assert df.select(F.max("seq")).first()[0] == 3


def plain_windows(times, able, first, entry, used, width):
    out, group, start, count = [], -1, None, 0
    for at, opens, head in zip(times, able, first):
        if head:
            group += 1
            start, count = (None if entry[group] == anchored.NO_WINDOW else entry[group]), used[group]
        opened = opens and (start is None or at >= start + width)
        if opened:
            start, count = at, 0
        inside = start is not None and at < start + width
        count += opens and inside
        out.append((start if inside else anchored.NO_WINDOW, bool(opened), count if inside else 0))
    return out


def test_windows_of_several_groups_at_once():
    generator = random.Random(2)
    for _ in range(1500):
        n, width = generator.randint(1, 30), generator.choice([1, 5, 10])
        first = [i == 0 or generator.random() < 0.3 for i in range(n)]
        at, times, entry, used = 0, [], [], []
        for head in first:
            if head:
                at = generator.randint(0, 50)
                entry.append(generator.choice([anchored.NO_WINDOW, at - generator.randint(0, 20)]))
                used.append(0 if entry[-1] == anchored.NO_WINDOW else generator.randint(1, 5))
            at += generator.choice([0, 1, 3, 9, 40])
            times.append(at)
        able = [generator.random() < 0.7 for _ in range(n)]
        got = anchored.windows_of_run(np.array(times), np.array(able), np.array(first), np.array(entry), np.array(used), width)
        assert list(zip(*(x.tolist() for x in got))) == plain_windows(times, able, first, entry, used, width)


def test_replay_batches_grow_with_the_partitions(spark, monkeypatch):
    """Micro-batches are bounded for each state partition: more partitions don't make more calls of the same key."""
    monkeypatch.setattr(jobs, "REPLAY_ROWS", 100)
    df = spark.range(4000).selectExpr("id % 7 as key", "id as request_id", "86400000000 + id * 1000000 as at")
    progress = []
    stream = jobs.replay(df, "at", "grown", session=jobs.stream_session(spark, 8))
    got = jobs.drain(jobs.rate_limit_stream(stream, 3, 500), spark, "grown", progress=progress)
    assert sum(p["numInputRows"] > 0 for p in progress) <= 6
    columns = ("request_id", "used", "allowed", "remaining", "reset_seconds")
    assert sorted(rows(got, *columns)) == sorted(rows(anchored.fixed_window_limits(df, 3, 500), *columns))


class _Value:
    def __init__(self):
        self.value, self.written = None, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value, self.written = value, self.written + 1

    def clear(self):
        self.value = None

    def appendList(self, more):  # noqa: N802
        self.value, self.written = (self.value or []) + list(more), self.written + 1


class _Handle:
    """Counts the messages about timers."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def getValueState(self, *_):  # noqa: N802
        return _Value()

    getListState = getValueState

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter([(t,) for t in self.timers])

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_timers_and_tokens_take_few_messages():
    handle, limits = _Handle(), processors.FixedWindow(2, 10)
    limits.init(handle)
    for at in (1, 2, 3):
        list(limits.handleInputRows((1,), [pd.DataFrame({"at": [at * SECOND], "request_id": [at]})], None))
    assert handle.calls == 1 and handle.timers == {11_000}
    list(limits.handleInputRows((1,), [pd.DataFrame({"at": [11 * SECOND], "request_id": [4]})], None))
    assert handle.timers == {21_000}

    handle, answers = _Handle(), processors.AnswerAssembly(600_000, 3_600_000)
    answers.init(handle)
    whole = pd.DataFrame({
        "seq": [1, 0, 2], "type": ["token", "token", "done"], "text": ["b", "a", None], "finish_reason": [None, None, None],
        "code": [None] * 3, "aborted": [False] * 3, "event_ms": [5, 5, 5],
    })
    out = list(answers.handleInputRows((1,), [whole], None))
    assert out[0]["content"].tolist() == ["ab"] and answers.tokens.written == 0 and handle.timers == {600_005}
    assert list(answers.handleInputRows((1,), [whole], None)) == []
