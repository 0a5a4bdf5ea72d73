"""Stateful processors: one small state per key, rows folded in time order per micro-batch.

Each state ends: a timer in event time removes it when the watermark has passed the time up to
which it can matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Rows of one output frame.
OUT_ROWS = 10_000


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, ignore_index=True)


def _times(rows: Iterator[pd.DataFrame], *more: str) -> list[np.ndarray]:
    """(at, request_id, more...) of all rows in time order; of each frame read only these columns are kept."""
    names = ("at", "request_id", *more)
    pieces = [[pdf[name].to_numpy() for name in names] for pdf in rows]
    columns = [np.concatenate(column) for column in zip(*pieces, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return [column[order] for column in columns]


def _frames(names: list[str], columns: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        yield pd.DataFrame({name: column[at:at + OUT_ROWS] for name, column in zip(names, columns, strict=True)})


def _wake_at(handle: StatefulProcessorHandle, millis: int) -> None:
    """One timer per key: at this event time, and no longer at an earlier one."""
    for set_before in list(handle.listTimers()):
        handle.deleteTimer(set_before[0] if isinstance(set_before, (list, tuple)) else set_before)
    handle.registerTimer(int(millis))


def _move_timer(handle: StatefulProcessorHandle, before: int | None, millis: int) -> None:
    """As ``_wake_at`` where the state tells the timer set before, so that most calls need no message to the store."""
    if before == millis:
        return
    if before is not None:
        handle.deleteTimer(before)
    handle.registerTimer(int(millis))


def _millis_after(micros: int) -> int:
    """First whole millisecond at or after a time in microseconds."""
    return -(-int(micros) // 1000)


class FixedWindow(StatefulProcessor):
    """Counter window anchored at the first request; rejected requests count as well.

    A window whose end the watermark has passed decides nothing any more: its state goes.
    """

    def __init__(self, points: int, window_seconds: int):
        self.points, self.window_seconds, self.width = points, window_seconds, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, used bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        at, requests = _times(rows)
        start, used = before = self.window.get() or (None, 0)
        starts, counts, i = np.empty(len(at), np.int64), np.empty(len(at), np.int64), 0
        while i < len(at):
            if start is None or at[i] >= start + self.width:
                start, used = int(at[i]), 0
            end = max(i + 1, int(np.searchsorted(at, start + self.width, side="left")))
            starts[i:end] = start
            counts[i:end] = np.arange(used + 1, used + 1 + end - i)
            used, i = used + end - i, end
        self.window.update((start, used))
        _move_timer(self.handle, None if before[0] is None else _millis_after(before[0] + self.width), _millis_after(start + self.width))
        seconds = (starts + self.width - at + 500_000) // 1_000_000
        yield from _frames(
            ["request_id", "used", "allowed", "remaining", "reset_seconds"],
            [requests, counts, counts <= self.points, np.maximum(self.points - counts, 0), np.where(seconds == 0, self.window_seconds, seconds)],
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


class MemoCache(StatefulProcessor):
    """Fill times per cache key of one owner; a change of the owner's documents clears them all."""

    def __init__(self, ttl_seconds: int, ttl_ms: int | None = None):
        self.width, self.ttl_ms = ttl_seconds * 1_000_000, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fills = handle.getMapState("fills", "key string", "filled bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        pdf = _in_order(rows, ["at", "request_id"])
        out = []
        for request, name, at, storable, clears in zip(
            pdf["request_id"], pdf["key"], pdf["at"], pdf["storable"], pdf["clears"]
        ):
            if clears:
                self.fills.clear()
                continue
            slot = (str(name),)
            filled = self.fills.getValue(slot)[0] if self.fills.containsKey(slot) else None
            hit = filled is not None and int(at) < filled + self.width
            if not hit and storable:
                self.fills.updateValue(slot, (int(at),))
            out.append((int(request), hit))
        yield pd.DataFrame(out, columns=["request_id", "hit"]).astype({"request_id": "int64", "hit": "bool"})

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """At most one counter write per interval; a stage change always writes and restarts the clock.

    When the interval after the last write has passed, the next event is written anyway: the state goes.
    """

    def __init__(self, interval_ms: int):
        self.width = interval_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_write", "at bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        at, requests, change = _times(rows, "stage_change")
        last = before = (self.last.get() or (None,))[0]
        written = change.astype(bool)
        changes = np.append(np.flatnonzero(written), len(at))
        i, next_change = 0, 0
        while i < len(at):
            while changes[next_change] < i:
                next_change += 1
            stop = int(changes[next_change])
            due = i if last is None else i + int(np.searchsorted(at[i:stop], last + self.width, side="left"))
            due = min(due, stop)
            if due == len(at):
                break
            written[due] = True
            last, i = int(at[due]), due + 1
        if last != before:
            self.last.update((last,))
            _move_timer(self.handle, None if before is None else _millis_after(before + self.width), _millis_after(last + self.width))
        yield from _frames(["request_id", "written"], [requests, written])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class AnswerAssembly(StatefulProcessor):
    """Collects the tokens of a message and emits the answer when its done or error event arrives.

    The mark of an ended answer stays for the time that late tokens may take; an answer whose end never
    comes is given out as it is when nothing has arrived for its life time. Then nothing of it is kept.
    """

    def __init__(self, late_ms: int, life_ms: int):
        self.late_ms, self.life_ms = late_ms, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "seq bigint, critique boolean, text string")
        self.status = handle.getValueState("status", "ended boolean, aborted boolean, wakes bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        before = self.status.get()
        ended, aborted, wakes = before or (False, False, None)
        # An answer ends once; what arrives later would only fill the state.
        if ended:
            for _ in rows:
                pass
            return
        last, code, code_seq, reason, latest, arrived = None, None, None, None, 0, []
        for pdf in rows:
            latest = max(latest, int(pdf["event_ms"].max()))
            aborted = aborted or bool(pdf["aborted"].any())
            for s, t, x, why, c in zip(*(pdf[n].tolist() for n in ("seq", "type", "text", "finish_reason", "code")), strict=True):
                if t in ("token", "critique_token"):
                    arrived.append((int(s), t == "critique_token", x or ""))
                elif t in ("done", "error"):
                    if last is None or s > last:
                        last, reason = s, "error" if t == "error" else why or "stop"
                    if t == "error" and (code_seq is None or s > code_seq):
                        code_seq, code = s, c or "RAG_ERROR"
        wake = latest + (self.life_ms if last is None else self.late_ms)
        self.status.update((last is not None, aborted, wake))
        _move_timer(self.handle, wakes, wake)
        if last is not None:
            # Of an answer that comes whole nothing goes through the state.
            yield self._answer(key, reason, code, aborted, self._stored() + arrived if before else arrived)
        elif arrived:
            self.tokens.appendList(arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        ended, aborted, _ = self.status.get() or (True, False, None)
        if not ended:
            yield self._answer(key, "stop", None, aborted, self._stored())
        self.status.clear()

    def _stored(self) -> list[tuple]:
        pieces = list(self.tokens.get()) if self.tokens.exists() else []
        self.tokens.clear()
        return pieces

    def _answer(self, key, reason, code, aborted, pieces) -> pd.DataFrame:
        pieces = sorted(pieces)
        content = "".join(text for _, critique, text in pieces if not critique)
        critique = "".join(text for _, critique, text in pieces if critique)
        if reason != "error" and aborted:
            reason = "aborted"
        if not content.strip() and code is None and reason == "stop":
            reason, code = "error", "EMPTY_RESPONSE"
        return pd.DataFrame(
            {
                "message_id": [key[0]], "content": [content], "critique": [critique if critique.strip() else None],
                "tokens": [sum(not c for _, c, _ in pieces)], "finish_reason": [reason], "error_code": [code],
            }
        )

    def close(self) -> None:
        pass


#: Counters of which the latest measured value counts, and the flags of a document, as they are kept.
MEASURES = ("page", "pages", "ocrPages", "block", "blocks")
FOLDED = (
    "document_id string, " + "".join(f"{m} bigint, " for m in MEASURES) + "_ocr boolean, _embedding boolean, _result boolean, "
    "_error boolean, _code string, _message string, _chunks bigint, _batches bigint, _batches_total bigint"
)


class DocumentFold(StatefulProcessor):
    """The running state of a document; one that has ended is forgotten when late events can't come any more.

    Every micro-batch with events of a document gives its state so far. A document that never ends is
    forgotten after its life time without events; what was given out stays.
    """

    def __init__(self, late_ms: int, life_ms: int):
        self.late_ms, self.life_ms = late_ms, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Number of the event that a value comes from beside the value; a number alone for sums and flags.
        self.folded = handle.getValueState("folded", "state string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        state = json.loads(self.folded.get()[0]) if self.folded.exists() else {}
        latest = 0
        for pdf in rows:
            latest = max(latest, int(pdf["event_ms"].max()))
            self._add(state, pdf)
        self.folded.update((json.dumps(state),))
        over = state.get("_result") or state.get("_error")
        _wake_at(self.handle, latest + (self.late_ms if over else self.life_ms))
        value = lambda name: state[name][1] if name in state else None
        yield pd.DataFrame({
            "document_id": [key[0]], **{m: pd.array([value(m)], dtype="Int64") for m in MEASURES},
            **{f: [bool(state.get(f))] for f in ("_ocr", "_embedding", "_result", "_error")},
            "_code": [value("_code")], "_message": [value("_message")], "_chunks": [state.get("_chunks", 0)],
            "_batches": pd.array([value("_batches")], dtype="Int64"), "_batches_total": pd.array([state.get("_batches_total")], dtype="Int64"),
        })

    @staticmethod
    def _add(state: dict, pdf: pd.DataFrame) -> None:
        def keep(name: str, part: pd.DataFrame, column: str, last: bool = True) -> None:
            if not len(part):
                return
            row = part.loc[part["seq"].idxmax() if last else part["seq"].idxmin()]
            seq, value = int(row["seq"]), row[column]
            if name not in state or (seq > state[name][0]) == last:
                state[name] = [seq, None if pd.isna(value) else value if isinstance(value, str) else int(value)]

        status, frames = pdf[pdf["type"] == "status"], pdf[pdf["type"] == "chunks"]
        results, errors = pdf[pdf["type"] == "result"], pdf[pdf["type"] == "error"]
        for name in MEASURES:
            keep(name, status[status[name].notna()], name)
        keep("_batches", frames, "index")
        keep("_code", errors, "code", last=False)
        keep("_message", errors, "message", last=False)
        state["_ocr"] = bool(state.get("_ocr")) or bool((status["stage"] == "ocr").any())
        for flag, part in (("_embedding", frames), ("_result", results), ("_error", errors)):
            state[flag] = bool(state.get(flag)) or len(part) > 0
        state["_chunks"] = state.get("_chunks", 0) + int(frames["count"].fillna(0).sum())
        totals = results["batches"].dropna()
        if len(totals):
            state["_batches_total"] = max(state.get("_batches_total") or 0, int(totals.max()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        self.folded.clear()
        return iter(())

    def close(self) -> None:
        pass
