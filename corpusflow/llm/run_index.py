"""A run-length compressed Burrows-Wheeler index of short passages, for repetitive collections.

Only the runs of the transform are kept: their bytes, where they start, how many equal bytes
lie in earlier runs, and the text place at each run's end. Many patterns are searched in
lockstep, backwards, byte by byte; the interval of a pattern is the same number for all its
occurrences, and a sampled run end gives the place of one of them.
"""

from __future__ import annotations

import numpy as np

#: Behind each passage; no UTF-8 text contains it.
SEPARATOR = 0xFF
#: Bytes behind which a search begins.
ENTRY = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in their order, by doubling from their first eight bytes."""
    n, width = len(text), 8
    padded = np.append(text, np.zeros(width - 1, np.uint8)).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = (key << np.uint64(8)) | padded[j:j + n]
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        if fresh.all() or width >= n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        key = rank << np.uint64(32)
        key[:-width] |= rank[width:]
        width *= 2


class RunIndex:
    """Backward search over the runs of the transform of `text` (at least a byte, the last one SEPARATOR)."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = self.order = suffix_order(text)
        n = self.n = len(text)
        before = text[order - 1]  # the byte before each suffix; the first text byte follows the last
        heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        lengths = np.diff(np.append(heads, n))
        ends = order[heads + lengths - 1]
        by_byte = np.argsort(before[heads], kind="stable")
        #: Numbers as narrow as the text allows, because the search is bound by the memory it walks through.
        self.kind = np.int32 if 257 * (n + 1) < 1 << 31 else np.int64
        self.start, self.length, self.byte = (x[by_byte].astype(self.kind) for x in (heads, lengths, before[heads]))
        #: Text place of the last suffix of each run, in this order.
        self.end_sample = ends[by_byte].astype(self.kind)
        self.last = int(order[-1])
        # Equal bytes in earlier runs, plus all smaller bytes: where LF leads a run's first row.
        self.target = np.append(0, np.cumsum(self.length)[:-1]).astype(self.kind)
        self.key = self.byte * self.kind(n + 1) + self.start
        self.first = np.searchsorted(self.byte, np.arange(257, dtype=self.kind)).astype(self.kind)
        self.smaller = np.append(self.target, self.kind(n))[self.first]

    @property
    def runs(self) -> int:
        return len(self.start)

    def _lead(self, byte: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that LF leads to: smaller bytes, and equal bytes before `row`; and the last run of that byte before it."""
        run = np.searchsorted(self.key, byte * self.kind(self.n + 1) + row, side="left") - 1
        own = run >= self.first[byte]
        run = np.maximum(run, 0)
        inside = self.target[run] + np.minimum(row - self.start[run], self.length[run])
        return np.where(own, inside, self.smaller[byte]), run

    def _entered(self, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval and last row's place of each string of `width` bytes that starts at one of `places` of the text.

        Rows of equal strings lie side by side; a border is where the first `width` bytes of two neighbours differ.
        """
        words, rest = divmod(width, 8)
        padded = np.append(self.text, np.zeros(width, np.uint8))
        key = sum(padded[j:j + self.n].astype(np.uint64) << np.uint64(8 * j) for j in range(8)) if words else None
        border = np.zeros(self.n, bool)
        border[0] = True
        for word in range(words):
            own = key[np.minimum(self.order + 8 * word, self.n - 1)]
            border[1:] |= own[1:] != own[:-1]
        for j in range(8 * words, width):
            own = padded[self.order + j]
            border[1:] |= own[1:] != own[:-1]
        heads = np.flatnonzero(border).astype(self.kind)
        ends = np.append(heads[1:], self.kind(self.n))
        group = np.empty(self.n, self.kind)
        group[self.order] = np.cumsum(border, dtype=self.kind) - 1
        group = group[places]
        return heads[group], ends[group], self.order.astype(self.kind)[ends - 1][group]

    def shared(self, text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(which, place): the patterns text[s:s + width] that occur at least twice, and where one occurrence lies.

        All occurrences of a pattern get the same place, that of its interval's last row: inside a run
        it stays in sight, past a run's end its sample takes over. Patterns of the indexed text itself enter
        at the interval of their last ENTRY bytes, from a table. Patterns whose interval has shrunk to
        their own occurrence leave the search at once: the lengths reached there are their matching
        statistics against the rest.
        """
        entry = min(ENTRY, width) if text is self.text else 0
        if entry:
            low, high, place = self._entered(starts + (width - entry), entry)
        else:
            low, high, place = (np.full(len(starts), x, self.kind) for x in (0, self.n, self.last))
        which = np.flatnonzero(high - low > 1)
        low, high, place = low[which], high[which], place[which]
        at = starts[which] + (width - entry)
        for _ in range(width - entry):
            at = at - 1
            byte = text[at].astype(self.kind)
            low, _ = self._lead(byte, low)
            last, run = self._lead(byte, high)
            place = np.where(self.start[run] + self.length[run] < high, self.end_sample[run], place) - 1
            high, alive = last, last - low > 1
            if not alive.all():
                which, low, high, place, at = which[alive], low[alive], high[alive], place[alive], at[alive]
            if not len(which):
                break
        return which, place

    def locate(self, pattern: bytes) -> int | None:
        """The place of one occurrence, from the samples at run ends; None if there is none."""
        low, high, place = 0, self.n, None
        for byte in reversed(pattern):
            leads, runs = self._lead(np.array([byte, byte], self.kind), np.array([low, high], self.kind))
            (new_low, new_high), run = leads.tolist(), int(runs[1])
            if new_high <= new_low:
                return None
            # Inside a run the last row stays in sight; past a run's end its sample takes over.
            if self.start[run] + self.length[run] < high or place is None:
                place = int(self.end_sample[run])
            place -= 1
            low, high = new_low, new_high
        return place
