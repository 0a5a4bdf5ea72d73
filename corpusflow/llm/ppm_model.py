"""Prediction by partial matching over bytes: counts to a table-driven model, and scoring with it.

The trie's contexts are the states of an automaton: from each the next byte leads to the
longest known context. With a pretrained trie the probability of a byte depends on the state
alone, so escapes and symbol exclusion are worked out once per state, and texts are scored
by table lookups, many stretches of text in lockstep.
"""

from __future__ import annotations

import numpy as np

#: Bytes of context.
ORDER = 4
#: Stands before and behind each text; no UTF-8 text contains it.
EDGE = 0xFF
#: Bytes of text that one lane of the lockstep scores.
LANE = 1024


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with edges in one buffer, and the places [start, stop) to predict: the text and the end behind it."""
    lead = bytes([EDGE]) * ORDER
    buffer = np.frombuffer(b"".join(lead + t + lead[:1] for t in texts), np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + ORDER + 1
    ends = np.cumsum(sizes)
    return buffer, ends - sizes + ORDER, ends


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (context, byte) strings of ORDER + 1 bytes, packed big-endian, and how often each occurs."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    buffer, starts, ends = framed(texts)
    wide = buffer.astype(np.int64)
    n = len(wide) - ORDER
    keys = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        keys <<= 8
        keys |= wide[j:j + n]
    flags = np.zeros(len(wide) + 1, np.int8)
    np.add.at(flags, starts, 1)
    np.add.at(flags, ends, -1)
    wanted = np.cumsum(flags[:-1])[ORDER:] > 0
    return np.unique(keys[wanted], return_counts=True)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    head = np.flatnonzero(np.append(True, all_keys[1:] != all_keys[:-1])) if len(all_keys) else np.empty(0, np.int64)
    return all_keys[head], np.add.reduceat(all_counts, head) if len(head) else all_counts


class PPMModel:
    """log10 probabilities and next states, 256 of each per state; state 0 is the empty context."""

    def __init__(self, order: np.ndarray, gram: np.ndarray, count: np.ndarray):
        """Counts of (context, byte) strings: their context length, the packed bytes, occurrences.

        Contexts must be closed: with a context come the one without its first and without its last byte.
        """
        by_context: dict[tuple[int, int], list[tuple[int, int]]] = {(0, 0): []}
        for o, g, n in zip(order.tolist(), gram.tolist(), count.tolist(), strict=True):
            by_context.setdefault((o, g >> 8), []).append((g & 0xFF, n))
        names = sorted(by_context)
        number = {name: i for i, name in enumerate(names)}
        self.logp = np.zeros((len(names), 256), np.float32)
        self.next = np.zeros((len(names), 256), np.uint16 if len(names) <= 0xFFFF else np.uint32)
        counts = np.zeros((len(names), 256), np.float64)
        for name, seen in by_context.items():
            for byte, n in seen:
                counts[number[name], byte] = n
        #: log10 probability of each byte after an escape from the state, its own bytes excluded.
        escaped = np.zeros((len(names), 256), np.float64)
        for i, (length, context) in enumerate(names):
            own = counts[i]
            seen = own > 0
            if length == 0:
                escaped[i] = -np.log10(max(1, 256 - seen.sum()))
            else:
                shorter = number[(length - 1, context & ((1 << 8 * (length - 1)) - 1))]
                lower = counts[shorter]
                fresh = (lower > 0) & ~seen
                total, kinds = lower[fresh].sum(), fresh.sum()
                if kinds:
                    escaped[i] = np.log10(kinds / (total + kinds)) + escaped[shorter]
                    escaped[i][fresh] = np.log10(lower[fresh] / (total + kinds))
                else:
                    escaped[i] = escaped[shorter]
                self.next[i] = self.next[shorter]
            total, kinds = own.sum(), seen.sum()
            if kinds:
                self.logp[i] = np.log10(kinds / (total + kinds)) + escaped[i]
                self.logp[i][seen] = np.log10(own[seen] / (total + kinds))
            else:
                self.logp[i] = escaped[i]
            for byte in range(256) if length < ORDER else ():
                child = number.get((length + 1, context << 8 | byte))
                if child is not None:
                    self.next[i, byte] = child

        #: States from here on are contexts of full length.
        self.first_full = sum(length < ORDER for length, _ in names)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each whole text and its end."""
        return self._run(texts, None)

    def score_known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the log10 probability of the bytes behind contexts of full length; and the other bytes.

        These come as the number of the text and the packed context and byte.
        """
        places: list[np.ndarray] = []
        sums = self._run(texts, places)
        if not texts:
            return sums, np.empty(0, np.int64), np.empty(0, np.int64)
        buffer, _, ends = framed(texts)
        at = np.sort(np.concatenate(places))
        keys = np.zeros(len(at), np.int64)
        for back in range(ORDER, -1, -1):
            keys <<= 8
            keys |= buffer[at - back]
        return sums, np.searchsorted(ends, at, side="right"), keys

    def _run(self, texts: list[bytes], shallow: list[np.ndarray] | None) -> np.ndarray:
        """Sum along each text; with `shallow`, places with shorter contexts are added to it and not to the sum."""
        if not texts:
            return np.empty(0)
        buffer, starts, ends = framed(texts)
        lanes = [np.arange(a, b, LANE) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in lanes])
        begin = np.concatenate(lanes)
        length = np.minimum(ends[owner] - begin, LANE)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        logp, following = self.logp.reshape(-1), self.next.reshape(-1)
        state = np.zeros(len(begin), np.int64)
        # The last ORDER bytes before a lane determine its first state.
        for back in range(ORDER, 0, -1):
            state = following.take(state * 256 + buffer[begin - back]).astype(np.int64)
        total = np.zeros(len(begin))
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for step, n in enumerate(active.tolist()):
            at = state[:n] * 256
            at += buffer[begin[:n] + step]
            values = logp.take(at)
            if shallow is not None:
                short = state[:n] < self.first_full
                shallow.append(begin[:n][short] + step)
                values[short] = 0
            total[:n] += values
            state[:n] = following.take(at)
        return np.bincount(owner, weights=total, minlength=len(texts))
