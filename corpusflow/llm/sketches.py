"""HyperMinHash sketches of word shingles: registers, bands and the corrected estimate.

The hashes of a set are dealt to 128 buckets by their top bits. Of each bucket only the
smallest hash counts, and of it only the number of leading zeros and the ten bits behind
them: two bytes instead of eight.
"""

from __future__ import annotations

import numpy as np

from corpusflow.llm.batches import mixed, space_words, window_hashes, word_hashes

BUCKETS = 128
BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND_REGISTERS = 4
BANDS = BUCKETS // BAND_REGISTERS
#: Share of different minima that still get equal registers, times 2^mantissa (fixed value of the published estimator).
COLLISION = 0.169919487159739
EMPTY = np.uint16(0xFFFF)


def _donors() -> np.ndarray:
    """For each bucket an order of all buckets; an empty one takes over the first filled one in it."""
    ranks = mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(ranks.reshape(BUCKETS, BUCKETS), axis=1)
    # A filled bucket keeps its own value.
    own = np.arange(BUCKETS)[:, None]
    return np.concatenate([own, order], axis=1)


DONORS = _donors()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) word shingles; fewer words are one shingle, no words none."""
    words = space_words(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    if len(words) < width:
        # The length goes in, so that a short text never equals a shingle by chance of construction.
        return window_hashes(np.append(hashes, np.uint64(len(words))), len(words) + 1)
    return np.unique(window_hashes(hashes, width))


def raw_registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; EMPTY where no hash fell into the bucket."""
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(len(sets), dtype=np.int64), [len(s) for s in sets])
    bits = np.uint64(64 - BUCKET_BITS)
    place = row * BUCKETS + (hashes >> bits).astype(np.int64)
    # The sets are sorted, so the first hash of each (row, bucket) is its smallest.
    first = np.append(True, place[1:] != place[:-1])
    value = (hashes[first] << np.uint64(BUCKET_BITS)) | np.uint64(1)
    # Leading zeros by halving: exact for all 64 bits, which a float logarithm isn't.
    zeros = np.zeros(len(value), np.uint64)
    rest = value.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest >> np.uint64(64 - step) == 0
        zeros[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[place[first]] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def filled_up(raw: np.ndarray) -> np.ndarray:
    """Registers for banding: empty buckets copy a filled one, chosen alike in all sets."""
    occupied = raw != EMPTY
    donor = np.argmax(occupied[:, DONORS], axis=2)
    chosen = DONORS[np.arange(BUCKETS)[None, :], donor]
    return np.take_along_axis(raw, chosen, axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of raw registers, less the collisions that chance gives, and buckets in use."""
    used = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & used).sum(axis=1)
    n = used.sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = COLLISION * n / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / np.maximum(1, n), n
