"""Hashes of the words of many texts at once, and of windows of words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEED = 0x9E3779B97F4A7C15
CHUNK_BYTES = 1 << 20  # texts handled in one numpy pass, unless a single one is longer
WHITE_GAP = np.zeros(256, bool)
WHITE_GAP[[9, 10, 11, 12, 13, 32]] = True
# All ASCII but letters and digits: terms are runs of these and of characters beyond ASCII.
TERM_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=8)
def powers(base: int, count: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below ``count``."""
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _powers(base: int, count: int) -> np.ndarray:
    return powers(base, max(1 << 16, 1 << (count - 1).bit_length()))[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of word hashes keep no structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(items: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """One hash of each run ``items[begin:end]`` (polynomial modulo 2**64, length included).

    For windows of a bounded number of mixed 64-bit items only: over few different items, long runs exist whose
    polynomials are equal for every base.
    """
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum((items.astype(np.uint64) + np.uint64(1)) * _powers(seed, len(items)), out=total[1:])
    back = _powers(pow(seed, -1, 1 << 64), len(items))
    return mix((total[ends] - total[begins]) * back[np.minimum(begins, len(items) - 1)] + (ends - begins).astype(np.uint64))


@lru_cache(maxsize=4)
def _letter_values(seed: int) -> np.ndarray:
    """A value without structure for each byte at each of 64 places (place * 256 + byte)."""
    return mix(mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(SEED) + np.uint64(seed)) ^ np.uint64(seed))


def letter_run_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """One hash of each run of bytes ``data[begin:end]`` (in order, none overlap): the mixed sum of a value for each
    byte at its place in the run, and the length."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    # Bytes between runs get a value too, which no run's sum takes in.
    since = int(begins[0])
    place = np.arange(len(data) - since, dtype=np.int32)
    place -= np.repeat((begins - since).astype(np.int32), np.diff(begins, append=len(data)))
    value = _letter_values(seed)[(place & 63) << 8 | data[since:]]
    far = np.flatnonzero(place > 63)
    value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(SEED))
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mix(sums[ends - since] - sums[begins - since] + (ends - begins).astype(np.uint64) * np.uint64(SEED))


def few_hashes(items: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """One hash of each run of up to ``most`` items, each of them mixed in after the one before."""
    out = mix((ends - begins).astype(np.uint64) + np.uint64(SEED))
    for k in range(most):
        go = begins + k < ends
        out = np.where(go, mix(out * np.uint64(SEED) + items[np.minimum(begins + k, len(items) - 1)]), out)
    return out


def chunks(texts: list[bytes]):
    """Consecutive ranges of texts of about CHUNK_BYTES each."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size > CHUNK_BYTES:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], seed: int = SEED, gaps: np.ndarray = WHITE_GAP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and where each text's words begin (one more entry than texts).

    Words are maximal runs without gap bytes; by default ASCII white space, as ``bytes.split`` gives them.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = gaps[data]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bounds = np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(begins):
        return np.zeros(0, np.uint64), bounds
    return letter_run_hashes(data, begins, ends, seed), bounds


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """Hash of the ``length`` words from each position in ``at``."""
    return run_hashes(words, at, at + length, seed) if len(at) else np.zeros(0, np.uint64)
