"""Rolling hashes over word sequences: windows, and the anchors that stand for them in an index."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the two rolling polynomials modulo 2^64 (any odd numbers do).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEEDS = (0, 0x5EED)


def words_of(text: str | None) -> list[bytes]:
    """The runs of characters without ASCII white space, in UTF-8."""
    return text.encode("utf-8").split() if text else []


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def rolling(x: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each k consecutive values: sum of x[i+j] * base^(k-1-j), mixed; by doubling, so O(n log k)."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    n = len(x) - k + 1
    out, done, power, span, square = None, 0, x, 1, base & (1 << 64) - 1
    with np.errstate(over="ignore"):
        while True:
            if k & span:
                part = power[done:]
                out = part.copy() if out is None else out[: len(part)] * np.uint64(square) + part[: len(out)]
                done += span
            if span * 2 > k:
                break
            power = power[:-span] * np.uint64(square) + power[span:]
            square = square * square & (1 << 64) - 1
            span *= 2
    return mixed(out[:n])


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    span, least = 1, x
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return least if span == w else np.minimum(least[: len(x) - w + 1], least[w - span : w - span + len(x) - w + 1])


def anchors(x: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Of each window of words the least hash of the grams inside it: equal windows have equal anchors."""
    return sliding_min(rolling(x, gram, BASES[0]), window - gram + 1)
