"""Reading Arrow batches of (id, text) in bounded slices, for the operators that run numpy in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# White space of the contracts, by byte.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# Texts are handled together up to this many characters; a longer text is handled alone.
SLICE_CHARS = 1_500_000


def slices(batches: Iterator[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of at most ``chars`` characters, or of one longer text; a null text is empty."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        lo = n = 0
        for i, t in enumerate(texts):
            if n and n + len(t) > chars:
                yield ids[lo:i], texts[lo:i]
                lo, n = i, 0
            n += len(t)
        if lo < len(texts):
            yield ids[lo:], texts[lo:]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# FIXED VALUES: an odd multiplier and its inverse modulo 2^64.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)


def span_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes: its sum of (byte + 1) * P^place, mixed with its length."""
    if not len(start):
        return np.empty(0, np.uint64)
    power, back = np.full(len(text), P, np.uint64), np.full(len(text), P_INVERSE, np.uint64)
    power[0] = back[0] = 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.cumprod(power) * (text.astype(np.uint64) + np.uint64(1)))))
    return mixed((total[end] - total[start]) * np.cumprod(back)[start] + (end - start).astype(np.uint64))
