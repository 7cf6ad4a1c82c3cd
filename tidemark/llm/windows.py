"""Vectorised word and window hashing over concatenated texts (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tidemark.llm.common import mix64

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that separate words: the space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    size = 1
    with np.errstate(over="ignore"):
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * (out[size - 1] * base)
            size += more
    return out[:n]


def rolling(values: np.ndarray, size: int, base: np.uint64 = _WORD_BASE) -> np.ndarray:
    """Mixed polynomial hashes of every ``size`` consecutive values, built by doubling the width."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have, width = values, 1
    with np.errstate(over="ignore"):
        power = powers(base, size + 1)
        for bit in bin(size)[3:]:
            have = have[: len(have) - width] * power[width] + have[width:]
            width *= 2
            if bit == "1":
                have = have[: len(have) - 1] * base + values[width:]
                width += 1
    return mix64(have)


def spaced(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with a space after each, so that no word runs into the next text, and the new offsets."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    held = np.full(len(body) + n, 0x20, np.uint8)
    held[np.arange(len(body)) + np.repeat(np.arange(n), sizes)] = body
    return held, offsets + np.arange(n + 1)


def words_of(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.concatenate(([False], ~_SPACE[body], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    taken = body[np.repeat(starts, lengths) + within].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        taken *= powers(_BYTE_BASE, int(lengths.max()))[within]
        return mix64(np.add.reduceat(taken, first))


def single_spaced(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with one space after each, and where each begins (one more for the end): equal word sequences are equal bytes."""
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.full(int(first[-1]), 0x20, np.uint8)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(first[:-1], sizes) + within] = body[np.repeat(starts, sizes) + within]
    return out, first


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def chunks(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together, a longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
