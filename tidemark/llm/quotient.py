"""A counting quotient filter in numpy: fingerprints split into quotient and remainder, kept sorted, with exact counts.

A filter covers the fingerprints of one slice (equal top ``s`` bits). The next ``q`` bits of a fingerprint are its quotient,
the rest its remainder. Serialised, it is the classic layout without empty slots: one ``occupied`` bit per quotient, one
``run end`` bit per stored remainder, the remainders in order, and counters beside the remainders whose ``counted``
bit is set. Two filters merge losslessly by merging their sorted remainders; counts add.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a fingerprint that name its slice, if not given; those of the quotient follow the number of fingerprints.
SLICE_BITS = 8
_HEAD = "<BBqq"


class QuotientFilter:
    """Sorted distinct fingerprints of one slice (all bits kept, so nothing is lost) and how often each was added."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, s: int = SLICE_BITS) -> None:
        self.keys, self.counts, self.s = keys, counts, s
        self.q = max(3, min(20, len(keys).bit_length()))

    @classmethod
    def of(cls, fingerprints: np.ndarray, s: int = SLICE_BITS) -> QuotientFilter:
        keys, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls(keys, counts.astype(np.int64), s)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """Any number of sorted runs into one; equal remainders of equal quotients add their counts. A stable sort takes runs as they come."""
        s = filters[0].s
        keys, counts = np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters])
        if not len(keys):
            return cls(keys, counts, s)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        return cls(keys[first], np.add.reduceat(counts[order], np.flatnonzero(first)), s)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        return self.merged([self, other])

    def split(self, bits: int) -> list[tuple[int, QuotientFilter]]:
        """(slice, filter) of the finer slices of the top ``bits`` bits."""
        if not len(self.keys):
            return []
        tops = (self.keys >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.concatenate(([True], tops[1:] != tops[:-1]))), len(tops))
        return [(int(tops[a]), QuotientFilter(self.keys[a:b], self.counts[a:b], s=bits)) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def count(self, fingerprint: int) -> int:
        i = int(np.searchsorted(self.keys, np.uint64(fingerprint)))
        return int(self.counts[i]) if i < len(self.keys) and int(self.keys[i]) == fingerprint else 0

    def repeated(self) -> np.ndarray:
        return self.keys[self.counts > 1]

    def to_bytes(self) -> bytes:
        """Slice, quotient and remainder bits apart."""
        n, rest = len(self.keys), 64 - self.s - self.q
        top = int(self.keys[0]) >> (64 - self.s) if n else 0
        quotients = (self.keys >> np.uint64(rest)).astype(np.int64) & ((1 << self.q) - 1)
        occupied = np.zeros(1 << self.q, bool)
        occupied[quotients] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        more = self.counts > 1
        width = -(-rest // 8)
        remainders = (self.keys & np.uint64((1 << rest) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - width :]
        return b"".join(
            (struct.pack(_HEAD, self.s, self.q, top, n), np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), np.packbits(more).tobytes(), remainders.tobytes(), self.counts[more].tobytes())
        )

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        s, q, top, n = struct.unpack_from(_HEAD, data)
        rest, at = 64 - s - q, struct.calcsize(_HEAD)
        width = -(-rest // 8)

        def bits(count: int) -> np.ndarray:
            nonlocal at
            size = -(-count // 8)
            out = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count).astype(bool)
            at += size
            return out

        occupied, ends, more = bits(1 << q), bits(n), bits(n)
        raw = np.zeros((n, 8), np.uint8)
        raw[:, 8 - width :] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        run = np.cumsum(ends) - ends  # the k-th run belongs to the k-th occupied quotient
        quotients = np.flatnonzero(occupied)[run].astype(np.uint64)
        keys = raw.view(">u8").ravel().astype(np.uint64) | quotients << np.uint64(rest) | np.uint64(top << (64 - s))
        counts = np.ones(n, np.int64)
        counts[more] = np.frombuffer(data, np.int64, int(more.sum()), at)
        return cls(keys, counts, s)
