"""An enhanced suffix array in numpy and the maximal repeats of its common-prefix interval tree.

The array sorts suffixes of many short texts at once and keeps the common prefix of neighbours. A stack scan over it
visits every interval of suffixes that share a prefix (the nodes of the suffix tree); an interval whose occurrences
are preceded by different bytes can't be extended to the left and is a maximal repeat, with all its occurrences.
"""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Suffixes given by text number and offset, sorted by group and then bytewise.

    body, starts, ends: texts end to end. Only suffixes of at least ``least`` bytes take part; a text's group bounds what it is compared with.
    """

    def __init__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray, least: int) -> None:
        counts = np.maximum(ends - starts - least + 1, 0)
        text = np.repeat(np.arange(len(starts)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        rest = (ends - starts)[text] - offset
        width = max(8, -(-int(rest.max(initial=0)) // 8) * 8)
        padded = np.concatenate([body, np.zeros(width, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        rows = view[starts[text] + offset].copy()
        rows[np.arange(width) >= rest[:, None]] = 0
        # group, bytes and length as one byte string: numpy sorts those by memory comparison
        lead, tail = (x.astype(">u4").view(np.uint8).reshape(-1, 4) for x in (groups[text], rest))
        packed = np.concatenate([lead, rows, tail], 1)
        order = np.argsort(packed.view(f"S{width + 8}").ravel(), kind="stable")
        self.text, self.offset, self.rest = text[order], offset[order], rest[order]
        rows = rows[order]
        group = groups[self.text]
        self.lcp = np.zeros(len(order), np.int64)
        if len(order) > 1:
            differs = rows[1:] != rows[:-1]
            common = np.where(differs.any(1), differs.argmax(1), width)
            common = np.minimum(common, np.minimum(self.rest[1:], self.rest[:-1]))
            self.lcp[1:] = np.where(group[1:] == group[:-1], common, 0)
        # the byte before; a suffix at its text's start has none and differs from all others
        before = starts[self.text] + self.offset - 1
        left = np.where(self.offset > 0, padded[np.maximum(before, 0)].astype(np.int64), -1 - np.arange(len(order)))
        self.changes = np.concatenate(([0], np.cumsum(left[1:] != left[:-1]))) if len(left) else np.zeros(0, np.int64)

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last): every interval of the tree with a common prefix of ``least`` or more, inner ones first, by a stack scan."""
        deep = np.flatnonzero(self.lcp >= least)
        if not len(deep):
            return (np.zeros(0, np.int64),) * 3
        ends = deep[np.append(np.diff(deep) > 1, True)] + 1  # a lower prefix closes what is open
        at = np.concatenate([deep, ends])
        order = np.argsort(at, kind="stable")
        values = np.concatenate([self.lcp[deep], np.zeros(len(ends), np.int64)])[order]
        lengths: list[int] = []
        firsts: list[int] = []
        lasts: list[int] = []
        stack: list[tuple[int, int]] = []
        for i, lcp in zip(at[order].tolist(), values.tolist(), strict=True):
            begin = i - 1
            while stack and stack[-1][0] > lcp:
                length, begin = stack.pop()
                lengths.append(length)
                firsts.append(begin)
                lasts.append(i - 1)
            if lcp and (not stack or stack[-1][0] < lcp):
                stack.append((lcp, begin))
        return np.array(lengths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)

    def maximal_repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last) of every maximal repeat: its occurrences are preceded by different bytes and followed by different ones.

        Occurrences are the suffixes from ``first`` to ``last``, all of them.
        """
        length, first, last = self.intervals(least)
        diverse = self.changes[last] > self.changes[first] if len(length) else np.zeros(0, bool)
        return length[diverse], first[diverse], last[diverse]
