"""Run-length index of a repetitive text, of the size that one task holds.

The text is a list of parts, each ended by the byte 0xFF, which UTF-8 never has.  Its suffixes are
sorted by prefix doubling, the Burrows-Wheeler transform is cut into runs of equal bytes, and only
the runs stay: their byte, length, and the text places (samples) of their first and last row with
the length that each shares with the row beyond the run's end.

Matching statistics stream out of these samples alone.  A place whose row and the row above it
follow the same byte shares one byte less with that row than the place before it shares with its
own; so along the text the length falls by one a step, and only samples of run starts renew it.
The same holds for the row below and samples of run ends.  The larger of both is the length of the
longest string that starts at a place and at another one as well.
"""

from __future__ import annotations

import numpy as np

from .shingles import _BYTE, powers

END = 0xFF


def suffix_array(b: np.ndarray) -> np.ndarray:
    """Order of the suffixes of bytes that end with END.  Doubling sorts only rows that are still tied."""
    n = len(b)
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    slots, sub, depth = np.arange(n), sa, 8
    rank = np.zeros(n + 1, np.int64)  # beyond the end: 0
    while True:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = slots[new][np.cumsum(new) - 1]
        rank[sub] = head + 1
        tied = ~(new & np.concatenate((new[1:], [True])))
        if not tied.any():
            return sa
        slots, sub = slots[tied], sub[tied]
        key = rank[sub] << 32 | rank[np.minimum(sub + depth, n)]
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[slots] = sub
        depth *= 2


class RunLengthIndex:
    """byte, length: of each run; first, last: text places of its end rows; above, below: what they share with the rows beyond."""

    def __init__(self, parts: list[bytes]):
        b = np.frombuffer(b"".join(x + b"\xff" for x in parts), np.uint8)
        n = self.n = len(b)
        self.ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        if not n:
            self.byte = self.length = self.first = self.last = self.above = self.below = np.zeros(0, np.int64)
            return
        sa = suffix_array(b)
        bwt = b[sa - 1].astype(np.int16)
        bwt[sa == 0] = 256  # what precedes the text is like nothing else
        start = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        stop = np.concatenate((start[1:], [n])) - 1
        self.byte, self.length, self.first, self.last = bwt[start], stop - start + 1, sa[start], sa[stop]
        between = self._shared(b, self.first[1:], self.last[:-1])
        self.above, self.below = np.concatenate(([0], between)), np.concatenate((between, [0]))

    @staticmethod
    def _shared(b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at x and y, by halving on prefix sums of hashes."""
        n = len(b)
        p, inverse = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * p[:n], out=total[1:])
        low, high = np.zeros(len(x), np.int64), n - np.maximum(x, y)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = (total[x + mid] - total[x]) * inverse[x] == (total[y + mid] - total[y]) * inverse[y]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _stream(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        sample, value = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        sample[at], value[at] = at, length
        sample = np.maximum.accumulate(sample)
        return value[sample] - (np.arange(self.n) - sample)

    def matching_statistics(self) -> np.ndarray:
        """For each place of the text, the longest string from there that another place has as well."""
        return np.maximum(self._stream(self.first, self.above), self._stream(self.last, self.below))

    def repeats(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, first, last): maximal ranges of starts, within the part, of strings of span bytes that occur again."""
        if not self.n:
            return (np.zeros(0, np.int64),) * 3
        room = np.concatenate([np.arange(e - s, -1, -1) for s, e in zip(np.concatenate(([0], self.ends[:-1] + 1)), self.ends)])
        good = (self.matching_statistics() >= span) & (room >= span)
        edge = np.diff(good.astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        part = np.searchsorted(self.ends, first)
        base = np.concatenate(([0], self.ends[:-1] + 1))[part]
        return part, first - base, last - base
