"""Hashes of word shingles of whole texts, with numpy over chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19
_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_WORD = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: dict[str, np.ndarray] = {"n": np.zeros(0, np.uint64), "i": np.zeros(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, mod 2^64."""
    if len(_powers["n"]) < n:
        size = 1 << max(20, n - 1).bit_length() if n > 1 << 20 else 1 << 20
        for k, b in (("n", _BASE), ("i", _INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["n"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _WORD[0]
    x = (x ^ (x >> _U(27))) * _WORD[1]
    return x ^ (x >> _U(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word."""
    b = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    p, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * p[: len(b)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def sets(texts, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one for all words of a shorter text, none without words."""
    texts = list(texts)
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < CHUNK):
            part.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            size += len(part[-1]) + 1
            at += 1
        start, h = _word_hashes(b"\n".join(part)) if size > len(part) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        cuts = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in part]))
        whole = np.zeros(0, np.uint64)
        if len(h) >= width:
            whole = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                whole += h[k : len(h) - width + 1 + k] * _WORD[k % 5] * _U(2 * k + 1)
            whole = mix(whole)
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                short = _U(b - a)
                for k in range(b - a):
                    short = short + h[a + k : a + k + 1] * _WORD[k % 5] * _U(2 * k + 1)
                yield mix(mix(short))
            else:
                yield np.zeros(0, np.uint64)


class MinHash:
    """rows * bands universal hashes a*x + b mod 2^32 of the upper halves of shingle hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]

    def signature(self, s: np.ndarray) -> np.ndarray:
        x = (s >> _U(32)).astype(np.uint32)
        out = None
        for i in range(0, len(x), 2048):
            v = self.a * x[None, i : i + 2048]
            v += self.b
            m = v.min(axis=1)
            out = m if out is None else np.minimum(out, m)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band, which the band's number goes into."""
        m = signature.reshape(self.bands, self.rows).astype(np.uint64)
        h = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            h = mix(h * _WORD[3] + m[:, k] + _WORD[2])
        return h.view(np.int64)
