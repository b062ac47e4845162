"""The run-length index against brute force."""

import random
from collections import Counter

import numpy as np

from quadrille.llm.runlength import RunLengthIndex, suffix_array


def cases():
    rng = random.Random(8)
    noise = lambda n, letters=b"ab": bytes(rng.choice(letters) for _ in range(n))
    base = noise(300, b"abcd\x00")
    yield []
    yield [b""]
    yield [b"", b"a", b""]
    yield [b"a" * 200, b"a" * 3]
    yield [noise(rng.randint(0, 40)) for _ in range(30)]
    yield [base, base, base[:100] + b"x" + base[101:], noise(50) + base[20:80], b"\x00" * 30, b"q\x00\x00"]


def test_suffix_array():
    for parts in cases():
        raw = b"".join(p + b"\xff" for p in parts)
        if raw:
            order = sorted(range(len(raw)), key=lambda i: raw[i:])
            assert suffix_array(np.frombuffer(raw, np.uint8)).tolist() == order


def test_runs_and_statistics():
    for parts in cases():
        raw = b"".join(p + b"\xff" for p in parts)
        index = RunLengthIndex(parts)
        assert index.length.sum() == len(raw) and (index.byte[1:] != index.byte[:-1]).all()
        if not raw:
            continue
        got = index.matching_statistics()
        for i in range(len(raw)):
            n = int(got[i])
            assert n == 0 or raw.find(raw[i : i + n]) != i or raw.find(raw[i : i + n], i + 1) >= 0
            longer = raw[i : i + n + 1]
            assert len(longer) <= n or (raw.find(longer) == i and raw.find(longer, i + 1) < 0)


def test_repeats():
    for parts in cases():
        for span in (3, 20, 60):
            count = Counter(p[i : i + span] for p in parts for i in range(len(p) - span + 1))
            want = {(k, i) for k, p in enumerate(parts) for i in range(len(p) - span + 1) if count[p[i : i + span]] > 1}
            assert {(k, i) for k, a, z in zip(*RunLengthIndex(parts).repeats(span)) for i in range(a, z + 1)} == want
