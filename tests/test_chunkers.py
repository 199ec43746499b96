"""Chunkers: bounds, round trip, determinism, locality after an edit, and what each one's rule says, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from cairnlake.operators import chunkers as C

CONTENT_DEFINED = ["normalized", "gear", "rolling", "keyed", "local_maximum"]


def some(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, n, np.uint8).tobytes()


def pieces(cutter, data):
    ends = cutter(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize("name", sorted(C.REGISTRY))
def test_round_trip_and_bounds(name):
    rng = random.Random(3)
    for n in (0, 1, 2, 63, 64, 65, 255, 256, 257, 1024, 1025, 5000, 40_000):
        for data in (some(n, n), b"\0" * n, bytes(rng.choice(b"ab") for _ in range(n))):
            got = pieces(C.REGISTRY[name], data)
            assert b"".join(got) == data and all(got) and got == pieces(C.REGISTRY[name], data)
            most = 256 if name == "fixed" else 1024
            assert all(len(p) <= most for p in got)
            if name in ("normalized", "gear", "rolling", "keyed"):
                assert all(len(p) >= 64 for p in got[:-1])


@pytest.mark.parametrize("name", CONTENT_DEFINED)
def test_an_edit_changes_few_chunks(name):
    data = some(200_000)
    edited = data[:90_000] + b"an insertion" + data[90_000:]
    a, b = Counter(pieces(C.REGISTRY[name], data)), Counter(pieces(C.REGISTRY[name], edited))
    assert len(a) > 200 and sum((b - a).values()) <= 8


@pytest.mark.parametrize("name,low,high", [("normalized", 200, 420), ("gear", 250, 420), ("rolling", 250, 420), ("keyed", 250, 420), ("local_maximum", 60, 260)])
def test_mean_size(name, low, high):
    got = pieces(C.REGISTRY[name], some(400_000, 5))
    assert low <= 400_000 / len(got) <= high


def test_normalized_sizes_vary_less():
    spread = lambda name: np.std([len(p) for p in pieces(C.REGISTRY[name], some(400_000, 6))])
    assert spread("normalized") < spread("gear")


def window_hash(data, end, width, table, factor):
    h = 0
    for byte in data[max(0, end - width) : end]:
        h = (h * factor + int(table[byte])) % (1 << 64)
    return h


def test_marks_against_brute_force(monkeypatch):
    monkeypatch.setattr(C, "_BLOCK", 100)
    data, table = some(1000, 8), C._gear_table(1)
    test = lambda h: h >> np.uint64(60) == 0
    want = [end for end in range(1, 1001) if window_hash(data, end, 32, table, 2) >> 60 == 0]
    assert C.marks(data, 32, table, 2, test).tolist() == want


def test_local_maximum_against_brute_force():
    data = some(4000, 9)
    w = 48
    want = [k + 1 for k in range(w, len(data) - w) if data[k] > max(data[k - w : k]) and data[k] >= max(data[k + 1 : k + 1 + w])]
    ends = C.REGISTRY["local_maximum"](data)
    assert [e for e in want if e not in ends] == [] and all(e in want or e - p == 1024 or e == len(data) for p, e in zip([0, *ends], ends))


def test_keys_change_the_cuts():
    data = some(50_000)
    assert C.keyed(b"one", 64, 256, 1024)(data) != C.keyed(b"two", 64, 256, 1024)(data)


def test_presets_grow():
    for least, mean, most in C.PRESETS.values():
        assert mean == 4 * least and most == 4 * mean
    data = some(300_000, 4)
    got = [len(pieces(C.preset(n), data)) for n in ("small", "max_dedup", "project", "default")]
    assert got == sorted(got, reverse=True)


def test_chunked_on_spark(spark):
    df = spark.createDataFrame([(1, some(3000)), (2, None), (3, b""), (4, b"x"), (1, some(3000))], "k long, data binary")
    rows = C.chunked(df, "k", "data", C.REGISTRY["normalized"]).collect()
    assert {r["k"] for r in rows} == {1, 4} and sum(r["size"] for r in rows if r["k"] == 1) == 6000
