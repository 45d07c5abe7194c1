"""Removal of repeated byte strings against brute force: every window of every text in a dictionary."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import suffixes


def brute(rows, length):
    """rows: (id, text, hash) to (id, n_bytes, n_removed, n_spans, kept) of each."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    seen, out = set(), []
    for i, text, _ in rows:
        data = (text or "").encode()
        gone, spans = bytearray(len(data)), 0
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for p, x in enumerate(gone) if x and not (p and gone[p - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, x in zip(data, gone, strict=True) if not x)))
    return sorted(out, key=repr)


def rows_of(kind, rng):
    base = ["".join(rng.choice("abcdefgh \n") for _ in range(300)) for _ in range(4)]
    if kind == "passages":  # in front of, behind and between unlike texts
        tail = lambda: "".join(rng.choice("ijklmnop") for _ in range(rng.randrange(0, 25)))
        return [(i, tail() + rng.choice(base)[rng.randrange(60) : rng.randrange(100, 300)] + tail() + rng.choice(base)[:90]) for i in range(80)]
    if kind == "runs":  # one byte, or a few, over and over
        return [(i, rng.choice(["a", "ab", "abc", "é", "\U0001f600x"]) * rng.randrange(1, 200) + rng.choice(["", "b", "tail"])) for i in range(40)]
    if kind == "crowd":  # a phrase shorter than a window among unlike texts: one gram, many stretches
        return [(i, f"{i * 7919:06d}" + "the very common phrase " + f"{i % 9:03d}{i * 31 % 1000:04d}") for i in range(300)]
    odd = [(0, None), (1, ""), (2, "short"), (None, base[0]), (None, base[0]), (None, base[1] + base[0]), (3, base[1]), (3, base[1]), (3, base[2]), (3, "short"), (3, "short"),
           (-5, base[2][:150]), (2**62, base[0] + base[2] + base[1]), (-(2**63), base[3]), (4, base[3] * 3)]
    return odd


@pytest.mark.parametrize("kind", ["passages", "runs", "crowd", "odd"])
@pytest.mark.parametrize("length", [8, 21, 100])
def test_same_as_brute_force(spark, kind, length, monkeypatch):
    for name, n in (("CROWD", 20), ("BLOCK", 137), ("HELD", 3_000), ("ORDERED", 2_000)):
        monkeypatch.setattr(suffixes, name, n)
    rows = rows_of(kind, random.Random(f"{kind}{length}"))
    docs = spark.createDataFrame([(i, t, "d", "q", "k", 1) for i, t in rows], "doc_id long, text string, d string, q string, k string, n_bytes int").repartition(5)
    hashed = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    found = suffixes.remove_repeats(docs, length)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in found.collect()), key=repr)
    assert got == brute(hashed, length)


def test_no_rows(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 100).count() == 0


def test_passes_leave_exactly_the_repeated_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5_000).astype(np.uint8)
    starts, groups = np.arange(4_990), rng.integers(0, 2, 4_990)
    left, classes = suffixes.repeated_windows(data, starts, groups.copy(), 10)
    by_window = {}
    for s, g in zip(starts, groups, strict=True):
        by_window.setdefault((g, data[s : s + 10].tobytes()), []).append(s)
    want = sorted(sorted(x) for x in by_window.values() if len(x) > 1)
    got = {}
    for s, k in zip(left, classes, strict=True):
        got.setdefault(k, []).append(s)
    assert want and sorted(sorted(x) for x in got.values()) == want
