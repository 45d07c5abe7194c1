"""Mixing and toxicity once more in plain Python: slot by slot with fractions, and coordinate by coordinate."""

import math
from collections import defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import mixing, toxicity


@pytest.mark.parametrize("given", [{"a": 0.55, "b": 0.25, "": 0.2}, {"a": 3.0, "b": 1.0, "": 1.0}])
def test_mixing_slot_by_slot(spark, given):
    # source a has a third of all rows and more than half of the bytes; null sources and texts, ties, and a long text
    rows = [(i, "ab"[i % 2] * (i * 7 % 23), "a" if i % 3 == 0 else "b") for i in range(90)]
    rows += [(200 + i, None if i % 2 else "xyz", None) for i in range(20)] + [(300, "long " * 60, "a"), (5, "again", "b"), (5, "again", "b")]
    placed = mixing.place(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), given, block_bytes=40)
    got = sorted((r["source"], r["at"], r["size"], r["doc_id"], r["block"], r["release"], r["due"], r["slot"]) for r in placed.collect())
    hashes = {t: h for t, h in spark.createDataFrame(rows, "i long, t string, s string").select("t", F.xxhash64(F.coalesce("t", F.lit("")))).distinct().collect()}
    of, size = defaultdict(list), defaultdict(int)
    for i, t, s in sorted(rows, key=lambda r: (r[0], hashes[r[1]])):
        n = len(t or "") + 1
        of[s or ""].append((size[s or ""], n, i))
        size[s or ""] += n
    share = {s: Fraction(w) / sum(Fraction(x) for x in given.values()) for s, w in given.items()}
    last = {s: (n - 1) // 40 for s, n in size.items()}
    turn, done, t = {}, dict.fromkeys(given, 0), 0
    while any(done[s] <= last[s] for s in given):
        due = {s: math.ceil((done[s] + 1) / share[s]) for s in given if done[s] <= last[s] and math.floor(done[s] / share[s]) <= t}
        if due:
            s = min(due, key=lambda s: (due[s], s))
            turn[s, done[s]] = (math.floor(done[s] / share[s]), due[s], t)
            assert t < due[s]
            done[s] += 1
        t += 1
    assert got == sorted((s, at, n, i, at // 40, *turn[s, at // 40]) for s, held in of.items() for at, n, i in held)


def plain_features(text: str) -> set[int]:
    m = 2**64 - 1
    place = lambda key: (((key ^ (key >> 29)) * int(toxicity.M2)) & m) >> (64 - toxicity.BITS)
    words = [w.strip(toxicity.PUNCTUATION) for w in text.lower().split()]
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    out = {place(x * int(toxicity.M1) & m) for x in h}
    out |= {place(xxhash.xxh3_64_intdigest(w[:k], k) * int(toxicity.M1) & m) for w in words for k in toxicity.STEMS}
    return out | {place((a * int(toxicity.M1) + b * int(salt)) & m) for gap, salt in toxicity.GAPS for a, b in zip(h, h[gap:], strict=False)}


def test_toxicity_coordinate_by_coordinate(spark):
    texts = [f"{'Vile, rotten' if i % 3 == 0 else 'kind calm'} word{i % 7} and thing{i * i % 11} {'!' * (i % 2)} end" for i in range(48)] + ["", None]
    labels = [(i, int(i % 3 == 0)) for i in range(50)] + [(4, 1), (9, 0), (None, 1), (12, None), (99, 1)]  # 4 and 9 contradict themselves: the larger counts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    at, weights, intercept = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), alpha=0.5, l1=0.5, l2=0.1)
    turn = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(1))).collect()}
    known = {i: max(y for j, y in labels if j == i and y is not None) for i in range(50)}
    z, n = defaultdict(float), defaultdict(float)

    def weight(c):
        if abs(z[c]) <= (0.5 if c != "b" else 0.0):
            return 0.0
        return -(z[c] - math.copysign(0.5 if c != "b" else 0.0, z[c])) / ((1.0 + math.sqrt(n[c])) / 0.5 + 0.1)

    for _ in range(4):
        for i in sorted(known, key=turn.get):
            some = [*plain_features(texts[i] or ""), "b"]
            w = {c: weight(c) for c in some}
            g = 1 / (1 + math.exp(-sum(w.values()))) - known[i]
            for c in some:
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / 0.5 * w[c]
                n[c] += g * g
    want = {c: weight(c) for c in z if c != "b" and weight(c)}
    assert dict(zip(at.tolist(), weights.tolist(), strict=True)) == pytest.approx(want, rel=1e-9) and intercept == pytest.approx(weight("b"), rel=1e-9) and want
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (at, weights, intercept)).collect()}
    for i, text in enumerate(texts):
        total = sum(want.get(c, 0.0) for c in plain_features(text or "")) + weight("b")
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
    assert got[4] != got[49] == got[48]
