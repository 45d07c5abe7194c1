"""Fill-in-middle and hard negatives against brute force, on rows with every odd case."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import fim, hardneg, ngram

TEXTS = [
    (0, None), (1, ""), (2, "one"), (3, "two words, three\nlines\x00and é ü \U0001f600 more"), (4, "holds <S> itself"), (5, "<P"), (None, "no id here at all"),
    (6, "x" * 50_000 + " y " * 20_000), (7, "same row"), (7, "same row"), (7, "another of this id"), *[(i, f"text number {i} of some, and more <S <M P> words {i * i}") for i in range(10, 120)],
]


def cut(i, text, seed=1, plain=10, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("how", [(1, 10, 20), (5, 0, 50), (2, 100, 0)])
def test_fill_in_middle(spark, how):
    clash = "doc_id long, text string, n string, i string, u string, row string, output string"
    docs = spark.createDataFrame([(i, t, "n", "i", "u", "row", "output") for i, t in TEXTS], clash).repartition(3)
    rows = fim.fill_in_middle(docs, *how).withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    assert all(r["again"] == (r["row"]["text"] or "") and r["row"]["n"] == "n" and r["row"]["output"] == "output" for r in rows)
    got = [(r["row"]["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows]
    assert sorted(got, key=repr) == sorted((cut(i, t, *how) for i, t in TEXTS), key=repr)


def test_fill_in_middle_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).count() == 0


def mined(rows, k=5, n=5, window=(80, 100)):
    sound = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (i, lab, v) in enumerate(sound):
        if i % 100:
            continue
        others = sorted(((-dot(v, w), j, b) for b, (j, m, w) in enumerate(sound) if b != a and m == lab))
        unlike = sorted(((-dot(v, w), j) for j, m, w in sound if m != lab))
        for p, j, _ in others[:k]:
            fit = [x for x in unlike if window[0] * -p <= 100 * -x[0] <= window[1] * -p][:n]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(size=8) / 3]) for i in range(600)]
    rows += [(600 + i, i % 3, [0.5] * 8) for i in range(120)]  # one vector in many rows: ties at every rank
    rows += [(800, 1, None), (900, None, [0.1] * 8), (801, 1, [0.1, None] * 4), (802, 1, [float("nan")] * 8), (803, 2, [float("inf")] * 8), (None, 1, [0.2] * 8)]
    rows += [(1000, 9, [0.3] * 8), (1100, 1, []), (1200, 2, [0.4, 0.4]), (1300, 1, [0.5] * 8), (1300, 1, [0.5] * 8), (1300, 2, [0.5] * 8), (-100, 0, [-0.4] * 8), (-200, 0, [0.0] * 8)]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], "vec_id long, label int, embedding array<float>, row string, tree string, score double").repartition(3)
    found = hardneg.hard_negatives(df, F.col("vec_id") % 100 == 0, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("how", [{}, {"positives": 2, "negatives": 9, "window": (10, 95)}])
def test_hard_negatives(spark, how, monkeypatch):
    monkeypatch.setattr(hardneg, "LEAF", 4)
    rows = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in vectors()]
    want = mined(rows, how.get("positives", 5), how.get("negatives", 5), how.get("window", (80, 100)))
    assert len(want) > 50 and run(spark, rows, **how) == want


def test_hard_negatives_of_nothing(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [0.5])]) == [] and run(spark, [(100, 1, [0.5])]) == []


def test_ball_tree_takes_the_best_and_prunes():
    rng = np.random.default_rng(5)
    points = np.floor(rng.normal(size=(3_000, 5)) * 100)
    tree = hardneg.BallTree(points)
    assert sorted(tree.order) == list(range(3_000)) and max(np.diff(tree.ends)) <= hardneg.LEAF
    for (centres, radii), step in zip(reversed(tree.levels), [2**i for i in range(len(tree.levels))], strict=True):
        ends = tree.ends[::step]
        for c, r, a, b in zip(centres, radii, ends[:-1], ends[1:], strict=True):
            assert np.sqrt(((tree.points[a:b] - c) ** 2).sum(axis=1)).max(initial=0) <= r + 1e-9
    q, ids, seen = points[:20], np.arange(3_000)[tree.order], []
    low, high = np.full(20, 20_000.0), np.full(20, 60_000.0)
    scores, places = tree.best(q, low, high, 4, ids, lambda x, y: seen.append(len(x) * (y.stop - y.start)) or np.ones((len(x), y.stop - y.start), bool))
    assert sum(seen) < 0.8 * 20 * 3_000
    for i in range(20):
        s = points @ q[i]
        fit = sorted((-x, j) for j, x in enumerate(s) if 20_000 <= x <= 60_000)[:4]
        assert [(-x, y) for x, y in zip(scores[i], ids[places[i]], strict=True) if np.isfinite(x)] == fit


def test_scores_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"a b c {i % 3}", "x", 1.5, i) for i in range(30)], "doc_id long, text string, _text string, `a.b` double, _text_ int")
    rows = ngram.score(docs, ngram.train(docs)).collect()
    assert len(rows) == 30 and {r["_text"] for r in rows} == {"x"} and {r["a.b"] for r in rows} == {1.5} and all(r["n_tokens"] == 5 and r["score"] < 0 for r in rows)


def test_all_operators_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [n.split("_")[0] for n in found if re.match(r"op\d+_", n)] == [f"op{i}" for i in range(1, 14)] and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)
