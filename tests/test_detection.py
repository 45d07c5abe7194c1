"""State detection against plain Python: components, map, cells, moves, boundaries and votes on a small log."""

import json
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewright.catalog import QUERIES
from tracewright.model import LogError
from tracewright.operators import detection
from tracewright.session import LogSession, as_json
from tracewright.sources import documents

LIVES = {"a": "PQRPQS", "b": "QQRS", "c": "PS", "d": "SRQPPQ", "e": "RRRRPQ"}


def text() -> str:
    """Five carts; the second event of each cart is also the last of the cart before it, and cart f has nothing."""
    kinds = sorted(set("".join(LIVES.values())))
    events, at = [], 0
    for i, (o, kinds_of) in enumerate(LIVES.items()):
        for k in kinds_of:
            events.append({"id": f"{o}{at}", "type": k, "time": f"2024-01-{i + 1:02}T00:00:{at % 60:02}Z", "relationships": [{"objectId": o, "qualifier": ""}]})
            at += 1
    for i, o in enumerate(list(LIVES)[:-1]):  # a shared event at a time after the first cart's and before the second's
        events.append({"id": f"shared-{o}", "type": "P", "time": f"2024-01-{i + 1:02}T12:00:00Z", "relationships": [{"objectId": o, "qualifier": ""}, {"objectId": list(LIVES)[i + 1], "qualifier": ""}]})
    attrs = lambda i: [{"name": "size", "time": "1970-01-01T00:00:00Z", "value": i * 1.5}, {"name": "kind", "time": "2024-01-03T00:00:00Z", "value": "x" if i % 2 else "y"}, {"name": "mixed", "time": "1970-01-01T00:00:00Z", "value": "7" if i else "t"}]
    return json.dumps({
        "objectTypes": [{"name": "Cart", "attributes": [{"name": "size", "type": "float"}, {"name": "kind", "type": "string"}, {"name": "mixed", "type": "string"}]}],
        "eventTypes": [{"name": k, "attributes": []} for k in kinds],
        "objects": [{"id": o, "type": "Cart", "attributes": attrs(i)} for i, o in enumerate([*LIVES, "f"])], "events": events,
    })


@pytest.fixture(scope="module")
def found(spark):
    return detection.detect(documents.read_text(spark, text()), "Cart", size=3, width=3, height=2, epochs=12)


def lives(log: dict) -> dict:
    rows = defaultdict(list)
    for n, e in enumerate(log["events"]):
        for r in e["relationships"]:
            rows[r["objectId"]].append((e["time"], n, e["id"], e["type"]))
    return {o: sorted(r) for o, r in rows.items()}


def windows(log: dict, size: int) -> list:
    """(object, start, its rows) in the order of objects."""
    by = lives(log)
    return [(o["id"], s, by[o["id"]][s : s + size]) for o in log["objects"] if o["id"] in by for s in range(max(1, len(by[o["id"]]) - size + 1))]


@pytest.fixture(scope="module")
def twin(found):
    """Vectors, points, cells and votes, worked out row by row from the columns' names."""
    log = json.loads(text())
    spans = windows(log, 3)
    objects = {o["id"]: o for o in log["objects"]}
    met = {e["id"]: {r["objectId"] for r in e["relationships"]} for e in log["events"]}

    def vector(o, rows):
        out = {}
        for _, _, i, kind in rows:
            out[f"activity.{kind}"] = out.get(f"activity.{kind}", 0) + 1
        others = set().union(*[met[i] for _, _, i, _ in rows]) - {o}
        out["related_objects.Cart"] = len(others)
        for a in objects[o]["attributes"]:
            if a["time"] <= rows[-1][0]:
                out[f"attribute.{a['name']}" if isinstance(a["value"], float) else f"attribute.{a['name']}={a['value']}"] = a["value"] if isinstance(a["value"], float) else 1
        return [float(out.get(c, 0)) for c in found.columns]

    x = np.array([vector(o, rows) for o, _, rows in spans])
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd <= 2.220446049250313e-16, 1, sd)
    cov = z.T @ z / (len(z) - 1)

    def power(m):
        v = (np.arange(len(m)) + 1) / len(m)
        v /= np.linalg.norm(v)
        for _ in range(80):
            v = m @ v
            v /= np.linalg.norm(v)
        return v

    one = power(cov)
    l1 = one @ cov @ one
    two = power(cov - l1 * np.outer(one, one))
    points = np.column_stack([z @ one, z @ two])
    w = detection.train_map(points, 3, 2, 12)
    best = [int(np.argmin(((w - p) ** 2).sum(axis=1))) for p in points]
    return spans, points, [(b % 3, b // 3) for b in best], (l1, two @ cov @ two), w


def test_points_and_cells(found, twin):
    spans, points, cells, variances, weights = twin
    got = {(r["object_id"], r["start"]): r for r in found.points.collect()}
    assert len(got) == len(spans)
    for (o, s, _), p, c in zip(spans, points, cells, strict=True):
        r = got[o, s]
        assert math.isclose(r["pc1"], p[0], abs_tol=1e-7) and math.isclose(r["pc2"], p[1], abs_tol=1e-7) and (r["x"], r["y"]) == c
    assert np.allclose(found.variances, variances) and np.allclose(found.weights, weights)


def moves(twin):
    spans, _, cells, _, _ = twin
    return [(a, b, c, d) for (a, c), (b, d) in zip(zip(spans, cells), list(zip(spans, cells))[1:]) if a[0] == b[0] and c != d]


def test_moves_and_boundaries(found, twin):
    want = Counter((*c, *d) for _, _, c, d in moves(twin))
    assert {tuple(r)[:5][:4]: r["count"] for r in detection.transitions(found).select("source_x", "source_y", "target_x", "target_y", "count").collect()} == want and want
    x, y = next(iter(want))[2:]
    got = {(r["direction"], r["object_id"], r["start"]): list(r["activities"]) for r in detection.boundary_details(found, x, y).collect()}
    kinds = lambda w: [k for *_, k in w[2]]
    entering = {("entering", b[0], b[1]): kinds(b) for _, b, _, d in moves(twin) if d == (x, y)}
    assert got == entering | {("exiting", a[0], a[1]): kinds(a) for a, _, c, _ in moves(twin) if c == (x, y)}
    edges = {(r["source"], r["target"]): r["weight"] for r in detection.boundary_graph(found, x, y, "entering").edges.collect()}
    pairs = Counter((a, b) for k in entering.values() for a, b in zip(k, k[1:], strict=False))
    assert {k: v for k, v in edges.items() if not any("\n" in e for e in k)} == pairs


def test_votes_tie_by_the_last_window_of_all(found, twin):
    spans, _, cells, _, _ = twin
    votes = defaultdict(Counter)
    last = {}
    for n, ((_, _, rows), c) in enumerate(zip(spans, cells, strict=True)):
        for _, _, i, _ in rows:
            votes[i][c] += 1
            last[i, c] = n
    want = {i: max(v, key=lambda c: (v[c], last[i, c])) for i, v in votes.items()}  # noqa: B023
    assert {r["event_id"]: r["value"] for r in detection.event_labels(found).collect()} == {i: f"S{c[0] + 1}-{c[1] + 1}" for i, c in want.items()}


def test_colours(found, twin):
    spans, _, cells, _, _ = twin
    options = {r["id"]: r["kind"] for r in detection.colour_options(found.log, "Cart").collect()}
    assert options == {"__window_count": "count", "attribute::size": "numeric", "attribute::kind": "categorical", "attribute::mixed": "categorical"}
    counts = Counter(cells)
    plain = {(r["x"], r["y"]): r for r in detection.cells(found).collect()}
    assert len(plain) == 6 and all(r["count"] == counts[c] and r["color_label"] == f"{counts[c]} windows" and math.isclose(r["color_value"], counts[c] / max(counts.values()), abs_tol=1e-6) for c, r in plain.items())
    sizes = {o: i * 1.5 for i, o in enumerate(LIVES)}
    mean = {c: np.mean([sizes[o] for (o, _, _), d in zip(spans, cells, strict=True) if d == c]) for c in counts}
    lo, hi = min(mean.values()), max(mean.values())
    for r in detection.cells(found, "attribute::size").collect():
        want = (mean[r["x"], r["y"]] - lo) / (hi - lo) if (r["x"], r["y"]) in mean else 0.0
        assert math.isclose(r["color_value"], want, abs_tol=1e-6) and r["color_kind"] == "numeric"
    kinds = {c: Counter("yx"[list(LIVES).index(o) % 2] for (o, _, rows), d in zip(spans, cells, strict=True) if d == c and rows[-1][0] >= "2024-01-03") for c in counts}
    most = max(max(k.values(), default=0) for k in kinds.values())
    for r in detection.cells(found, "attribute::kind").collect():
        k = kinds.get((r["x"], r["y"]), Counter())
        want = min(k, key=lambda v: (-k[v], v)) if k else None  # noqa: B023
        assert r["color_label"] == (f"kind: {want} ({k[want]})" if want else "kind: n/a") and math.isclose(r["color_value"], k[want] / most if want else 0, abs_tol=1e-6)


def test_results_as_json(spark, found):
    session = LogSession(found.log)
    result = json.loads(as_json(session.state_detection_result(found)))
    assert result["window_count"] == len(windows(json.loads(text()), 3)) and len(result["cells"]) == 6 and result["feature_count"] == len(found.columns)
    assert [w["object_id"] for w in result["windows"]][:1] == ["a"] or result["windows"]
    detail = json.loads(as_json(session.state_detection_cell(found, 0, 0)))
    assert len(detail["cell"]) == 1 and set(detail["graph"]) == {"nodes", "edges"}
    session.apply_filter('{"event_types": ["P", "Q"], "time_range": {"start_ms": 0}}')
    assert session.filter.event_types == ["P", "Q"] and session.summary().first()["events"] == sum(e["type"] in "PQ" for e in json.loads(text())["events"])


def test_batch_training(spark):
    """The batch map against plain Python; copies of points, and points in other partitions, change nothing."""
    points = np.random.default_rng(3).normal(size=(60, 2)).round(2)
    w = np.array([(a, b) for b in np.linspace(points[:, 1].min(), points[:, 1].max(), 2) for a in np.linspace(points[:, 0].min(), points[:, 0].max(), 4)])
    for epoch in range(10):
        done = epoch / 9
        radius = 2 * (1 - done) + 0.75 * done
        cells = [min(range(8), key=lambda i: (((p - w[i]) ** 2).sum(), i)) for p in points]  # noqa: B023
        pull = np.array([[math.exp(-((i % 4 - c % 4) ** 2 + (i // 4 - c // 4) ** 2) / (2 * radius**2)) for c in cells] for i in range(8)])
        w = pull @ points / pull.sum(axis=1, keepdims=True)
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "pc1 double, pc2 double")
    assert np.allclose(detection.train_batch(df, 4, 2, 10), w, rtol=1e-9)
    assert np.allclose(detection.train_batch(df.union(df).repartition(7), 4, 2, 10), w, rtol=1e-9)
    one = df.limit(1)
    assert np.allclose(detection.train_batch(one, 2, 2, 10), [list(one.first())] * 4)
    assert (detection.train_batch(df.limit(0), 2, 2, 10) == 0).all()


def test_batch_detection(spark, found):
    batch = detection.detect(found.log, "Cart", size=3, width=3, height=2, epochs=12, training="batch")
    assert detection.cells(batch).agg({"count": "sum"}).first()[0] == found.points.count() and batch.variances == pytest.approx(found.variances)
    with pytest.raises(LogError, match="training"):
        detection.detect(found.log, "Cart", training="other")


def mapped(tmp_path, points):
    points.tofile(tmp_path / "points")
    return np.memmap(tmp_path / "points", np.float64, "r").reshape(-1, 2)


@pytest.mark.parametrize("width,height", [(3, 3), (4, 2), (12, 12)])
def test_compiled_training_gives_the_same_weights(spark, tmp_path, monkeypatch, width, height):
    """Points with ties and copies, in more than one read of a megabyte."""
    points = np.random.default_rng(5).normal(size=(70_000, 2)).round(1)
    want = detection.train_map(points, width, height, 2)
    monkeypatch.setattr(detection, "_epoch", None)
    assert (detection.train_map(mapped(tmp_path, points), width, height, 2) == want).all()


def test_compiled_training_takes_a_tenth_of_the_time(spark, tmp_path):
    points = np.random.default_rng(6).normal(size=(20_000, 2))
    took = []
    for p, epochs in ((points, 12), (mapped(tmp_path, points), 120)):
        began = time.perf_counter()
        detection.train_map(p, 3, 3, epochs)
        took.append(time.perf_counter() - began)
    assert took[1] < took[0]


@pytest.mark.parametrize("name", ["apply_detection", "cell_boundary_windows", "som_cells", "som_transitions"])
def test_queries_train_by_the_compiled_loop(spark, monkeypatch, name):
    run = lambda: sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=repr)
    with monkeypatch.context() as m:
        m.setattr(detection, "_epoch", None)
        got = run()
    monkeypatch.setattr(detection, "SparkContext", type("None", (), {"_active_spark_context": None}))
    assert got == run() and got
