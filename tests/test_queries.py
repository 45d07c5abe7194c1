"""Each query against its SQL twin, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

from tracewright.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "events", "lineitem", "orders"]


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    sql = con.sql(ORACLES[name])
    df = QUERIES[name](spark, DIR)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_weights_of_a_graph_are_lifecycle_lengths(spark):
    from tracewright.model import lifecycle
    from tracewright.operators.graphs import oc_dfg
    from tracewright.sources.adapters import clickstream

    log = clickstream(spark, DIR)
    n = lifecycle(log).count() + log.objects.count()
    assert oc_dfg(log).edges.agg({"weight": "sum"}).first()[0] == n


def test_map_learns_from_all_windows(spark, monkeypatch):
    from tracewright.operators import detection
    from tracewright.sources.adapters import clickstream

    train, seen = detection.train_map, []
    monkeypatch.setattr(detection, "train_map", lambda points, *how: seen.append(len(points)) or train(points, *how))
    found = detection.detect(clickstream(spark, "/root/testdata/sf0.1"), "user", width=3, height=3, epochs=10)
    assert seen == [found.points.count()] and seen[0] > 20_000


def test_training_goes_point_by_point(monkeypatch):
    import numpy as np

    from tracewright.operators import detection

    monkeypatch.setattr(detection, "PIECE", 7)
    points = np.random.default_rng(1).normal(size=(50, 2))
    lo, hi = points.min(axis=0), points.max(axis=0)
    y, x = np.divmod(np.arange(12), 4)
    w = np.stack([lo[0] + (hi[0] - lo[0]) * (x / 3), lo[1] + (hi[1] - lo[1]) * (y / 2)], axis=1)
    for epoch in range(10):
        done = epoch / 9
        rate, radius = 0.5 * (1 - done) + 0.05 * done, 2 * (1 - done) + 0.75 * done
        for p in points:
            best = ((w - p) ** 2).sum(axis=1).argmin()
            w += (rate * np.exp(-((x - x[best]) ** 2 + (y - y[best]) ** 2) / (2 * radius**2)))[:, None] * (p - w)
    assert np.allclose(detection.train_map(points, 4, 3, 10), w, rtol=1e-12)
