"""Lifecycles that the orders tables give without joins against those joined from the log's tables, and what is shuffled for them."""

import datetime
import re

import pytest

from tracewright.catalog import QUERIES
from tracewright.model import lifecycle
from tracewright.operators import features, graphs
from tracewright.sources.adapters import orders

DIR = "/root/testdata/sf0.001"


def at(day, hour=0):
    return datetime.datetime(1996, 1, 1) + datetime.timedelta(days=day, hours=hour)


#: Two lines of one order on a day and twice the same line, orders without lines, a line without its order, a customer
#: that isn't listed, missing keys and dates, a shipment before its order was placed.
ORDERS = [(1, 7, 100.0, at(0), "HIGH"), (2, 7, 50.0, at(1), "LOW"), (3, 8, 0.0, at(1, 5), "LOW"), (4, 99, 20.0, at(2), "HIGH"), (5, 8, 5.0, None, "LOW"), (6, None, 7.0, at(3), "HIGH")]
LINES = [(1, 11, 21, at(3)), (1, 12, 21, at(3)), (1, 11, 21, at(3)), (1, 11, 22, at(4)), (2, 11, 21, at(0)), (3, 12, None, at(2)), (3, None, 22, at(2)), (4, 13, 23, None), (5, 13, 22, at(5)), (77, 12, 22, at(1)), (77, 14, 24, at(1)), (None, 11, 21, at(1))]


@pytest.fixture
def odd(spark, tmp_path):
    def write(lines=LINES):
        spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
        spark.createDataFrame([(k, n, *r) for n, (k, *r) in enumerate(lines)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.createDataFrame([(7, "A"), (8, "B"), (9, "A")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
        return orders(spark, str(tmp_path))

    return write


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def same(log, joined):
    kinds = [None, "order", "customer", "part", "supplier", "other"]
    for kind in kinds:
        got = rows(lifecycle(log, object_type=kind))
        assert got == rows(lifecycle(joined, object_type=kind)) and (bool(got) or kind == "other")
    for kind in kinds[1:-1]:
        assert rows(features.object_features(log, kind)) == rows(features.object_features(joined, kind))
    assert rows(graphs.oc_dfg(log).edges) == rows(graphs.oc_dfg(joined).edges) and rows(graphs.oc_dfg(log).nodes) == rows(graphs.oc_dfg(joined).nodes)


def test_odd_orders_are_the_same_without_joins(odd):
    log = odd()
    assert log.lives is not None
    same(log, log.but(lives=None, met=None))


@pytest.mark.parametrize("when", [at(3, 9), datetime.datetime(1969, 12, 31)])
def test_dates_that_a_number_cannot_tell_are_joined(odd, when):
    """Two shipments of one day at two times, and a day before 1970."""
    log = odd([*LINES, (1, 15, 25, when)])
    assert log.lives is None
    assert sum(r["event_type"] == "Ship" and r["time_ms"] == int(when.replace(tzinfo=datetime.UTC).timestamp() * 1000) for r in lifecycle(log, object_type="order").collect()) > 0


def test_filtered_orders_are_joined(spark):
    log = orders(spark, DIR)
    some = log.but(events=log.events.filter("event_type = 'Ship'"))
    assert log.lives is not None and some.lives is None and some.met is None
    assert lifecycle(some, object_type="order").filter("event_type <> 'Ship'").isEmpty() and not lifecycle(some, object_type="order").isEmpty()


@pytest.mark.parametrize("name,most", [("lifecycle_order", 2), ("oc_dfg_orders", 6), ("feature_table", 13)])
def test_exchanges(spark, name, most):
    """Of tables as they are read, not of what is joined; nothing is written."""
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (hash|range|Round|Single)", plan)) <= most and "tracewright-tables" not in plan
