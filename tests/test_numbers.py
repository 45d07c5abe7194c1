"""Numbers as text, letters of the state language, lookups of the next state."""

import json
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.text import ascii_lower, plain_number
from tracewright.plans import stateql
from tracewright.sources import documents


def test_plain_decimals(spark):
    rng = np.random.default_rng(3)
    odd = [struct.unpack("d", rng.bytes(8))[0] for _ in range(500)]
    values = [0.0, -0.0, 1.0, -2.0, 12345678.5, 0.0001, 2e15, 1e22, -1.5e-10, 0.00123, 1e7, 5e-324, *[x for x in odd if abs(x) < float("inf")]]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in values], "x double").select(plain_number(F.col("x"))).collect()]
    for x, text in zip(values, got, strict=True):
        assert float(text) == x and "e" not in text.lower(), x
    assert got[:12] == ["0", "-0", "1", "-2", "12345678.5", "0.0001", "2000000000000000", "1" + "0" * 22, "-0.00000000015", "0.00123", "10000000", format(Decimal("4.9E-324"), "f")]
    odd = [float("nan"), float("inf"), -float("inf"), 1e30, -1e30, 3.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "x double").select(stateql._number_text(F.col("x"))).collect()]
    assert got == ["NaN", "inf", "-inf", "9223372036854775807", "-9223372036854775808", "3"]


def test_only_ascii_letters_are_lowered(spark):
    assert spark.createDataFrame([("ÄbC É",)], "t string").select(ascii_lower("t")).first()[0] == "Äbc É"


def shop(amounts):
    times = [f"2024-01-0{i + 1}T00:00:00Z" for i in range(len(amounts))]
    attr = [{"name": "amount", "type": "float"}, {"name": "who", "type": "string"}]
    return {
        "objectTypes": [{"name": "Bill", "attributes": []}], "eventTypes": [{"name": "Pay", "attributes": attr}], "objects": [{"id": "b", "type": "Bill"}],
        "events": [{"id": f"e{i}", "type": "Pay", "time": t, "attributes": [{"name": "amount", "value": a}, {"name": "who", "value": w}], "relationships": [{"objectId": "b", "qualifier": ""}]} for i, (t, (a, w)) in enumerate(zip(times, amounts, strict=True))],
    }


def states(spark, log, text):
    query = "STATE s FOR LEADING OBJECT TYPE Bill AS " + text
    return {r["event_id"]: r["value"] for r in stateql.assignments(log, stateql.parse(query)).collect()}


def test_states_of_numbers_and_letters(spark):
    log = documents.read_text(spark, json.dumps(shop([(12345678.5, "É"), (0.0001, "é"), (2e15, "inf"), (7.25, "NaN")])))
    assert states(spark, log, "CASE WHEN event.id IS NOT NULL THEN event.amount END") == {"e0": "12345678.5", "e1": "0.0001", "e2": "2000000000000000", "e3": "7.25"}
    assert states(spark, log, "CASE WHEN event.who LIKE 'É' THEN 'upper' ELSE 'other' END") == {"e0": "upper", "e1": "other", "e2": "other", "e3": "other"}
    assert states(spark, log, "CASE WHEN event.who > 1 THEN 'more' WHEN event.who = 'nan' THEN 'same' ELSE 'other' END")["e2"] == "more"
    assert states(spark, log, "CASE WHEN event.who = 'nan' THEN 'same' ELSE 'other' END")["e3"] == "other"


@pytest.mark.parametrize("roundtrip", [False, True])
def test_next_states_by_brute_force(spark, roundtrip):
    from tracewright.operators import episodes
    from tracewright.sources.adapters import clickstream
    from tracewright.model import stateful_lifecycle

    log = stateql.apply_state_query(clickstream(spark, "/root/testdata/sf0.001"), "STATE state FOR LEADING OBJECT TYPE user AS CASE WHEN event.type = 'purchase' THEN 'B' WHEN event.type = 'view' THEN 'A' ELSE 'C' END")
    got = sorted(tuple(r) for r in episodes.performance_samples(log, "user", "A", "B", roundtrip).select("object_id", "start_time_ms", "middle_time_ms", "duration_ms").collect())
    by = {}
    for r in stateful_lifecycle(log, "user").orderBy("object_id", "pos").collect():
        by.setdefault(r["object_id"], []).append((r["state"], r["time_ms"]))
    want = []
    for o, rows in by.items():
        for i, (s, t) in enumerate(rows):
            mid = next((j for j in range(i + 1, len(rows)) if rows[j][0] == "B"), None) if s == "A" else None
            end = mid if mid is None or not roundtrip else next((j for j in range(mid + 1, len(rows)) if rows[j][0] == "A"), None)
            if mid is not None and end is not None and rows[end][1] >= t:
                want.append((o, t, rows[mid][1], rows[end][1] - t))
    assert got == sorted(want) and want


def test_many_events_of_one_object_in_linear_time(spark):
    import time

    from tracewright.operators import episodes
    from tracewright.sources.adapters import clickstream

    log = clickstream(spark, "/root/testdata/sf0.001")
    events = spark.range(60_000).select(F.concat(F.lit("x"), "id").alias("event_id"), F.lit("t").alias("event_type"), F.col("id").alias("time_ms"), F.col("id").alias("event_seq"))
    none = {c: F.lit(None).cast(t) for c, t in {"v_int": "long", "v_float": "double", "v_bool": "boolean", "v_time_ms": "long"}.items()}
    attrs = events.select("event_id", "event_seq", F.lit(0).cast("long").alias("attr_seq"), F.lit("state").alias("name"), F.lit("string").alias("attr_type"), F.when(F.col("event_seq") % 3 == 0, "A").when(F.col("event_seq") % 3 == 1, "B").otherwise("C").alias("v_string"), *[c.alias(n) for n, c in none.items()])
    e2o = events.select("event_id", "event_seq", F.lit(0).cast("long").alias("rel_seq"), F.lit("u1").alias("object_id"), F.lit("").alias("qualifier"))
    objects = spark.createDataFrame([("u1", "user", 1)], "object_id string, object_type string, object_seq long")
    began = time.time()
    row = episodes.performance_spectrum(log.but(events=events, event_attrs=attrs, e2o=e2o, objects=objects), "user", "A", "B", True).first()
    assert row["sample_count"] == 19_999 and row["median_ms"] == 3 and time.time() - began < 60
