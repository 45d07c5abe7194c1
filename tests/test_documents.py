"""Import, validation, export and round trips of OCEL 2.0 documents."""

import gzip
import json
import os
import re

import pytest

from tracewright.model import SCHEMAS, LogError
from tracewright.operators import graphs, summary
from tracewright.session import LogSession
from tracewright.sources import documents, export

PATH = os.path.join(os.path.dirname(__file__), "fixtures", "shop.json")


@pytest.fixture(scope="module")
def shop(spark):
    return documents.read_log(spark, "file://" + PATH)


def doc():
    with open(PATH) as f:
        return json.load(f)


def counts(log):
    return summary.summary(log).first().asDict()


def test_counts_and_types(shop):
    assert counts(shop) == {"event_types": 3, "object_types": 2, "events": 6, "objects": 4, "e2o_relationships": 9, "o2o_relationships": 1, "objects_with_lifecycle": 4, "stateful_events": 0}
    times = {r["event_id"]: r["time_ms"] for r in shop.events.collect()}
    assert times["c"] - times["b"] == 120_250 and times["f"] % 86_400_000 == 0
    values = {(r["event_id"], r["name"]): (r["attr_type"], r["v_string"], r["v_int"], r["v_float"], r["v_time_ms"]) for r in shop.event_attrs.collect()}
    assert values["b", "price"][3] == 2.0 and values["b", "stock_left"][2] == 7 and values["c", "note"][:2] == ("string", "x") and values["e", "due"][4] == 1709337600000
    carts = {(r["object_id"], r["name"], r["time_ms"]): (r["v_int"], r["v_bool"]) for r in shop.object_attrs.collect()}
    assert carts["k2", "size", 0] == (5, None) and carts["k1", "gift", 0] == (None, True)


def test_an_object_named_twice_is_twice_in_its_lifecycle(shop):
    assert summary.object_lifecycle(shop, "k1") == ["a", "b", "c", "c", "e"]
    edges = {(r["source"], r["target"]): r["weight"] for r in graphs.dfg(shop, "Cart").edges.collect()}
    assert edges["Add Item", "Add Item"] == 2 and edges["START\nCart", "Open Cart"] == 2


@pytest.mark.parametrize("kind", ["json", "xml"])
def test_round_trip(spark, shop, kind):
    text = (export.export_json if kind == "json" else export.export_xml)(shop)
    if kind == "json":
        json.loads(text)
    again = documents.read_text(spark, gzip.compress(text.encode()))
    assert again.source_format == kind and counts(again) == counts(shop)
    for name in ("events", "e2o", "objects", "o2o"):
        rows = lambda log: sorted(map(tuple, getattr(log, name).collect()))  # noqa: B023, E731
        assert rows(again) == rows(shop), name
    key = lambda log: sorted((r["object_id"], r["name"], r["time_ms"], r["v_string"] or "", r["v_int"] or 0, bool(r["v_bool"])) for r in log.object_attrs.collect())
    assert key(again) == key(shop)


def broken(change):
    d = doc()
    change(d)
    return json.dumps(d)


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda d: d["eventTypes"].append(d["eventTypes"][0]), "duplicate event type 'Open Cart'"),
        (lambda d: d["objectTypes"][0]["attributes"].append({"name": "size", "type": "string"}), "duplicate attribute 'size'"),
        (lambda d: d["objects"].append(d["objects"][0]), "duplicate object id 'k1'"),
        (lambda d: d["objects"][3].update(type="Robot"), "unknown type 'Robot'"),
        (lambda d: d["events"].append(d["events"][0]), "duplicate event id 'a'"),
        (lambda d: d["events"][0]["relationships"].append({"objectId": "missing"}), "unknown object 'missing'"),
        (lambda d: d["objects"][1].update(relationships=[{"objectId": "gone"}]), "unknown object 'gone'"),
        (lambda d: d["objects"][0]["attributes"][0].update(value="many"), "bad value"),
        (lambda d: d["events"][0].update(time="soon"), "bad time 'soon'"),
        (lambda d: d["events"][1]["attributes"][1].update(value=None), "bad value"),
        (lambda d: d.pop("events"), "missing key 'events'"),
    ],
)
def test_faults(spark, change, said):
    with pytest.raises(LogError, match=said):
        documents.read_text(spark, broken(change))


def test_formats():
    assert documents.detect_format("log.JSONOCEL.gz") == "json" and documents.detect_format("x.xmlocel") == "xml" and documents.detect_format(None, b" \n<log/>") == "xml"
    assert documents.export_base_name("/a/b/orders.xml.gz") == "orders" and documents.export_base_name("") == "ocel-export"
    with pytest.raises(LogError):
        documents.detect_format("log.csv", b"a,b")


def test_session(spark, tmp_path):
    from tracewright.operators.filters import LogFilter

    s = LogSession.open(spark, "file://" + PATH)
    done = s.apply_state_query("STATE state FOR LEADING OBJECT TYPE Cart AS CASE WHEN object.size > 1 THEN 'Full' WHEN object.gift = true THEN 'Gift' ELSE event.clerk END")
    assert done == {"attribute": "state", "leading_object_type": "Cart", "assigned_events": 5, "total_events": 6}
    assert s.apply_filter(LogFilter(object_types=["Cart"])).first()["events"] == 5
    assert s.filter_options()["text_attributes"].filter("name = 'state'").count() == 2  # states outlive filters
    assert {(r["from_state"], r["to_state"]): r["count"] for r in s.state_transition_kpis()["transitions"].collect()} == {("Gift", "Full"): 1}
    assert s.state_patterns().count() == 4 and s.state_aware_graph().edges.count() > 0
    assert s.feature_table("Cart").columns[:2] == ["object_id", "activity.Add Item"]
    s.feature_table_csv("Cart", f"file://{tmp_path}/csv")
    detail = s.object_lifecycle_detail("k1")
    assert detail["stock_points"].collect()[0]["value"] == 7.0 and detail["state_bands"].count() == 2
    assert s.time_perspective(buckets=4)["performance"].first()["sample_count"] == 1
    found = s.state_detection("Cart", size=2, width=2, height=2, epochs=10)
    assert found.points.count() == 5 and s.apply_state_detection("Cart", size=2, width=2, height=2, epochs=10)["assigned_events"] == 5


@pytest.mark.parametrize("kind", ["json", "xml"])
def test_documents_of_several_files_go_on_in_the_order_of_their_paths(spark, tmp_path, kind):
    one, two, three = doc(), doc(), doc()
    for k, d in (("2", two), ("3", three)):
        for rows in (d["objects"], d["events"]):
            for r in rows:
                r["id"] = r["id"] + k
                for x in r.get("relationships", []):
                    x["objectId"] = x["objectId"] + k
        d["objectTypes"], d["eventTypes"] = [], []
    for name, d in (("b", two), ("a", one), ("c", three)):
        text = json.dumps(d)
        if kind == "xml":
            whole = d | {"objectTypes": one["objectTypes"], "eventTypes": one["eventTypes"]}
            text = export.export_xml(documents.read_text(spark, json.dumps(whole)))
            text = text if d is one else re.sub(r"<(object|event)-types>.*?</\1-types>", "", text, flags=re.S)
        (tmp_path / f"{name}.{kind}").write_text(text)
    log = documents.read_log(spark, f"file://{tmp_path}", kind)
    n = len(one["events"])
    seqs = {r["event_id"]: r["event_seq"] for r in log.events.collect()}
    assert sorted(seqs.values()) == list(range(3 * n))
    first = [e["id"] for e in one["events"]]
    assert [seqs[i] for i in first] == list(range(n)) and [seqs[f"{i}3"] for i in first] == list(range(2 * n, 3 * n))
    assert summary.object_lifecycle(log, "k12") == [f"{i}2" for i in ["a", "b", "c", "c", "e"]]
    assert summary.object_lifecycle(log, "k1") == ["a", "b", "c", "c", "e"]


def odd_document(kind, indent, spark):
    """Strings with every character that documents are cut at, other keys of the root, and nothing where much could be."""
    d = doc()
    for i in range(30):
        links = [{"objectId": "k1"}, {"objectId": "ann", "qualifier": 'a>b <event id="q"> ] }'}] if i % 2 else []
        d["events"].append({"id": f'x{i} }}{{["\\', "type": "Add Item", "time": "2024-05-01T00:00:00Z", "attributes": [{"name": "price", "value": i / 2}] if i % 3 else [], "relationships": links})
    if kind == "json":
        d = {"meta": {"a": {"b": "x}y"}, "k": '"events": [ {'}, "tags": ["a}", {"z": 1}], "version": "2.0"} | d | {"tail": [[{"q": 1}], []]}
        return json.dumps(d, indent=indent, ensure_ascii=bool(indent)) + ("\n" if indent else "")
    return export.export_xml(documents.read_text(spark, json.dumps(d)))


@pytest.mark.parametrize("kind, indent, size", [("json", None, 90), ("json", 1, 700), ("xml", None, 90)])
def test_several_tasks_read_a_file_as_one_does(spark, tmp_path, kind, indent, size):
    path = tmp_path / f"log.{kind}"
    path.write_text(odd_document(kind, indent, spark))
    rows = lambda log: {t: sorted(map(repr, getattr(log, t).collect())) for t in SCHEMAS}
    one = rows(documents.read_log(spark, f"file://{path}", kind, cut=False))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        assert spark.read.option("lineSep", "}" if kind == "json" else ">").text(f"file://{path}").rdd.getNumPartitions() > 5
        assert rows(documents.read_log(spark, f"file://{path}", kind)) == one  # the file is larger than a task's share
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("text", ['{"objects": [], "events": [', '{"a": "b}', '{"objectTypes": [], "eventTypes": [], "objects": [{"id": 1,}], "events": []}', '{"objectTypes": [], "eventTypes": [], "objects": [5], "events": []}', ""])
def test_several_tasks_see_that_a_document_is_broken(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(LogError, match="valid JSON|missing key"):
        documents.read_log(spark, f"file://{tmp_path}/x.json", cut=True)


def test_several_tasks_read_several_files_in_the_order_of_their_paths(spark, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        d = doc() | ({"objectTypes": [], "eventTypes": [], "objects": []} if first else {})
        for i, e in enumerate(d["events"]):
            e["id"] = f"e{first + i}"
        (tmp_path / f"{name}.json").write_text(json.dumps(d))
    log = documents.read_log(spark, f"file://{tmp_path}", "json", cut=True)
    found = [r["event_id"] for r in log.events.orderBy("event_seq").collect()]
    assert found == [f"e{first + i}" for first in (0, 100) for i in range(6)]
