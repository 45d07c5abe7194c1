"""Requests, results of endpoints where a log has little to give, and documents of results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import results
from tracewright.model import LogError
from tracewright.operators import patterns
from tracewright.requests import decode
from tracewright.session import LogSession
from tracewright.tables import order_statistics, with_quantiles

STATES = "STATE state FOR LEADING OBJECT TYPE Cart AS CASE WHEN object.size > 1 THEN 'Full' WHEN object.gift = true THEN 'Gift' ELSE event.clerk END"


@pytest.fixture(scope="module")
def session(spark):
    from test_documents import PATH

    s = LogSession.open(spark, "file://" + PATH)
    s.apply_state_query(STATES)
    return s


@pytest.mark.parametrize(
    "endpoint, request_, said",
    [
        ("state_detection", {}, "missing field 'object_type'"), ("state_detection", {"object_type": None}, "'object_type' isn't a text"), ("state_detection", {"object_type": "a", "epochs": -1}, "'epochs' isn't a whole"),
        ("state_detection_cell", {"object_type": "a", "cell_x": 0}, "missing field 'cell_y'"), ("state_detection_cell", {"object_type": "a", "cell_x": 1.5, "cell_y": 0}, "'cell_x'"),
        ("apply_filter", {"df_edges": [{"source": "a"}]}, r"missing field 'df_edges\[0\].target'"), ("apply_filter", {"event_types": None}, "'event_types' isn't a list"), ("apply_filter", {"event_types": [1]}, r"'event_types\[0\]' isn't a text"),
        ("apply_filter", {"text_attributes": [{"values": []}]}, "name"), ("apply_filter", [], "isn't an object"), ("apply_filter", "{", "isn't valid JSON"), ("time_perspective", {"roundtrip": 1}, "neither true nor false"),
        ("time_perspective", {"buckets": True}, "'buckets'"), ("object_search", {"limit": "3"}, "'limit'"), ("fit_causal_model", {"object_type": "a", "nodes": [{"id": "x", "role": "latent"}]}, r"nodes\[0\].label"), ("nothing", {}, "no endpoint"),
    ],
)
def test_bad_requests(endpoint, request_, said):
    with pytest.raises(LogError, match=said):
        decode(endpoint, request_)


def test_defaults_and_bounds():
    assert decode("time_perspective", None) == {"object_type": None, "from_state": None, "to_state": None, "roundtrip": False, "buckets": 24}
    assert decode("time_perspective", '{"buckets": 4000, "other": 1}')["buckets"] == 96 and decode("time_perspective", {"buckets": 0})["buckets"] == 4
    assert decode("state_transition_kpis", {"stuck_limit": None})["stuck_limit"] == 15 and decode("object_search", {"limit": 0, "query": None}) == {"object_type": None, "query": "", "limit": 1}
    found = decode("apply_filter", {"text_attributes": [{"name": "a"}], "time_range": {"start_ms": -5}, "patterns": [{"state": "x"}]})
    assert found["text_attributes"] == [{"scope": "event", "name": "a", "values": []}] and found["time_range"] == {"start_ms": -5, "end_ms": None} and found["patterns"][0]["eo_edges"] == []
    assert decode("state_detection", {"object_type": "a", "window_size": 99, "epochs": 1}) == {"object_type": "a", "window_size": 30, "som_width": None, "som_height": None, "epochs": 10, "color_attribute": None}


def test_lifecycle_events_name_the_other_objects(session):
    found = json.loads(results.assemble(session.answer("object_lifecycle_detail", {"object_id": "k1"})))
    assert [e["event_id"] for e in found["events"]] == ["a", "b", "c", "c", "e"] and found["event_count"] == 5 and found["object_type"] == "Cart"
    assert found["events"][0]["related_objects"] == [{"object_id": "ann", "object_type": "Person", "qualifier": ""}]
    for e in session.object_lifecycle_detail("k1")["events"].collect():
        links = session.active.e2o.filter((F.col("event_id") == e["event_id"]) & (F.col("object_id") != "k1")).join(session.active.objects, "object_id").orderBy("rel_seq").collect()
        assert [(r["object_id"], r["object_type"], r["qualifier"]) for r in e["related_objects"]] == [(r["object_id"], r["object_type"], r["qualifier"]) for r in links]
    assert {"name": "state", "value": "Gift"} in found["events"][0]["attributes"] and found["stock_points"] == [{"name": "stock_left", "time_ms": found["events"][1]["time_ms"], "value": 7.0, "event_id": "b"}]
    with pytest.raises(LogError, match="unknown object"):
        session.object_lifecycle_detail("gone")["events"].count()


def test_one_state_alone(session):
    s = LogSession(session.original)
    s.apply_state_query("STATE state FOR LEADING OBJECT TYPE Cart AS CASE WHEN event.id IS NOT NULL THEN 'Only' END")
    found = json.loads(results.assemble(s.answer("time_perspective", {"buckets": 4})))
    assert found["performance"] == {"object_type": "Cart", "from_state": "", "to_state": "", "roundtrip": False, "sample_count": 0, "min_duration_ms": None, "median_duration_ms": None, "avg_duration_ms": None, "max_duration_ms": None}
    assert found["states"] == ["Only"] and len(found["buckets"]) == 4 and found["event_min_ms"] == found["buckets"][0]["start_ms"] and found["event_max_ms"] == found["buckets"][3]["end_ms"] and "samples" not in found
    assert s.time_perspective()["from_state"] == ""


def test_correlations_count_dominant_states(session):
    s = LogSession(session.original)
    # X on one event only of k1, whose others are Y: no object is dominated by X
    s.apply_state_query("STATE state FOR LEADING OBJECT TYPE Cart AS CASE WHEN event.type = 'Pay' THEN 'X' ELSE 'Y' END")
    found = s.state_correlations()
    spread = {r["state"]: r["count"] for r in found["state_distribution"].collect()}
    assert found["state_count"] == len(spread) and found["stateful_object_count"] == sum(spread.values()) and found["object_count"] == 2
    assert found["feature_count"] == found["rows"].count() and s.state_transition_kpis()["state_count"] == 2


def test_detection_of_a_type_without_events(session):
    log = session.original
    bare = log.but(e2o=log.e2o.filter("false"), object_attrs=log.object_attrs.filter("false"))
    for it, said in ((bare, "no numeric features"), (log.but(e2o=log.e2o.filter("false")), "no windows|no numeric features"), (log.but(objects=log.objects.filter("object_type <> 'Cart'")), "no objects")):
        with pytest.raises(LogError, match=said):
            LogSession(it).state_detection("Cart")
    with pytest.raises(LogError, match="unknown object type"):
        LogSession(log).state_detection("Robot")


def test_pattern_documents_hold_the_weighted_edges(session, tmp_path):
    document = session.answer("state_patterns")
    found = json.loads(results.assemble(document))["patterns"]
    assert len(found) == 4 and [p["support"] for p in found] == sorted([p["support"] for p in found], reverse=True)
    for family in ("intra", "inter"):
        for kind in ("df", "eo", "oo"):
            want = {}
            for r in patterns.pattern_edges(session.active, family, kind).collect():
                want.setdefault((r["state"], r["to_state"], tuple(r["sequence"]), repr(r["eo"])), []).append((r["source"], r["target"], r["weight"]))
            got = [sorted((e["source"], e["target"], e["weight"]) for e in p[f"{kind}_edges"]) for p in found if p["family"] == family]
            assert sorted(g for g in got if g) == sorted(map(sorted, want.values()))
    one = next(p for p in found if p["family"] == "inter")
    assert one["state"] is None and one["from_state"] and one["label"] == f"{one['from_state']} -> {one['to_state']} on Cart" and "Cart" in one["object_types"]
    results.write(document, f"file://{tmp_path}/out")
    assert sorted(json.loads(x)["id"] for f in (tmp_path / "out").glob("part=patterns/part-*") for x in f.read_text().splitlines()) == sorted(p["id"] for p in found)


def test_other_documents(session):
    table = json.loads(results.assemble(session.answer("causal_feature_table", {"object_type": "Cart"})))
    assert table["object_count"] == 2 and table["feature_count"] == len(table["feature_columns"]) == len(table["table_preview"][0]["values"]) and [r["object_id"] for r in table["table_preview"]] == ["k1", "k2"]
    assert [o["object_id"] for o in json.loads(results.assemble(session.answer("object_search", {"query": " K ", "limit": 1})))["objects"]] == ["k1"]
    assert json.loads(results.assemble(session.answer("summary")))["source_format"] == "json"
    graph = json.loads(results.assemble(session.answer("object_centric_graph", '{"object_types": ["Cart"], "min_path_frequency": 1}')))
    assert [n["id"] for n in graph["nodes"]] == [f"n{i + 1}" for i in range(len(graph["nodes"]))] and graph["edges"][0]["points"][0].keys() == {"x", "y"} and graph["width"] >= 720
    with pytest.raises(LogError, match="missing field"):
        session.answer("causal_feature_table", {})


def test_documents_of_detection(session):
    """The documents of requests against the session's own results; moves and boundary windows add up."""
    asked = {"object_type": "Cart", "window_size": 2, "som_width": 2, "som_height": 2, "epochs": 10}
    found = session.state_detection("Cart", size=2, width=2, height=2, epochs=10)
    own = json.loads(results.assemble(session.answer("state_detection", asked)))
    assert own["window_count"] == found.points.count() == len(own["windows"]) == sum(c["count"] for c in own["cells"]) and own["feature_columns"] == found.columns and own["color_options"][0]["kind"] == "count"
    assert [(c["x"], c["y"]) for c in own["cells"]] == [(0, 0), (1, 0), (0, 1), (1, 1)] and own["window_size"] == 2
    moves = own.get("transitions", [])
    assert moves == sorted(moves, key=lambda m: (-m["count"], m["distance"], m["source_y"], m["source_x"]))
    total = 0
    for x, y in [(0, 0), (1, 0), (0, 1), (1, 1)]:
        cell = json.loads(results.assemble(results.detection_cell(found, x, y) if x or y else session.answer("state_detection_cell", asked | {"cell_x": x, "cell_y": y})))
        assert cell["entering_count"] == len(cell.get("entering_windows", [])) == sum(m["count"] for m in moves if (m["target_x"], m["target_y"]) == (x, y))
        assert all(w["target_cell"] == f"S{x + 1}-{y + 1}" != w["source_cell"] and len(w["activities"]) <= 2 for w in cell.get("entering_windows", []))
        starts = sum(e["weight"] for e in cell.get("graph_edges", []) if e["source"].startswith("START"))
        assert starts == cell["cell"][0]["count"] == next(c["count"] for c in own["cells"] if (c["x"], c["y"]) == (x, y))
        total += cell["exiting_count"]
    assert total == sum(m["count"] for m in moves)
    with pytest.raises(LogError, match="no cell 2, 0"):
        session.answer("state_detection_cell", asked | {"cell_x": 2, "cell_y": 0})


def test_documents_of_options_and_graphs(session):
    options = json.loads(results.assemble(session.answer("filter_options")))
    assert [t["type_name"] for t in options["object_types"]] == [r["type_name"] for r in session.filter_options()["object_types"].orderBy("type_seq").collect()]
    assert len(options["time_buckets"]) == 32 and options["time_buckets"][0]["start_ms"] == options["time_min_ms"] and sum(b["count"] for b in options["time_buckets"]) == session.original.events.count()
    assert all(t["values"] == sorted(t["values"]) for t in options["text_attributes"])
    graph = json.loads(results.assemble(session.answer("directly_follows_graph", {"object_type": "Cart"})))
    edges = session.directly_follows_graph("Cart").edges.collect()
    assert sorted(e["weight"] for e in graph["edges"]) == sorted(e["weight"] for e in edges) and {n["kind"] for n in graph["nodes"]} == {"start", "activity", "end"}
    with pytest.raises(LogError):
        session.answer("directly_follows_graph", {"object_type": "nothing"})


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
def test_order_statistics(spark, n):
    rng = np.random.default_rng(n)
    values = [int(x) for x in rng.integers(0, 50, n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v long").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.75, 0.99]
    assert order_statistics(df, "v", shares) == {q: sorted(values)[int(n * q)] for q in shares if n}
    cuts = [sorted(values)[int(n * q)] for q in (0.25, 0.5, 0.75)] if n else []
    for r in with_quantiles(df, "v", [0.25, 0.5, 0.75], "k").collect():
        assert r["k"] == (None if r["v"] is None else 1 + sum(r["v"] > c for c in cuts))
