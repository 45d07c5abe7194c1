"""Places, lines and routes of graphs against plain Python, on a log whose graph is known."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import graphs, layout
from tracewright.plans import stateql
from tracewright.sources import documents

EVENTS = ["Create Purchase Requisition", "Approve Purchase Requisition", "Create Purchase Order", "Change PO Quantity", "Insert Invoice", "Insert Invoice", "Insert Payment",
          "Insert Payment", "Insert Invoice", "Create Purchase Order", "Set Payment Block", "Remove Payment Block", "Insert Payment"]
LIVES = {"R1": (5, 7), "R2": (6, 8), "R3": (9, 10, 11, 12, 13), "P1": (7,), "P2": (8,), "P3": (13,), "PO1": (3, 4, 5, 6), "PO2": (10,), "PR1": (1, 2, 3)}
TYPES = {"R": "Invoice", "P": "Payment", "PO": "Purchase Order", "PR": "Purchase Requisition"}


def purchases() -> str:
    of = lambda e: [{"objectId": o, "qualifier": ""} for o, es in LIVES.items() if e in es]
    return json.dumps({
        "objectTypes": [{"name": t, "attributes": []} for t in [*TYPES.values(), "Nothing"]], "eventTypes": [{"name": t, "attributes": []} for t in sorted(set(EVENTS))],
        "objects": [{"id": "none", "type": "Nothing"}, *[{"id": o, "type": TYPES[o.rstrip("0123456789")]} for o in LIVES]],
        "events": [{"id": f"e{i}", "type": t, "time": f"2022-01-{i:02}T00:00:00Z", "attributes": [], "relationships": of(i)} for i, t in enumerate(EVENTS, 1)],
    })


@pytest.fixture(scope="module")
def log(spark):
    return documents.read_text(spark, purchases())


def test_known_edges(log):
    edges = lambda kind: {(r["source"], r["target"]): r["weight"] for r in graphs.dfg(log, kind).edges.collect()}
    assert edges("Invoice") == {
        ("START\nInvoice", "Insert Invoice"): 3, ("Insert Invoice", "Insert Payment"): 2, ("Insert Payment", "END\nInvoice"): 3, ("Insert Invoice", "Create Purchase Order"): 1,
        ("Create Purchase Order", "Set Payment Block"): 1, ("Set Payment Block", "Remove Payment Block"): 1, ("Remove Payment Block", "Insert Payment"): 1,
    }
    assert edges("Purchase Order") == {
        ("START\nPurchase Order", "Create Purchase Order"): 2, ("Create Purchase Order", "Change PO Quantity"): 1, ("Change PO Quantity", "Insert Invoice"): 1,
        ("Insert Invoice", "Insert Invoice"): 1, ("Insert Invoice", "END\nPurchase Order"): 1, ("Create Purchase Order", "END\nPurchase Order"): 1,
    }
    assert graphs.oc_dfg(log).nodes.filter("label = 'Insert Payment'").first()["count"] == 6


def wrap(label, most):
    """Lines by a loop over characters and words."""
    lines = []
    for chunk in label.split("\n"):
        now = ""
        for word in chunk.split():
            parts = [""]
            for c in word:
                if parts[-1] and len((parts[-1] + c).encode()) > most:
                    parts.append("")
                parts[-1] += c
            for part in parts:
                if now and len(f"{now} {part}".encode()) > most:
                    lines.append(now)
                    now = part
                else:
                    now = f"{now} {part}" if now else part
        lines += [now] if now else []
    lines = lines or [label]
    if len(lines) > 4:
        last = lines[3].encode()[: most - 3].decode(errors="ignore")
        lines = [*lines[:3], last + "..."]
    return lines


def test_lines(spark):
    labels = ["", " ", "short", "START\nPurchase Order", "Approve Purchase Requisition [a state of many words]", "x" * 60, "é" * 40 + " end", "one two\n\nthree\tfour", " ".join(["several"] * 30), "a\nb\nc\nd\ne", "\U0001f600" * 9]
    df = spark.createDataFrame([(s, m) for s in labels for m in (18, 24)], "label string, most int")
    for r in df.select("*", layout.wrapped(F.col("label"), F.col("most")).alias("lines")).collect():
        assert r["lines"] == wrap(r["label"], r["most"]), r


def twin(nodes, edges, colour):
    """Places and routes of nodes (label, kind, count, avg_order) and edges (source, target, type, weight)."""
    layers = {}
    for n in nodes:
        layers.setdefault(int(n["avg_order"] * 2 + 0.5), []).append(n)
    highest, at, number = max(map(len, layers.values())), {}, 0
    for i, layer in enumerate(sorted(layers)):
        own = sorted(layers[layer], key=lambda n: (-n["count"], n["label"]))
        for row, n in enumerate(own):
            number += 1
            edge = n["kind"] in ("start", "end")
            lines = wrap(n["label"], 18 if edge else 24)
            y = 76 + (highest - len(own)) * 158 / 2 + (158 * 0.12 if i % 2 and len(own) > 1 else 0) + row * 158
            at[n["label"]] = (f"n{number}", 76.0 + 340 * i, y, {"start": 168.0, "end": 168.0, "state_change": 230.0}.get(n["kind"], 215.0), max(72.0, 62.0 + 14 * (len(lines) - 1)), lines, colour[n["label"].split("\n")[1]] if edge else "#42635c")
    routes = []
    for e in edges:
        beside = sorted(x["object_type"] for x in edges if (x["source"], x["target"]) == (e["source"], e["target"]))
        lane = (beside.index(e["object_type"]) - (len(beside) - 1) / 2) * 30
        (s, sx, sy, sw, sh, _, _), (t, tx, ty, tw, th, _, _) = at[e["source"]], at[e["target"]]
        if s == t:
            p = [(sx + sw, sy + sh / 2), (sx + sw + 44, sy + sh / 2 - 42 + lane), (sx + sw / 2, sy - 28 + lane), (sx, sy + sh / 2 - 16)]
        else:
            a, b = (sx + sw, tx) if sx + sw <= tx else (sx, tx + tw)
            p = [(a, sy + sh / 2), ((a + b) / 2, sy + sh / 2 + lane), ((a + b) / 2, ty + th / 2 + lane), (b, ty + th / 2)]
        routes.append((-e["weight"], s, t, e["object_type"], p))
    return at, sorted(routes)


@pytest.mark.parametrize("kind", ["plain", "states", "chosen"])
def test_places_and_routes(spark, log, kind):
    if kind == "states":
        log = stateql.apply_state_query(log, "STATE state FOR LEADING OBJECT TYPE Invoice AS CASE WHEN event.type = 'Insert Invoice' THEN 'Invoice Handling' WHEN event.type LIKE '%block%' THEN 'Held' ELSE 'Payment Execution' END")
        graph, colour = graphs.state_aware_oc_dfg(log), layout.colours(log, with_state=True)
    else:
        chosen = ["Purchase Order", "Payment", "Nothing"] if kind == "chosen" else None
        graph, colour = graphs.oc_dfg(log, chosen), layout.colours(log, chosen)
    hues = {r["object_type"]: r["color"] for r in colour.collect()}
    order = {"plain": ["Invoice", "Payment", "Purchase Order", "Purchase Requisition"], "states": ["Invoice", "Payment", "Purchase Order"], "chosen": ["Payment", "Purchase Order"]}[kind]
    assert hues == {t: f"hsl({(214 + 137 * i) % 360} 68% 38%)" for i, t in enumerate(order)}
    found = layout.layout(graph, colour)
    places, routes = twin(graph.nodes.collect(), graph.edges.collect(), hues)
    nodes = found.nodes.collect()
    assert {n["label"]: (n["id"], n["x"], pytest.approx(n["y"]), n["width"], n["height"], n["lines"], n["color"]) for n in nodes} == places
    edges = sorted(found.edges.collect(), key=lambda e: int(e["id"][1:]))
    assert [e["id"] for e in edges] == [f"e{i + 1}" for i in range(len(routes))]
    for e, (weight, s, t, kind_of, p) in zip(edges, routes, strict=True):
        assert (e["weight"], e["source"], e["target"], e["object_type"], e["color"]) == (-weight, s, t, kind_of, hues[kind_of]) and e["title"] == f"{kind_of}: {-weight}"
        assert [(q["x"], q["y"]) for q in e["points"]] == [(x, pytest.approx(y)) for x, y in p]
        numbers = " ".join("{:.1f} {:.1f}".format(*q) for q in p).split(" ", 2)
        assert e["path"] == f"M {numbers[0]} {numbers[1]} C {numbers[2]}"
        assert (e["label_x"], e["label_y"]) == ((p[1][0] + p[2][0]) / 2, pytest.approx((p[1][1] + p[2][1]) / 2 - 6))
    size = found.size.first()
    assert size["width"] == max(720, max(n["x"] + n["width"] + 76 for n in nodes)) and size["height"] == max(320, 152 + 158 * max(map(len, [[m for m in nodes if m["x"] == n["x"]] for n in nodes])))


def test_an_empty_graph(log):
    found = layout.layout(graphs.oc_dfg(log, []), layout.colours(log, []))
    assert found.nodes.count() == found.edges.count() == 0 and tuple(found.size.first()) == (720.0, 320.0)
