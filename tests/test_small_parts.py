"""Parts without a query of their own: headers of state queries, proposals of models, bounds of time, file names, top edges."""

import json

import pytest

from tracewright.model import LogError
from tracewright.operators import filters, graphs, proposals
from tracewright.operators.features import CausalNode
from tracewright.plans import stateql
from tracewright.sources import documents, export


def test_headers_take_another_type():
    text = "\n  STATE mood FOR LEADING OBJECT TYPE 'It''s' AS CASE WHEN event.type = 'STATE x AS CASE' THEN 'A' END"
    got = stateql.with_leading_type(text, "Bob's")
    assert got.endswith(" STATE mood FOR LEADING OBJECT TYPE 'Bob''s' AS CASE WHEN event.type = 'STATE x AS CASE' THEN 'A' END")
    assert (stateql.parse(got).leading_type, stateql.parse(got).attribute, len(stateql.parse(got).branches)) == ("Bob's", "mood", 1)
    for header in ("STATE s AS CASE", 'state s for leading object type "a""b" as case', "STATE s FOR LEADING OBJECT TYPE plain\nAS CASE"):
        assert stateql.parse(stateql.with_leading_type(header + " WHEN event.a = 1 THEN 'x' END", "New")).leading_type == "New"
    made = stateql.parse(stateql.with_leading_type("CASE nothing", "O'Neil"))
    assert made.leading_type == "O'Neil" and made == stateql.parse(stateql.default_query("O'Neil"))


NODES = [CausalNode("o1", "observable", "f"), CausalNode("o2", "observable", "g"), CausalNode("l1", "latent"), CausalNode("l2", "latent"), CausalNode("l3", "latent"), CausalNode("y", "outcome", "h")]


def test_edges_that_may_stay():
    edges = [("o1", "l1"), ("o1", "l1"), ("o1", "y"), ("l1", "l2"), ("l2", "l1"), ("l2", "l3"), ("l3", "l1"), ("l1", "l3"), ("l1", "l1"), ("l3", "y"), ("y", "l1"), ("o1", "o2"), ("l1", "gone"), ("l3", "o1")]
    assert proposals.prune(NODES, edges) == [("o1", "l1"), ("l1", "l2"), ("l2", "l3"), ("l1", "l3"), ("l3", "y")]


def test_proposals():
    found = {
        "nodes": [{"id": "a", "role": "Observable", "feature": "f", "operation": "LN", "label": "Clicks"}, {"label": "Interest", "role": "latent", "feature": "f", "operation": "sqrt"}, {"id": "bad", "role": "observable", "feature": "none"},
                  {"id": "x", "role": "boss"}, "text", None, {"role": "outcome", "name": "Sales", "feature": "h", "operation": "cube"}],
        "edges": [{"source": "a", "target": "Interest"}, {"source": "Interest", "target": "Sales"}, {"source": "bad", "target": "Interest"}, {"source": "Sales", "target": "a"}, 5],
    }
    for answer in (json.dumps(found), f"Here it is:\n```json\n{json.dumps(found, indent=1)}\n```\nEnjoy {{}}", f"I think {json.dumps(found)} fits."):
        nodes, edges = proposals.read(answer, ["f", "h"])
        assert [(n.id, n.role, n.feature, n.operation, n.label) for n in nodes] == [("observable-1", "observable", "f", "log_e", "Clicks"), ("latent-1", "latent", None, "identity", "Interest"), ("outcome-1", "outcome", "h", "identity", "Sales")]
        assert edges == [("observable-1", "latent-1"), ("latent-1", "outcome-1")][: len(edges)] and len(edges) >= 1
    for bad, said in (("no idea", "no JSON"), ("[1]", "isn't a JSON object"), ('{"nodes": []}', "no node"), ("{broken}", "no JSON"), ('{"nodes": {"a": 1}}', "no node")):
        with pytest.raises(LogError, match=said):
            proposals.read(bad, ["f"])


def test_bounds_and_names():
    assert filters.normal_range(9, 3, 0, 10) == (3, 9) and filters.normal_range(0, 10, 0, 10) == (None, None) and filters.normal_range(None, 4, 0, 10) == (None, 4)
    assert export.feature_file_name("log", "Purchase Order / 2") == "log-purchase-order-2-features.csv" and export.feature_file_name("log", "??", "causal-features") == "log-objects-causal-features.csv"


def test_edge_options_and_top_edges(spark):
    from test_layout import purchases

    graph = graphs.oc_dfg(documents.read_text(spark, purchases()))
    options = {(r["source"], r["target"]): (r["label"], r["weight"]) for r in graphs.edge_options(graph).collect()}
    assert options["Create Purchase Order", "Change PO Quantity"] == ("Create Purchase Order -> Change PO Quantity", 1) and not any("\n" in x for pair in options for x in pair)
    edges = sorted(map(tuple, graph.edges.select("weight", "source", "target", "object_type").collect()), key=lambda e: (-e[0], *e[1:]))
    assert [tuple(r) for r in graphs.top_edges(graph, 4).select("weight", "source", "target", "object_type").collect()] == edges[:4]
