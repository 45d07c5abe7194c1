"""Directly-follows graphs: of one object type, object-centric, and state-aware.

A graph is a table of edges (source, target, object_type, weight) and one of nodes (label, kind, count, avg_order).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import STATE, EventLog, lifecycle, stateful_lifecycle


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def _bound(which: str):
    return F.concat(F.lit(f"{which}\n"), F.col("object_type"))


def _selected(rows: DataFrame, object_types: list[str] | None) -> DataFrame:
    return rows if object_types is None else rows.filter(F.col("object_type").isin(object_types) if object_types else F.lit(False))


def directly_follows(rows: DataFrame) -> Graph:
    """The graph of lifecycle rows: START and END of each type around each object's activities."""
    order = Window.partitionBy("object_id").orderBy("pos")
    follows = rows.select("object_id", "object_type", "event_type", "pos", F.lead("event_type").over(order).alias("next"))
    link = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    first = F.when(F.col("pos") == 0, link(_bound("START"), F.col("event_type")))
    after = link(F.col("event_type"), F.coalesce("next", _bound("END")))
    edges = follows.select("object_type", F.explode(F.array_compact(F.array(first, after))).alias("e"))
    edges = edges.groupBy("e.source", "e.target", "object_type").agg(F.count(F.lit(1)).alias("weight"))
    place = lambda label, kind, at: F.struct(label.alias("label"), F.lit(kind).alias("kind"), at.cast("double").alias("order"))
    spots = F.array_compact(
        F.array(
            place(F.col("event_type"), "activity", F.col("pos") + 1),
            F.when(F.col("pos") == 0, place(_bound("START"), "start", F.lit(0))),
            F.when(F.col("next").isNull(), place(_bound("END"), "end", F.col("pos") + 2)),
        )
    )
    nodes = follows.select(F.explode(spots).alias("n")).groupBy("n.label", "n.kind").agg(F.count(F.lit(1)).alias("count"), F.avg("n.order").alias("avg_order"))
    return Graph(nodes, edges)


def state_aware(rows: DataFrame) -> Graph:
    """The graph of stateful lifecycle rows: activities with their state, and a node between two states."""
    order = Window.partitionBy("object_id").orderBy("pos")
    label = F.concat("event_type", F.lit(" ["), STATE, F.lit("]"))
    rows = rows.select("object_id", "object_type", "pos", STATE, label.alias("label"))
    rows = rows.select("*", F.lead("label").over(order).alias("next"), F.lead(STATE).over(order).alias("next_state"))
    change = F.when(F.col("next_state") != F.col(STATE), F.concat(F.lit("CHANGE "), STATE, F.lit(" -> "), "next_state"))
    link = lambda s, t: F.struct(s.alias("source"), t.alias("target"))
    after = F.coalesce("next", _bound("END"))
    links = F.array_compact(
        F.array(
            F.when(F.col("pos") == 0, link(_bound("START"), F.col("label"))),
            F.when(change.isNull(), link(F.col("label"), after)),
            F.when(change.isNotNull(), link(F.col("label"), change)),
            F.when(change.isNotNull(), link(change, F.col("next"))),
        )
    )
    edges = rows.select("object_type", F.explode(links).alias("e")).groupBy("e.source", "e.target", "object_type").agg(F.count(F.lit(1)).alias("weight"))
    place = lambda label, kind, at: F.struct(label.alias("label"), F.lit(kind).alias("kind"), at.cast("double").alias("order"))
    spots = F.array_compact(
        F.array(
            place(F.col("label"), "activity", F.col("pos") * 2 + 1),
            F.when(F.col("pos") == 0, place(_bound("START"), "start", F.lit(0))),
            F.when(F.col("next").isNull(), place(_bound("END"), "end", F.col("pos") * 2 + 2)),
            F.when(change.isNotNull(), place(change, "state_change", F.col("pos") * 2 + 2)),
        )
    )
    nodes = rows.select(F.explode(spots).alias("n")).groupBy("n.label", "n.kind").agg(F.count(F.lit(1)).alias("count"), F.avg("n.order").alias("avg_order"))
    return Graph(nodes, edges)


def frequent(graph: Graph, min_activity: int = 0, min_path: int = 0) -> Graph:
    """Without rare activities and paths, edges that lost an end, and boundary nodes that lost all edges."""
    boundary = F.col("kind").isin("start", "end")
    nodes = graph.nodes.filter(boundary | (F.col("count") >= min_activity))
    labels = nodes.select("label")
    edges = graph.edges.filter(F.col("weight") >= min_path)
    for end in ("source", "target"):
        # where no node goes, each end is one
        edges = edges.join(labels.withColumnRenamed("label", end), end, "left_semi") if min_activity > 0 else edges.filter(F.col(end).isNotNull())
    edges = edges.select("source", "target", "object_type", "weight")
    used = edges.select(F.explode(F.array("source", "target")).alias("label")).distinct()
    linked = nodes.filter(boundary).join(used, "label", "left_semi")
    return Graph(nodes.filter(~boundary).unionByName(linked), edges)


def dfg(log: EventLog, object_type: str) -> Graph:
    log.require_type(object_type)
    return directly_follows(lifecycle(log, object_type=object_type))


def oc_dfg(log: EventLog, object_types: list[str] | None = None, min_activity: int = 0, min_path: int = 0) -> Graph:
    """Over all types, or those listed (none listed: an empty graph). Activities of one name are one node."""
    return frequent(directly_follows(_selected(lifecycle(log), object_types)), min_activity, min_path)


def state_aware_oc_dfg(log: EventLog, object_types: list[str] | None = None, min_activity: int = 0, min_path: int = 0) -> Graph:
    return frequent(state_aware(_selected(stateful_lifecycle(log), object_types)), min_activity, min_path)


def top_edges(graph: Graph, k: int = 12) -> DataFrame:
    return graph.edges.orderBy(F.desc("weight"), "source", "target", "object_type").limit(k)


def edge_options(graph: Graph) -> DataFrame:
    """source, target, label, weight: the pairs of activities that an edge filter can name, of all types together."""
    activities = graph.nodes.filter(F.col("kind") == "activity").select("label")
    edges = graph.edges
    for end in ("source", "target"):
        edges = edges.join(activities.withColumnRenamed("label", end), end, "left_semi")
    pairs = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    return pairs.select("source", "target", F.concat("source", F.lit(" -> "), "target").alias("label"), "weight")
