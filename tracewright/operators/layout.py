"""Drawing of a directly-follows graph: colours of types, layers, wrapped labels, and routes of edges.

All of it is columns over the graph's nodes and edges. A graph is an aggregate, with a row for each activity and
type, or pair of them, so the windows over all of its nodes see few rows, however many events there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..model import EventLog, event_states
from ..tables import written
from .graphs import Graph

#: Distances, margins and sizes of nodes, in pixels.
GAP_X, GAP_Y, MARGIN, LANE = 340.0, 158.0, 76.0, 30.0
WIDTHS = {"state_change": 230.0, "start": 168.0, "end": 168.0, None: 215.0}
LINE, LEAST_HEIGHT, FIRST_LINE = 14.0, 72.0, 62.0
#: Longest lines of labels in bytes, by shape, and the most lines.
LONGEST = {"ellipse": 18, "rect": 24}
LINES = 4
#: Fixed value: the colour of nodes that have no object type.
PLAIN = "#42635c"


@dataclass(frozen=True)
class Layout:
    """Nodes and edges with places, and one row with the drawing's width and height."""

    nodes: DataFrame
    edges: DataFrame
    size: DataFrame


def colours(log: EventLog, object_types: list[str] | None = None, with_state: bool = False) -> DataFrame:
    """object_type, color: hues by the order in which types first appear among the objects that have a lifecycle."""
    rows = log.e2o
    if with_state:
        rows = rows.join(event_states(log).select("event_seq"), "event_seq", "left_semi")
    objects = log.objects.join(rows.select("object_id").distinct(), "object_id", "left_semi")
    if object_types is not None:
        objects = objects.filter(F.col("object_type").isin(object_types) if object_types else F.lit(False))
    first = objects.groupBy("object_type").agg(F.min("object_seq").alias("first"))
    index = F.row_number().over(Window.orderBy("first")) - 1  # a row for each type
    return first.select("object_type", F.format_string("hsl(%d 68%% 38%%)", (F.lit(214) + index * 137) % 360).alias("color"))


def _put(done: Column, joined: Column, alone: Column, most: Column) -> Column:
    """``done`` with its last text made longer, if it stays within ``most`` bytes, else with one text more."""
    fits = (F.size(done) > 0) & (F.octet_length(joined) <= most)
    return F.concat(F.when(fits, F.slice(done, 1, F.size(done) - 1)).otherwise(done), F.array(F.when(fits, joined).otherwise(alone)))


def _split_word(word: Column, most: Column) -> Column:
    """A word in pieces of at most ``most`` bytes, between characters."""
    pieces = F.aggregate(F.split(word, ""), F.array().cast("array<string>"), lambda done, c: _put(done, F.concat(F.element_at(done, -1), c), c, most))
    return F.when(F.octet_length(word) <= most, F.array(word)).otherwise(pieces)


def wrapped(label: Column, most: Column) -> Column:
    """A label's lines: words fill lines of at most ``most`` bytes, line breaks stay, and a fifth line and more are cut."""

    def lines(chunk: Column) -> Column:
        words = F.filter(F.split(chunk, r"[\p{IsWhite_Space}]+"), lambda w: w != "")
        parts = F.flatten(F.transform(words, lambda w: _split_word(w, most)))
        return F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: _put(done, F.concat(F.element_at(done, -1), F.lit(" "), p), p, most))

    def cut(found: Column) -> Column:
        last = F.concat(F.element_at(_split_word(F.get(found, F.lit(LINES - 1)), most - 3), 1), F.lit("..."))
        return F.when(F.size(found) == 0, F.array(label)).when(F.size(found) <= LINES, found).otherwise(F.concat(F.slice(found, 1, LINES - 1), F.array(last)))

    return let(F.flatten(F.transform(F.split(label, "\n"), lines)), cut)


def placed(nodes: DataFrame, colour: DataFrame) -> DataFrame:
    """Nodes with id, shape, color, object_type, x, y, width, height and lines.

    A node's layer is twice its mean place in lifecycles, rounded; layers are columns, without gaps, and in a layer the
    most frequent node is on top. Layers stand around the middle of the highest one, every other one a little lower.
    """
    boundary = F.col("kind").isin("start", "end")
    rows = nodes.withColumn("object_type", F.when(boundary, F.regexp_replace("label", r"(?s)^[^\n]*\n", "")))
    rows = rows.join(colour.withColumnRenamed("color", "typed"), "object_type", "left")
    shape = F.when(boundary, "ellipse").otherwise("rect")
    lines = wrapped(F.col("label"), F.when(boundary, LONGEST["ellipse"]).otherwise(LONGEST["rect"]))
    width = F.when(boundary, WIDTHS["start"]).when(F.col("kind") == "state_change", WIDTHS["state_change"]).otherwise(WIDTHS[None])
    rows = rows.select("label", "kind", shape.alias("shape"), F.coalesce("typed", F.lit(PLAIN)).alias("color"), "object_type", "count", F.floor(F.col("avg_order") * 2 + 0.5).alias("layer"), width.alias("width"), lines.alias("lines"))
    inside = Window.partitionBy("layer").orderBy(F.desc("count"), "label")
    rows = rows.withColumn("row", F.row_number().over(inside) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("layer")))
    everything = Window.partitionBy(F.lit(0))  # a graph's nodes
    rows = rows.withColumn("highest", F.max("n").over(everything)).withColumn("at", F.dense_rank().over(everything.orderBy("layer")) - 1)
    number = F.row_number().over(everything.orderBy("at", "row"))
    wave = F.when((F.col("at") % 2 == 1) & (F.col("n") > 1), GAP_Y * 0.12).otherwise(0.0)
    x = F.lit(MARGIN) + F.col("at") * GAP_X
    y = F.lit(MARGIN) + (F.col("highest") - F.col("n")) * GAP_Y / 2 + wave + F.col("row") * GAP_Y
    height = F.greatest(F.lit(FIRST_LINE) + (F.size("lines") - 1) * LINE, F.lit(LEAST_HEIGHT))
    return rows.select(F.concat(F.lit("n"), number).alias("id"), "label", "kind", "shape", "color", "object_type", "count", x.alias("x"), y.alias("y"), "width", height.alias("height"), "lines", F.col("highest").alias("_rows"))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def routed(edges: DataFrame, nodes: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges with id, points, path, label_x and label_y: from a side of the source to a side of the target, around the
    node for loops; edges of several types between two nodes run side by side, in the order of the types."""
    end = lambda which: nodes.select(F.col("label").alias(which), F.struct("id", "x", "y", "width", "height").alias(which[0]))
    rows = edges.join(end("source"), "source").join(end("target"), "target").join(colour, "object_type", "left")
    beside = Window.partitionBy("source", "target")
    lane = (F.row_number().over(beside.orderBy("object_type")) - 1 - (F.count(F.lit(1)).over(beside) - 1) / 2.0) * LANE
    rows = rows.withColumn("lane", lane)
    s, t, lane = F.col("s"), F.col("t"), F.col("lane")
    middle = lambda n: n["y"] + n["height"] / 2
    ahead = s["x"] + s["width"] <= t["x"]
    x1, x2 = F.when(ahead, s["x"] + s["width"]).otherwise(s["x"]), F.when(ahead, t["x"]).otherwise(t["x"] + t["width"])
    half = (x1 + x2) / 2
    across = F.array(_point(x1, middle(s)), _point(half, middle(s) + lane), _point(half, middle(t) + lane), _point(x2, middle(t)))
    right = s["x"] + s["width"]
    loop = F.array(_point(right, middle(s)), _point(right + 44, middle(s) - 42 + lane), _point(s["x"] + s["width"] / 2, s["y"] - 28 + lane), _point(s["x"], middle(s) - 16))
    rows = rows.withColumn("points", F.when(s["id"] == t["id"], loop).otherwise(across))
    p = lambda i, c: F.col("points")[i][c]
    path = F.format_string("M %.1f %.1f C %.1f %.1f %.1f %.1f %.1f %.1f", *[p(i, c) for i in range(4) for c in ("x", "y")])
    order = [F.desc("weight"), F.col("s.id"), F.col("t.id"), F.col("object_type")]
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # a graph's edges
    return rows.select(
        F.concat(F.lit("e"), number).alias("id"), F.col("s.id").alias("source"), F.col("t.id").alias("target"), F.lit("df").alias("kind"), path.alias("path"),
        F.col("weight").cast("string").alias("label"), F.concat("object_type", F.lit(": "), "weight").alias("title"), "weight", "object_type", "color", F.lit(True).alias("directed"), "points",
        ((p(1, "x") + p(2, "x")) / 2).alias("label_x"), ((p(1, "y") + p(2, "y")) / 2 - 6).alias("label_y"), F.array(F.struct("object_type", "weight")).alias("object_types"),
    )


def layout(graph: Graph, colour: DataFrame) -> Layout:
    colour = written(colour, "colours")
    nodes = written(placed(graph.nodes, colour), "places")  # once for both ends of the edges
    size = nodes.agg(F.greatest(F.coalesce(F.max(F.col("x") + F.col("width") + MARGIN), F.lit(0.0)), F.lit(720.0)).alias("width"), F.greatest(F.coalesce(F.max("_rows"), F.lit(1)) * GAP_Y + MARGIN * 2, F.lit(320.0)).alias("height"))
    nodes = nodes.drop("_rows")
    return Layout(nodes, routed(graph.edges, nodes, colour), size)
