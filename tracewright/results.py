"""Results as documents that executors write: a row of JSON for each element, not one text on the driver.

A document has the columns part, place and json: scalars of a result are one row of the part ``""``, and a list has a row
for each element, in order, under its name. ``write`` puts a document into a folder; ``assemble`` makes one nested
JSON text of a document that is known to be small.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import STATE, EventLog
from .operators import detection, episodes, features, patterns, summary
from .tables import ranked, written

_COLUMNS = ["part", "place", "json"]
_WITH_NULLS = {"ignoreNullFields": "false"}


def exact(c: str | Column, digits: int = 6) -> Column:
    """A double as a decimal number: JSON texts of it have no exponent."""
    return F.round(c, digits).cast(f"decimal(38,{digits})")


def scalars(spark: SparkSession, values: dict) -> DataFrame:
    """The part that holds a result's scalars and lists of scalars."""
    return spark.createDataFrame([("", 0, json.dumps(values, separators=(",", ":"), ensure_ascii=False))], "part string, place long, json string")


def listed(name: str, rows: DataFrame, *order: Column | str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """A list: an element for each row, numbered from 0 in ``order`` over range partitions; ``hidden`` columns only order."""
    shown = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in hidden]), _WITH_NULLS)
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    rows = rows.select(F.lit(name).alias("part"), shown.alias("json"), *keys)
    return ranked(rows, "part", [F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))], "n").select("part", (F.col("n") - 1).cast("long").alias("place"), "json")


def document(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*_COLUMNS))
    return out


def write(found: DataFrame, path: str) -> None:
    """A folder for each part; a line of JSON for each element, files and lines in order."""
    found.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("part", "json").write.partitionBy("part").text(path)


def assemble(found: DataFrame) -> str:
    """One JSON text of a small document."""
    out: dict = {}
    for r in found.orderBy("part", "place").collect():
        out |= json.loads(r["json"]) if r["part"] == "" else {r["part"]: [*out.get(r["part"], []), json.loads(r["json"])]}
    return json.dumps(out)


def pattern_summaries(log: EventLog) -> DataFrame:
    """Patterns of both families with their weighted edges, each a row: df from their sequences, eo and oo from all instances."""
    rows = written(patterns.instances(log), "instances")
    key = F.to_json(F.struct(*patterns.KEY), _WITH_NULLS).alias("key")
    edge = lambda kind: rows.select(key, F.explode(f"{kind}_list").alias("e")).groupBy("key", "e.source", "e.target").agg(F.count(F.lit(1)).alias("weight"))
    held = lambda kind: edge(kind).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("source", "target", "weight"))).alias(f"{kind}_edges"))
    found = patterns.patterns(log, None).withColumn("key", key)
    for kind in ("eo", "oo"):
        found = found.join(held(kind), "key", "left")
    none = F.array().cast("array<struct<source:string,target:string,weight:bigint>>")
    steps = F.transform(F.sequence(F.lit(0), F.size("sequence") - 2), lambda i: F.struct(F.get("sequence", i).alias("source"), F.get("sequence", i + 1).alias("target")))
    counted = F.transform(F.array_sort(F.array_distinct(steps)), lambda s: F.struct(s["source"].alias("source"), s["target"].alias("target"), (F.size(F.filter(steps, lambda t: t == s)) * F.col("support")).alias("weight")))
    types = F.array_sort(F.array_distinct(F.concat(F.array("leading_object_type"), F.transform("eo", lambda e: e["target"]))))
    intra = F.col("family") == "intra"
    return found.select(
        "id", "family", "label", "leading_object_type", F.when(intra, F.col(STATE)).alias("state"), F.when(~intra, F.col(STATE)).alias("from_state"), "to_state", "support", "mass", "sequence",
        types.alias("object_types"), counted.alias("df_edges"), F.coalesce("eo_edges", none).alias("eo_edges"), F.coalesce("oo_edges", none).alias("oo_edges"),
    )


def state_patterns(log: EventLog) -> DataFrame:
    rows = pattern_summaries(log)
    return document(listed("patterns", rows, F.col("support") * -1, F.col("mass") * -1, "label", "id"))


def lifecycle_detail(log: EventLog, object_id: str) -> DataFrame:
    """An object's events with attributes and related objects, its bands of states, stock points and related objects."""
    own = log.objects.filter(F.col("object_id") == object_id).first()
    events = summary.lifecycle_events(log, object_id)
    none = F.array().cast("array<struct<attr_seq:bigint,name:string,value:string>>")
    plain = F.transform(F.coalesce("attributes", none), lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    rows = events.select("pos", "event_id", "event_type", "time_ms", STATE, plain.alias("attributes"), "related_objects")
    span = events.agg(F.count(F.lit(1)), F.min("time_ms"), F.max("time_ms")).first()
    head = {"object_id": object_id, "object_type": own["object_type"], "event_count": span[0], "event_min_ms": span[1], "event_max_ms": span[2]}
    one = log.but(e2o=log.e2o.filter(F.col("object_id") == object_id))
    bands = episodes.state_bands(one).select(STATE, "start_ms", "end_ms", "event_count")
    stock = summary.stock_points(log, object_id).select("name", "time_ms", exact("value").alias("value"), "event_id")
    related = summary.related_objects(log, object_id).select("object_id", "object_type", "qualifier", F.col("count").alias("event_count"))
    spark = log.events.sparkSession
    return document(
        scalars(spark, head), listed("events", rows, "pos", hidden=("pos",)), listed("state_bands", bands, "start_ms", "end_ms", STATE), listed("stock_points", stock, "time_ms", "event_id", "name"),
        listed("related_objects", related, "object_id", "qualifier"),
    )


def time_perspective(log: EventLog, found: dict) -> DataFrame:
    """Buckets with the share of each state, and the chosen transition's performance with its samples."""
    spark = log.events.sparkSession
    share = F.struct(F.col(STATE).alias("state"), exact("percentage").alias("percentage"), "count")
    buckets = found["buckets"].groupBy("bucket", "start_ms", "end_ms", "total").agg(F.array_sort(F.collect_list(share)).alias("percentages"))  # states
    performance = {k: v for k, v in found["performance_head"].items()}
    head = {"object_type": found["object_type"], "event_min_ms": found["event_min_ms"], "event_max_ms": found["event_max_ms"], "states": found["states"], "performance": performance}
    parts = [scalars(spark, head), listed("buckets", buckets.select("start_ms", "end_ms", "total", "percentages"), "start_ms", "end_ms")]
    if found["samples"] is not None:
        samples = found["samples"].select("object_id", "start_time_ms", "middle_time_ms", "end_time_ms", "duration_ms")
        parts.append(listed("samples", samples, "start_time_ms", "duration_ms", "object_id", "middle_time_ms"))
    return document(*parts)


def transition_kpis(log: EventLog, found: dict) -> DataFrame:
    """Transitions, dwell times, recovery and stuck objects, each a list."""
    named = {"min_ms": "min_duration_ms", "median_ms": "median_duration_ms", "max_ms": "max_duration_ms", "total_ms": "total_duration_ms"}
    shape = lambda df: df.withColumn("median_ms", F.col("median_ms").cast("long")).withColumn("avg_duration_ms", exact("avg_ms")).drop("avg_ms").withColumnsRenamed(named)
    head = {k: found[k] for k in ("object_type", "object_count", "stateful_object_count", "state_count", "states")}
    most = F.col("count") * -1
    return document(
        scalars(log.events.sparkSession, head), listed("transitions", shape(found["transitions"]), most, "from_state", "to_state"), listed("dwell_times", shape(found["dwell"]), F.col("total_duration_ms") * -1, STATE),
        listed("recovery_times", shape(found["recovery"]), most, "from_state", "to_state"), listed("stuck_objects", found["stuck"], F.col("duration_ms") * -1, "object_id"),
    )


def state_correlations(log: EventLog, found: dict) -> DataFrame:
    numbers = ("correlation", "strength", "mean_in_state", "mean_outside_state")
    rows = found["rows"].withColumns({c: exact(c) for c in numbers})
    head = {k: found[k] for k in ("object_type", "object_count", "stateful_object_count", "state_count", "feature_count")}
    return document(scalars(log.events.sparkSession, head), listed("state_distribution", found["state_distribution"], STATE), listed("rows", rows, F.col("strength") * -1, "feature"))


def _preview(log: EventLog, object_type: str) -> tuple[list[str], DataFrame]:
    """Names of a type's features, and its first 15 objects with their values as a list."""
    table = features.feature_table(log, object_type)
    columns = table.columns[1:]
    values = F.array(*[exact(f"`{c}`") for c in columns]) if columns else F.array().cast("array<decimal(38,6)>")
    first = table.join(log.objects.select("object_id", "object_seq"), "object_id").orderBy("object_seq").limit(15).select("object_seq", "object_id", values.alias("values"))
    return columns, listed("table_preview", first, "object_seq", hidden=("object_seq",))


def causal_feature_table(log: EventLog, object_type: str) -> DataFrame:
    """Counts, names of columns, and the first 15 objects with their values."""
    columns, rows = _preview(log, object_type)
    count = log.objects.filter(F.col("object_type") == object_type).count()
    return document(scalars(log.events.sparkSession, {"object_type": object_type, "object_count": count, "feature_count": len(columns), "feature_columns": columns}), rows)


def _cells(found: detection.Detection, colour: str | None) -> DataFrame:
    return written(detection.cells(found, colour), "cells").withColumns({c: exact(c) for c in ("color_value", "avg_pc1", "avg_pc2")})


def state_detection(found: detection.Detection, window_size: int, colour: str | None = None) -> DataFrame:
    """Counts, components, ways to colour, the first objects' features, the map's cells and moves, the first 500 windows."""
    columns, preview = _preview(found.log, found.object_type)
    objects, windows = found.points.agg(F.countDistinct("object_id"), F.count(F.lit(1))).first()
    six = lambda x: round(x, 6) + 0.0
    head = {
        "object_type": found.object_type, "window_size": window_size, "som_width": found.width, "som_height": found.height, "color_attribute": colour, "object_count": objects, "feature_count": len(found.columns),
        "window_count": windows, "feature_columns": found.columns, "table_columns": columns,
        "pca": {"pc1_variance": six(found.variances[0]), "pc2_variance": six(found.variances[1]), "pc1_explained_ratio": six(found.ratios[0]), "pc2_explained_ratio": six(found.ratios[1])},
    }
    options = detection.colour_options(found.log, found.object_type).withColumn("first", F.col("kind") != "count")
    shown = detection.projected_windows(found).withColumns({c: exact(c) for c in ("pc1", "pc2")})
    return document(
        scalars(found.log.events.sparkSession, head), preview, listed("color_options", options, "first", "label", hidden=("first",)), listed("cells", _cells(found, colour), "y", "x"),
        listed("transitions", detection.transitions(found), F.col("count") * -1, "distance", "source_y", "source_x", "target_y", "target_x"),
        listed("windows", shown, "object_seq", "start", hidden=("object_seq", "start")),
    )


def detection_cell(found: detection.Detection, x: int, y: int, colour: str | None = None) -> DataFrame:
    """A cell; the first 100 windows that enter and that leave it, with their full numbers; the graphs of its own windows
    and of both kinds."""
    counts = {r["direction"]: r["count"] for r in detection.boundary_windows(found, x, y).groupBy("direction").count().collect()}
    around = written(detection.boundary_details(found, x, y, 100).withColumns({c: exact(c) for c in ("pc1", "pc2")}), "around")
    parts = [scalars(found.log.events.sparkSession, {f"{d}_count": counts.get(d, 0) for d in ("entering", "exiting")}), listed("cell", _cells(found, colour).filter((F.col("x") == x) & (F.col("y") == y)), "x")]
    shown = ["object_id", "start_event", "end_event", "source_cell", "target_cell", "pc1", "pc2", "activities", "object_seq", "start"]
    for d in ("entering", "exiting"):
        parts.append(listed(f"{d}_windows", around.filter(F.col("direction") == d).select(*shown), "object_seq", "start", hidden=("object_seq", "start")))
    drawn = {"graph": detection.cell_graph(found, x, y)} | {f"{d}_graph": detection.boundary_graph(found, x, y, d) for d in ("entering", "exiting")}
    for name, graph in drawn.items():
        parts += [listed(f"{name}_nodes", graph.nodes.select("label", "kind", "count"), "kind", "label"), listed(f"{name}_edges", graph.edges.select("source", "target", "weight"), F.col("weight") * -1, "source", "target")]
    return document(*parts)


def causal_fit(order: list[features.CausalNode], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A fitted model's nodes, in the order of the request, and its edges."""
    at = F.array_position(F.array(*[F.lit(n.id) for n in order]), F.col("id")).alias("at")
    nodes = nodes.select(at, "id", "label", "role", "feature", "operation", exact("mean").alias("mean"), exact("std_dev").alias("std_dev"))
    edges = edges.withColumns({c: exact(c) for c in ("correlation", "intensity", "p_value")})
    return document(listed("nodes", nodes, "at", hidden=("at",)), listed("edges", edges, "source", "target"))


def filter_options(log: EventLog, found: dict) -> DataFrame:
    """Types in the order of the log, the first texts of each attribute, bounds of time and a histogram."""
    named = lambda kind: listed(kind, found[kind], "type_seq", "type_name", hidden=("type_seq",))
    texts = found["text_attributes"].groupBy("scope", "name").agg(F.array_sort(F.collect_list("value")).alias("values"))  # 200 at most
    buckets = found["time_buckets"].select("start_ms", "end_ms", "count", "bucket")
    head = {k: found[k] for k in ("time_min_ms", "time_max_ms")}
    return document(scalars(log.events.sparkSession, head), named("event_types"), named("object_types"), listed("text_attributes", texts, "scope", "name"), listed("time_buckets", buckets, "bucket", hidden=("bucket",)))
