"""One log and its filter: every endpoint of the engine in one place."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results
from .model import EventLog, LogError, event_states, stateful_lifecycle
from .operators import detection, episodes, features, filters, graphs, layout, patterns, summary
from .plans import stateql
from .requests import decode
from .sources import documents, export


def as_json(result) -> str:
    """An endpoint's result as JSON: tables become lists of rows, graphs their nodes and edges. For results of a bounded size."""

    def plain(x):
        if isinstance(x, DataFrame):
            return [json.loads(r) for r in x.toJSON().collect()]
        if isinstance(x, graphs.Graph):
            return {"nodes": plain(x.nodes), "edges": plain(x.edges)}
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list | tuple) else x

    return json.dumps(plain(result))


class LogSession:
    """The original log, the filter on it, and the active log that follows from both.

    States are written to the original log, so they outlive changes of the filter.
    """

    def __init__(self, log: EventLog):
        self.original, self.filter = log, filters.LogFilter()
        self._active: EventLog | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str, hint: str | None = None) -> LogSession:
        return cls(documents.read_log(spark, path, hint))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: str | bytes, hint: str | None = None) -> LogSession:
        return cls(documents.read_text(spark, data, hint))

    @property
    def active(self) -> EventLog:
        if self._active is None:
            self._active = filters.apply_filter(self.original, self.filter)
        return self._active

    def _stateful(self) -> EventLog:
        if event_states(self.active).isEmpty():
            raise LogError("no event has a state yet; apply a state query or a detection")
        return self.active

    def summary(self) -> DataFrame:
        return summary.summary(self.active)

    def original_summary(self) -> DataFrame:
        return summary.summary(self.original)

    def filter_options(self) -> dict:
        log = self.original
        return {
            "event_types": log.event_types.select("type_name", "type_seq").distinct(), "object_types": log.object_types.select("type_name", "type_seq").distinct(),
            "text_attributes": summary.text_attribute_options(log), "time_buckets": summary.time_histogram(log, 32),
            **dict(zip(("time_min_ms", "time_max_ms"), log.events.agg(F.min("time_ms"), F.max("time_ms")).first(), strict=True)),
        }

    def apply_filter(self, chosen: filters.LogFilter | dict | str) -> DataFrame:
        """Filter by a LogFilter, or by a request as a dict or as JSON."""
        if isinstance(chosen, dict | str):
            chosen = filters.LogFilter.of_request(decode("apply_filter", chosen))
        self.filter, self._active = chosen, None
        return self.summary()

    def export_json(self) -> str:
        return export.export_json(self.active)

    def export_xml(self) -> str:
        return export.export_xml(self.active)

    def object_lifecycle(self, object_id: str) -> list[str]:
        return summary.object_lifecycle(self.active, object_id)

    def object_lifecycle_detail(self, object_id: str) -> dict[str, DataFrame]:
        log = self.active
        one = log.but(e2o=log.e2o.filter(F.col("object_id") == object_id))
        return {
            "events": summary.lifecycle_events(log, object_id), "state_bands": episodes.state_bands(one),
            "stock_points": summary.stock_points(log, object_id), "related_objects": summary.related_objects(log, object_id),
        }

    def object_search(self, text: str = "", object_type: str | None = None, limit: int = 30) -> DataFrame:
        return summary.object_search(self.active, text, object_type, limit)

    def _applied(self, attribute: str) -> dict:
        log = self.active
        assigned = summary.events_with_attribute(log, attribute)
        return {"attribute": attribute, "leading_object_type": self.original.leading_object_type, "assigned_events": assigned, "total_events": log.events.count()}

    def apply_state_query(self, text: str) -> dict:
        self.original, self._active = stateql.apply_state_query(self.original, text), None
        return self._applied(stateql.parse(text).attribute)

    def apply_state_detection(self, object_type: str, **how) -> dict:
        labels = detection.event_labels(detection.detect(self.active, object_type, **how))
        self.original, self._active = stateql.write_states(self.original, "state", object_type, labels), None
        return self._applied("state")

    def state_detection(self, object_type: str, **how) -> detection.Detection:
        return detection.detect(self.active, object_type, **how)

    def state_detection_result(self, found: detection.Detection, colour: str | None = None) -> dict:
        """What a detection found: figures, the map's cells and moves, and the first rows and windows."""
        table = features.feature_table(found.log, found.object_type)
        return {
            "object_type": found.object_type, "som_width": found.width, "som_height": found.height, "colors": detection.colour_options(found.log, found.object_type),
            "object_count": found.windows.select("object_id").distinct().count(), "window_count": found.points.count(), "feature_columns": found.columns, "feature_count": len(found.columns),
            "pca": {"pc1_variance": found.variances[0], "pc2_variance": found.variances[1], "pc1_explained_ratio": found.ratios[0], "pc2_explained_ratio": found.ratios[1]},
            "table_preview": features.preview(table), "cells": detection.cells(found, colour), "transitions": detection.transitions(found), "windows": detection.projected_windows(found).drop("object_seq", "start"),
        }

    def state_detection_cell(self, found: detection.Detection, x: int, y: int, colour: str | None = None) -> dict:
        if not (0 <= x < found.width and 0 <= y < found.height):
            raise LogError(f"no cell {x}, {y}")
        around = detection.boundary_details(found, x, y, 100).drop("object_seq")
        counts = {r["direction"]: r["count"] for r in detection.boundary_windows(found, x, y).groupBy("direction").count().collect()}
        return {
            "cell": detection.cells(found, colour).filter(f"x = {x} AND y = {y}"), "graph": detection.cell_graph(found, x, y), "boundary": around,
            "entering_graph": detection.boundary_graph(found, x, y, "entering"), "exiting_graph": detection.boundary_graph(found, x, y, "exiting"),
            "entering_count": counts.get("entering", 0), "exiting_count": counts.get("exiting", 0),
        }

    def state_patterns(self) -> DataFrame:
        return patterns.explorer(self._stateful())

    def state_correlations(self) -> dict:
        """Correlations by strength, with the objects and dominant states that they rest on."""
        log = self._stateful()
        kind = episodes.resolve_object_type(log, log.leading_object_type)
        spread = episodes.dominant_states(log, kind).groupBy("state").agg(F.count(F.lit(1)).alias("count"))
        n, states = spread.agg(F.sum("count"), F.count(F.lit(1))).first()
        if not n:
            raise LogError(f"no object of type '{kind}' has a state")
        rows = features.state_correlations(log, kind).orderBy(F.desc("strength"), "feature")
        own = log.objects.filter(F.col("object_type") == kind).count()
        return {"object_type": kind, "object_count": own, "stateful_object_count": n, "state_count": states, "feature_count": rows.count(), "state_distribution": spread, "rows": rows}

    @staticmethod
    def _counts(log: EventLog, kind: str) -> dict:
        own = log.objects.filter(F.col("object_type") == kind)
        states = stateful_lifecycle(log, kind).agg(F.countDistinct("object_id").alias("n"), F.sort_array(F.collect_set("state")).alias("s")).first()  # names of states
        return {"object_count": own.count(), "stateful_object_count": states["n"], "state_count": len(states["s"]), "states": states["s"]}

    def time_perspective(self, object_type: str | None = None, from_state: str | None = None, to_state: str | None = None, roundtrip: bool = False, buckets: int = 24) -> dict:
        log = self._stateful()
        kind = episodes.resolve_object_type(log, object_type)
        usual = episodes.most_frequent_transition(log, kind) or (None, None)
        states = sorted(r[0] for r in event_states(log).select("state").distinct().collect())
        start = from_state or usual[0] or states[0]
        end = (to_state if to_state != start else None) or (usual[1] if usual[1] != start else None) or next((s for s in states if s != start), None)
        lo, hi = log.events.agg(F.min("time_ms"), F.max("time_ms")).first()
        out = {"object_type": kind, "event_min_ms": lo, "event_max_ms": hi, "states": states, "buckets": episodes.time_buckets(log, buckets), "from_state": start if end else "", "to_state": end or "", "roundtrip": roundtrip}
        chosen = (log, kind, start, end, roundtrip)
        none = log.events.sparkSession.createDataFrame([(0, None, None, None, None)], "sample_count long, min_ms long, median_ms long, avg_ms double, max_ms long")
        return out | {"performance": episodes.performance_spectrum(*chosen) if end else none, "samples": episodes.performance_samples(*chosen) if end else None}

    def state_transition_kpis(self, object_type: str | None = None, stuck_limit: int = 15) -> dict:
        log = self._stateful()
        kind = episodes.resolve_object_type(log, object_type)
        return {"object_type": kind, **self._counts(log, kind), "transitions": episodes.transition_kpis(log, kind), "dwell": episodes.dwell_kpis(log, kind), "recovery": episodes.recovery(log, kind), "stuck": episodes.stuck(log, kind, stuck_limit)}

    def feature_table(self, object_type: str) -> DataFrame:
        return features.feature_table(self.active, object_type)

    def feature_table_csv(self, object_type: str, path: str) -> None:
        features.write_csv(self.feature_table(object_type), path)

    def fit_causal_model(self, object_type: str, nodes, edges) -> tuple[DataFrame, DataFrame]:
        return features.fit_causal_model(self.active, object_type, nodes, edges)

    def directly_follows_graph(self, object_type: str) -> graphs.Graph:
        return graphs.dfg(self.active, object_type)

    def object_centric_graph(self, **how) -> graphs.Graph:
        return graphs.oc_dfg(self.active, **how)

    def state_aware_graph(self, **how) -> graphs.Graph:
        return graphs.state_aware_oc_dfg(self._stateful(), **how)

    def object_centric_layout(self, **how) -> layout.Layout:
        return layout.layout(self.object_centric_graph(**how), layout.colours(self.active, how.get("object_types")))

    def state_aware_layout(self, **how) -> layout.Layout:
        return layout.layout(self.state_aware_graph(**how), layout.colours(self.active, how.get("object_types"), True))

    def answer(self, endpoint: str, request: dict | str | None = None) -> DataFrame:
        """A request's result as a document (part, place, json), written by executors where it is long."""
        how = decode(endpoint, request)
        log = self.active
        if endpoint == "state_patterns":
            return results.state_patterns(self._stateful())
        if endpoint == "object_lifecycle_detail":
            return results.lifecycle_detail(log, how["object_id"])
        if endpoint == "time_perspective":
            found = self.time_perspective(**how)
            row = found["performance"].first()
            stats = {"sample_count": row["sample_count"], "min_duration_ms": row["min_ms"], "median_duration_ms": row["median_ms"] if row["median_ms"] is None else int(row["median_ms"]), "avg_duration_ms": row["avg_ms"], "max_duration_ms": row["max_ms"]}
            head = {"object_type": found["object_type"], "from_state": found["from_state"], "to_state": found["to_state"], "roundtrip": found["roundtrip"], **stats}
            return results.time_perspective(log, found | {"performance_head": head})
        if endpoint == "state_transition_kpis":
            return results.transition_kpis(log, self.state_transition_kpis(**how))
        if endpoint == "state_correlations":
            return results.state_correlations(log, self.state_correlations())
        if endpoint == "causal_feature_table":
            return results.causal_feature_table(log, how["object_type"])
        spark = log.events.sparkSession
        if endpoint == "object_search":
            hits = self.object_search(how["query"].strip(), how["object_type"], how["limit"]).join(log.objects.select("object_id", "object_seq"), "object_id")
            return results.document(results.listed("objects", hits, "object_seq", hidden=("object_seq",)))
        if endpoint in ("state_detection", "state_detection_cell"):
            found = self.state_detection(how["object_type"], size=how["window_size"], width=how["som_width"], height=how["som_height"], epochs=how["epochs"])
            if endpoint == "state_detection":
                return results.state_detection(found, how["window_size"], how["color_attribute"])
            if not (how["cell_x"] < found.width and how["cell_y"] < found.height):
                raise LogError(f"no cell {how['cell_x']}, {how['cell_y']}")
            return results.detection_cell(found, how["cell_x"], how["cell_y"], how["color_attribute"])
        if endpoint == "fit_causal_model":
            nodes = [features.CausalNode(n["id"], n["role"], n["feature"], n["operation"] or "identity", n["label"]) for n in how["nodes"]]
            return results.causal_fit(nodes, *self.fit_causal_model(how["object_type"], nodes, [(e["source"], e["target"]) for e in how["edges"]]))
        if endpoint == "filter_options":
            return results.filter_options(self.original, self.filter_options())
        if endpoint in ("object_centric_graph", "state_aware_graph", "directly_follows_graph"):
            if endpoint == "directly_follows_graph":
                found = layout.layout(self.directly_follows_graph(how["object_type"]), layout.colours(log, [how["object_type"]]))
            else:
                drawn = self.object_centric_layout if endpoint == "object_centric_graph" else self.state_aware_layout
                found = drawn(object_types=how["object_types"], min_activity=how["min_activity_frequency"], min_path=how["min_path_frequency"])
            number = F.substring("id", 2, 20).cast("long")
            size = found.size.first()
            return results.document(results.scalars(spark, size.asDict()), results.listed("nodes", found.nodes, number), results.listed("edges", found.edges, number))
        if endpoint == "summary":
            return results.scalars(spark, {"source_format": log.source_format, **self.summary().first().asDict()})
        raise LogError(f"'{endpoint}' has no document; call the method of that name")
