"""The log filter: a new log of the chosen events, objects and relations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import value_label
from ..model import EventLog, lifecycle
from .patterns import objects_with_pattern


@dataclass(frozen=True)
class LogFilter:
    """All parts must hold. Empty lists of types mean all; bounds of time are inclusive."""

    event_types: list[str] = field(default_factory=list)
    object_types: list[str] = field(default_factory=list)
    start_ms: int | None = None
    end_ms: int | None = None
    df_nodes: list[str] = field(default_factory=list)
    df_edges: list[tuple[str, str]] = field(default_factory=list)
    text_attributes: list[dict] = field(default_factory=list)  # scope, name, values
    patterns: list[dict] = field(default_factory=list)  # arguments of objects_with_pattern

    @classmethod
    def of_request(cls, request: dict) -> LogFilter:
        """A filter from a request as it comes in JSON: missing parts mean no restriction."""
        span = request.get("time_range") or {}
        pairs = lambda found: [(e["source"], e["target"]) for e in found or []]
        return cls(
            list(request.get("event_types") or []), list(request.get("object_types") or []), span.get("start_ms"), span.get("end_ms"), list(request.get("df_nodes") or []), pairs(request.get("df_edges")),
            [{"scope": t.get("scope", "event"), "name": t["name"], "values": list(t.get("values") or [])} for t in request.get("text_attributes") or []],
            [
                {"family": p.get("family") or "intra", "state": p.get("state") or p.get("from_state"), "to_state": p.get("to_state"), "sequence": list(p.get("sequence") or []), "eo": pairs(p.get("eo_edges")), "oo": pairs(p.get("oo_edges"))}
                for p in request.get("patterns") or []
            ],
        )

    def about_objects(self) -> bool:
        return bool(self.df_nodes or self.df_edges or self.patterns or any(t.get("values") for t in self.text_attributes))


def normal_range(start: int | None, end: int | None, lo: int, hi: int) -> tuple[int | None, int | None]:
    """Bounds the right way round, without those that the log itself has."""
    if start is not None and end is not None and start > end:
        start, end = end, start
    return (None if start is None or start <= lo else start), (None if end is None or end >= hi else end)


def matching_objects(log: EventLog, chosen: LogFilter) -> DataFrame:
    """object_id, object_type of the objects that pass: types, and what their whole lifecycles hold."""
    objects = log.objects.select("object_id", "object_type")
    if chosen.object_types:
        objects = objects.filter(F.col("object_type").isin(chosen.object_types))
    nodes, edges = sorted(set(chosen.df_nodes)), sorted(set(map(tuple, chosen.df_edges)))
    if nodes or edges:
        order = Window.partitionBy("object_id").orderBy("pos")
        rows = lifecycle(log).select("object_id", "event_type", F.lead("event_type").over(order).alias("next")) if edges else log.e2o.select("object_id", "event_seq").join(log.events, "event_seq")
        tests = [F.max(F.col("event_type") == a) for a in nodes] + [F.max((F.col("event_type") == a) & (F.col("next") == b)) for a, b in edges]
        found = rows.groupBy("object_id").agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)])
        for i in range(len(tests)):
            found = found.filter(F.col(f"t{i}"))
        objects = objects.join(found.select("object_id"), "object_id", "left_semi")
    for t in chosen.text_attributes:
        if not t.get("values"):
            continue
        own = (F.col("name") == t["name"]) & value_label().isin(list(t["values"]))
        if t.get("scope", "event") == "object":
            hit = log.object_attrs.filter(own).select("object_id")
        else:
            hit = log.e2o.join(log.event_attrs.filter(own).select("event_seq"), "event_seq", "left_semi").select("object_id")
        objects = objects.join(hit.distinct(), "object_id", "left_semi")
    for p in chosen.patterns:
        if log.leading_object_type:
            objects = objects.filter(F.col("object_type") == log.leading_object_type)
        objects = objects.join(objects_with_pattern(log, **p), "object_id", "left_semi")
    return objects


def apply_filter(log: EventLog, chosen: LogFilter) -> EventLog:
    """The filtered log. Always applied to the original one, so filters replace each other.

    Objects that no kept event names go, as do relations and type definitions that lost their use. If all types
    are chosen (by their number) and nothing else is asked for, the log stays as it is.
    """
    declared_e = log.event_types.select("type_name").distinct().count()
    declared_o = log.object_types.select("type_name").distinct().count()
    all_events = not chosen.event_types or len(set(chosen.event_types)) >= declared_e
    all_objects = not chosen.object_types or len(set(chosen.object_types)) >= declared_o
    timed = chosen.start_ms is not None or chosen.end_ms is not None
    if all_events and all_objects and not timed and not chosen.about_objects():
        return log
    events = log.events
    if chosen.event_types:
        events = events.filter(F.col("event_type").isin(chosen.event_types))
    if chosen.start_ms is not None:
        events = events.filter(F.col("time_ms") >= chosen.start_ms)
    if chosen.end_ms is not None:
        events = events.filter(F.col("time_ms") <= chosen.end_ms)
    selected = matching_objects(log, chosen)
    e2o = log.e2o.join(events.select("event_seq"), "event_seq", "left_semi").join(selected.select("object_id"), "object_id", "left_semi")
    e2o = e2o.select(*log.e2o.columns)
    if not all_objects or chosen.about_objects():
        events = events.join(e2o.select("event_seq").distinct(), "event_seq", "left_semi").select(*log.events.columns)
    kept = e2o.select("object_id").distinct()
    objects = log.objects.join(kept, "object_id", "left_semi").select(*log.objects.columns)
    o2o = log.o2o
    for end in ("source_id", "target_id"):
        o2o = o2o.join(kept.withColumnRenamed("object_id", end), end, "left_semi")
    keep = events.select("event_seq")
    return log.but(
        events=events, e2o=e2o, objects=objects, o2o=o2o.select(*log.o2o.columns),
        event_attrs=log.event_attrs.join(keep, "event_seq", "left_semi").select(*log.event_attrs.columns),
        object_attrs=log.object_attrs.join(kept, "object_id", "left_semi").select(*log.object_attrs.columns),
        event_types=log.event_types.join(events.select(F.col("event_type").alias("type_name")).distinct(), "type_name", "left_semi").select(*log.event_types.columns),
        object_types=log.object_types.join(objects.select(F.col("object_type").alias("type_name")).distinct(), "type_name", "left_semi").select(*log.object_types.columns),
    )
