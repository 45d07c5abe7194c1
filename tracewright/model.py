"""The event log: eight immutable DataFrames, and the lifecycles derived from them.

Sequence columns (``event_seq``, ``object_seq``, ``rel_seq``, ``attr_seq``) hold the order of the source document;
every tie is broken by them, as rows of a DataFrame have no order of their own. Attribute values are long tables
with one column for each of the five types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = "state"
VALUES = ["v_string", "v_int", "v_float", "v_bool", "v_time_ms"]
_V = "attr_type string, v_string string, v_int long, v_float double, v_bool boolean, v_time_ms long"

SCHEMAS = {
    "event_types": "type_name string, type_seq long, attr_name string, attr_type string, attr_seq long",
    "object_types": "type_name string, type_seq long, attr_name string, attr_type string, attr_seq long",
    "events": "event_id string, event_type string, time_ms long, event_seq long",
    "event_attrs": f"event_id string, event_seq long, attr_seq long, name string, {_V}",
    "e2o": "event_id string, event_seq long, rel_seq long, object_id string, qualifier string",
    "objects": "object_id string, object_type string, object_seq long",
    "object_attrs": f"object_id string, attr_seq long, name string, time_ms long, {_V}",
    "o2o": "source_id string, rel_seq long, target_id string, qualifier string",
}


class LogError(ValueError):
    """A log or a request that can't be used, with the reason."""


@dataclass(frozen=True)
class EventLog:
    event_types: DataFrame
    object_types: DataFrame
    events: DataFrame
    event_attrs: DataFrame
    e2o: DataFrame
    objects: DataFrame
    object_attrs: DataFrame
    o2o: DataFrame
    source_format: str = "json"
    leading_object_type: str | None = None
    #: What a source may know without joining the tables, dealt by object_id: ``lifecycle`` of a type, or of all, and
    #: (object_id, other, type) of the objects related to those of a type. None: the tables are joined.
    lives: Callable[[str | None], DataFrame] | None = None
    met: Callable[[str], DataFrame | None] | None = None

    def but(self, **changes) -> EventLog:
        known = {} if changes.keys().isdisjoint(("events", "e2o", "objects", "o2o")) else {"lives": None, "met": None}
        return replace(self, **(known | changes))

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    def write(self, path: str) -> None:
        """The eight tables as Parquet under ``path``: the sink for large logs."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str, **more) -> EventLog:
        return cls(**{name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in SCHEMAS.items()}, **more)

    def object_type_names(self) -> list[str]:
        """Declared object types, in order of declaration."""
        rows = self.object_types.select("type_name", "type_seq").distinct().orderBy("type_seq").collect()
        return [r[0] for r in rows]

    def require_type(self, object_type: str) -> str:
        if object_type not in self.object_type_names():
            raise LogError(f"unknown object type '{object_type}'")
        return object_type


def event_states(log: EventLog) -> DataFrame:
    """event_seq and state: the first attribute named ``state`` whose value is a string."""
    rows = log.event_attrs.filter((F.col("name") == STATE) & (F.col("attr_type") == "string"))
    return rows.groupBy("event_seq").agg(F.min_by("v_string", "attr_seq").alias(STATE))


def relations(log: EventLog, object_type: str | None = None) -> DataFrame:
    """One row for each relation of an event to an object. The type filter is applied to objects before the join."""
    if log.lives is not None:
        return log.lives(object_type)
    objects = log.objects if object_type is None else log.objects.filter(F.col("object_type") == object_type)
    events = log.events.select("event_seq", "event_id", "event_type", "time_ms")
    return log.e2o.select("event_seq", "rel_seq", "object_id").join(events, "event_seq").join(objects, "object_id")


def lifecycle(log: EventLog, with_state: bool = False, object_type: str | None = None) -> DataFrame:
    """``relations`` with ``pos``, which counts an object's rows from 0 by time.

    An event that names an object twice is there twice.
    """
    rows = relations(log, object_type)
    columns = ["object_id", "object_type", "object_seq", "event_id", "event_seq", "rel_seq", "event_type", "time_ms"]
    if with_state:
        rows = rows.join(event_states(log), "event_seq", "left")
        columns.append(STATE)
    if log.lives is not None:
        return rows.select(*columns, "pos")
    order = Window.partitionBy("object_id").orderBy("time_ms", "event_seq", "rel_seq")
    return rows.select(*columns, (F.row_number().over(order) - 1).cast("long").alias("pos"))


def stateful_lifecycle(log: EventLog, object_type: str | None = None) -> DataFrame:
    """Lifecycle rows that have a state, counted anew: those without one are skipped, not breaks."""
    rows = lifecycle(log, True, object_type).filter(F.col(STATE).isNotNull())
    order = Window.partitionBy("object_id").orderBy("pos")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
