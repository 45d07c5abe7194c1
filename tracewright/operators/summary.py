"""Counts of a log, the choices that filters offer, and looking up objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_lower
from ..functions.stats import numeric_value, value_label
from ..model import STATE, EventLog, LogError, lifecycle


def summary(log: EventLog) -> DataFrame:
    """One row of counts."""
    count = lambda df, *cols: df.select(*cols).distinct() if cols else df
    parts = {
        "event_types": count(log.event_types, "type_name"), "object_types": count(log.object_types, "type_name"), "events": log.events, "objects": log.objects,
        "e2o_relationships": log.e2o, "o2o_relationships": log.o2o, "objects_with_lifecycle": count(log.e2o, "object_id"),
        "stateful_events": count(log.event_attrs.filter(F.col("name") == STATE), "event_seq"),
    }
    rows = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in parts])


def events_with_attribute(log: EventLog, name: str) -> int:
    return log.event_attrs.filter(F.col("name") == name).select("event_seq").distinct().count()


def text_attribute_options(log: EventLog, limit: int = 200) -> DataFrame:
    """scope, name, value: the first ``limit`` distinct string values of each attribute, by value."""
    text = F.col("attr_type") == "string"
    rows = log.event_attrs.filter(text).select(F.lit("event").alias("scope"), "name", F.col("v_string").alias("value"))
    rows = rows.unionByName(log.object_attrs.filter(text).select(F.lit("object").alias("scope"), "name", F.col("v_string").alias("value"))).distinct()
    order = Window.partitionBy("scope", "name").orderBy("value")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def time_histogram(log: EventLog, buckets: int = 32) -> DataFrame:
    """bucket, start_ms, end_ms, count over equal widths from the first to the last event, empty ones included."""
    events = log.events.select("time_ms")
    lo, hi = events.agg(F.min("time_ms"), F.max("time_ms")).first()
    spark = log.events.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bucket long, start_ms long, end_ms long, count long")
    span = float(max(hi - lo, 1))
    at = F.least(F.floor((F.col("time_ms") - lo) / F.lit(span) * buckets), F.lit(buckets - 1)).cast("long")
    counts = events.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    edge = lambda i: (F.lit(lo) + F.round(F.lit(span / buckets) * i)).cast("long")
    grid = spark.range(buckets).select(F.col("id").alias("bucket"), edge(F.col("id")).alias("start_ms"), F.when(F.col("id") == buckets - 1, F.lit(hi)).otherwise(edge(F.col("id") + 1)).alias("end_ms"))
    return grid.join(counts, "bucket", "left").select("bucket", "start_ms", "end_ms", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def object_search(log: EventLog, text: str = "", object_type: str | None = None, limit: int = 30) -> DataFrame:
    """object_id, object_type, event_count of the first objects whose id holds ``text``; an unknown type is ignored."""
    limit = min(max(limit, 1), 200)
    rows = log.objects.filter(ascii_lower("object_id").contains(text.translate(str.maketrans(UPPER, LOWER))))
    if object_type is not None and object_type in log.object_type_names():
        rows = rows.filter(F.col("object_type") == object_type)
    rows = rows.orderBy("object_seq").limit(limit)
    counts = log.e2o.join(F.broadcast(rows.select("object_id")), "object_id", "left_semi").groupBy("object_id").agg(F.count(F.lit(1)).alias("event_count"))  # at most 200 rows
    return rows.join(counts, "object_id", "left").select("object_id", "object_type", F.coalesce("event_count", F.lit(0).cast("long")).alias("event_count"))


def _one(log: EventLog, object_id: str) -> EventLog:
    if log.objects.filter(F.col("object_id") == object_id).isEmpty():
        raise LogError(f"unknown object '{object_id}'")
    return log.but(e2o=log.e2o.filter(F.col("object_id") == object_id))


def object_lifecycle(log: EventLog, object_id: str) -> list[str]:
    """Event ids of one object, in order."""
    return [r[0] for r in lifecycle(_one(log, object_id)).orderBy("pos").select("event_id").collect()]


def lifecycle_events(log: EventLog, object_id: str) -> DataFrame:
    """The events of one object with their attributes (name, value as text) and the other objects that each names
    (object_id, object_type, qualifier, in the order of its relations)."""
    one = _one(log, object_id)
    rows = lifecycle(one, True)
    own = one.e2o.select("event_seq").distinct()
    attrs = log.event_attrs.join(own, "event_seq", "left_semi").groupBy("event_seq").agg(F.array_sort(F.collect_list(F.struct("attr_seq", "name", value_label().alias("value")))).alias("attributes"))
    others = log.e2o.join(own, "event_seq", "left_semi").filter(F.col("object_id") != object_id).join(log.objects.select("object_id", "object_type"), "object_id")
    others = others.groupBy("event_seq").agg(F.array_sort(F.collect_list(F.struct("rel_seq", "object_id", "object_type", "qualifier"))).alias("others"))
    none = F.array().cast("array<struct<rel_seq:bigint,object_id:string,object_type:string,qualifier:string>>")
    related = F.transform(F.coalesce("others", none), lambda r: r.dropFields("rel_seq"))
    return rows.join(attrs, "event_seq", "left").join(others, "event_seq", "left").withColumn("related_objects", related).drop("others")


def related_objects(log: EventLog, object_id: str) -> DataFrame:
    """object_id, object_type, qualifier, count of the other objects in one object's events."""
    own = _one(log, object_id).e2o.select("event_seq").distinct()
    rows = log.e2o.join(own, "event_seq", "left_semi").filter(F.col("object_id") != object_id)
    return rows.join(log.objects, "object_id").groupBy("object_id", "object_type", "qualifier").agg(F.count(F.lit(1)).alias("count"))


def stock_points(log: EventLog, object_id: str) -> DataFrame:
    """event_id, time_ms, name, value of numeric event attributes whose name holds ``stock``."""
    rows = lifecycle(_one(log, object_id))
    attrs = log.event_attrs.filter(ascii_lower("name").contains("stock") & F.col("attr_type").isin("integer", "float"))
    return rows.join(attrs.select("event_seq", "name", numeric_value().alias("value")), "event_seq").filter("value IS NOT NULL").select("event_id", "time_ms", "name", "value")
