"""OCEL 2.0 documents, JSON and XML, plain or gzipped, to event logs.

A file that is larger than a task's share is cut at byte ranges, and several tasks read it (``split``); a smaller one
is one task's. JSON values keep their scalar kind through ``variant``. Many documents of one log can be given as a
folder or a list: positions go on from file to file in the order of their paths.
"""

from __future__ import annotations

import gzip
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import SCHEMAS, EventLog, LogError
from ..tables import shared_folder, written
from .split import json_elements, largest_file, split_size, xml_elements
from .values import KINDS, coerce, parse_time

_TYPE = "name: string, attributes: array<struct<name: string, type: string>>"
_LINK = "array<struct<objectId: string, qualifier: string>>"
ELEMENTS = {
    "objectTypes": _TYPE, "eventTypes": _TYPE,
    "objects": f"id: string, type: string, attributes: array<struct<name: string, time: string, value: variant>>, relationships: {_LINK}",
    "events": f"id: string, type: string, time: string, attributes: array<struct<name: string, value: variant>>, relationships: {_LINK}",
}
JSON_SCHEMA = ", ".join(f"{k} array<struct<{v}>>" for k, v in ELEMENTS.items())


def detect_format(name: str | None, head: bytes = b"") -> str:
    """``json`` or ``xml``, by a hint or file name, else by the first character that isn't blank."""
    hint = re.sub(r"\.gz$", "", (name or "").strip().lower())
    for kind in ("json", "xml"):
        if hint == kind or hint.endswith((f".{kind}", f".{kind}ocel")) or kind == "json" and hint.endswith(".jsonocel"):
            return kind
    if head[:2] == b"\x1f\x8b":
        head = gzip.decompress(head)
    first = head.decode("utf-8", "replace").lstrip("﻿ \t\r\n")[:1]
    if first in ("{", "<"):
        return "json" if first == "{" else "xml"
    raise LogError("the format is neither JSON nor XML")


def export_base_name(name: str | None) -> str:
    """A file's name without its log suffixes."""
    return re.sub(r"(\.(json|jsonocel|xml|xmlocel))?(\.gz)?$", "", (name or "").rsplit("/", 1)[-1], flags=re.I) or "ocel-export"


def _relations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.posexplode("relationships").alias("rel_seq", "r")).select(*keys, F.col("rel_seq").cast("long"), F.col("r.objectId").alias("object_id"), F.coalesce("r.qualifier", F.lit("")).alias("qualifier"))


def _types(rows: DataFrame) -> DataFrame:
    out = rows.select("type_name", "type_seq", F.posexplode_outer("attributes").alias("attr_seq", "a"))
    return out.select("type_name", "type_seq", F.col("a.name").alias("attr_name"), F.lower(F.trim("a.type")).alias("attr_type"), F.col("attr_seq").cast("long"))


def _numbered(df: DataFrame) -> DataFrame:
    """``seq``: rows numbered file by file, in the order of the files' paths; ``path`` and ``at``, a row's place in its file, go.

    A file is read in one task, so numbers within it are the file's own; the files' counts (a row each) give where
    each begins.
    """
    counts = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(F.col("path").alias("p"), F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row for each file
    return df.join(F.broadcast(first), F.col("path") == F.col("p")).withColumn("seq", F.col("first") + F.col("at")).drop("p", "first", "path", "at")


def _require(keys) -> None:
    for k in ELEMENTS:
        if k not in keys:
            raise LogError(f"missing key '{k}'")


def _json_rows(spark: SparkSession, path: str, cut: bool):
    """The elements of a key, with ``seq``: read by several tasks if ``cut``, else by one for each file."""
    if cut:
        elements, found = json_elements(spark, path)
        _require(found)
        parsed = {}
        for k, kind in ELEMENTS.items():
            x = F.from_json("text", f"{kind}, _corrupt_record: string".replace(": ", " "), {"columnNameOfCorruptRecord": "_corrupt_record"})
            parsed[k] = elements.filter(F.col("key") == k).select("seq", x.alias("x")).select("seq", "x.*")
            if not parsed[k].filter("_corrupt_record IS NOT NULL").isEmpty():
                raise LogError("the document isn't valid JSON")
        return lambda k: parsed[k].drop("_corrupt_record")
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(JSON_SCHEMA + ", _corrupt_record string").json(path)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    missing = raw.select(*[F.max(F.col(k).isNull()).alias(k) for k in ELEMENTS], F.max("_corrupt_record").alias("bad")).first()
    if missing["bad"] is not None:
        raise LogError("the document isn't valid JSON")
    _require([k for k in ELEMENTS if not missing[k]])
    return lambda k: _numbered(raw.select("path", F.posexplode(k).alias("at", "x")).select("path", F.col("at").cast("long"), "x.*"))


def _json_parts(spark: SparkSession, path: str, cut: bool) -> dict[str, DataFrame]:
    part = _json_rows(spark, path, cut)
    kind = lambda v: F.schema_of_variant(v)

    def attributes(df, timed):
        rows = df.select("seq", "id", "type", F.posexplode("attributes").alias("attr_seq", "a"))
        k = kind(F.col("a.value"))
        source = F.when(k == "STRING", "string").when(k == "BOOLEAN", "boolean").when(k == "BIGINT", "integer").when(k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"), "float")
        text = F.expr("try_variant_get(a.value, '$', 'string')")
        return rows.select("seq", "id", "type", F.col("attr_seq").cast("long"), F.col("a.name").alias("name"), (F.col("a.time") if timed else F.lit(None).cast("string")).alias("time"), source.alias("source"), text.alias("text"))

    objects, events = part("objects"), part("events")
    name = lambda df: df.select(F.col("name").alias("type_name"), F.col("seq").alias("type_seq"), "attributes")
    return {
        "object_types": name(part("objectTypes")), "event_types": name(part("eventTypes")), "objects": objects.select("seq", "id", "type", "relationships"),
        "events": events.select("seq", "id", "type", "time", "relationships"), "object_attrs": attributes(objects, True), "event_attrs": attributes(events, False),
    }


def _xml_rows(spark: SparkSession, path: str, cut: bool):
    """The elements of a row tag, with ``seq``: read by several tasks if ``cut``, else by one for each file."""
    how = {"valueTag": "_VALUE", "ignoreSurroundingSpaces": "false"}
    if cut:
        elements = xml_elements(spark, path)
        parsed = lambda tag, schema: elements.filter(F.col("key") == tag).select("seq", F.from_xml("text", schema, how).alias("x")).select("seq", "x.*")
        return lambda tag, schema: parsed(tag, schema)
    in_file = F.row_number().over(Window.partitionBy("path").orderBy("row")).cast("long") - 1  # rows come in the file's order
    placed = lambda df: _numbered(df.withColumn("path", F.col("_metadata.file_path")).withColumn("row", F.monotonically_increasing_id()).withColumn("at", in_file).drop("row"))
    if spark.read.format("xml").option("rowTag", "log").schema("events string, objects string").load(path).limit(1).count() == 0:
        raise LogError("the root isn't <log>")
    return lambda tag, schema: placed(spark.read.format("xml").option("rowTag", tag).options(**how).schema(schema).load(path))


def _xml_parts(spark: SparkSession, path: str, cut: bool) -> dict[str, DataFrame]:
    relations = "array<struct<`_object-id`: string, _qualifier: string, _relationship: string>>"
    read = _xml_rows(spark, path, cut)
    listed = "struct<attribute: array<struct<_name: string, _type: string>>>"
    types = lambda tag: read(tag, f"_name string, attributes {listed}").select(
        F.col("_name").alias("type_name"), F.col("seq").alias("type_seq"), F.transform("attributes.attribute", lambda a: F.struct(a["_name"].alias("name"), a["_type"].alias("type"))).alias("attributes")
    )
    value = "_name: string, _VALUE: string"
    events = read("event", f"_id string, _type string, _time string, attributes struct<attribute: array<struct<{value}>>>, objects struct<relationship: {relations}>")
    objects = read("object", f"_id string, _type string, attributes struct<attribute: array<struct<_time: string, {value}>>>, objects struct<relationship: {relations}>")
    linked = lambda: F.transform("objects.relationship", lambda r: F.struct(r["_object-id"].alias("objectId"), F.coalesce(r["_qualifier"], r["_relationship"], F.lit("")).alias("qualifier")))
    head = lambda df, *more: df.select("seq", F.col("_id").alias("id"), F.col("_type").alias("type"), *more, linked().alias("relationships"))

    def attributes(df, timed):
        rows = df.select("seq", F.col("_id").alias("id"), F.col("_type").alias("type"), F.posexplode("attributes.attribute").alias("attr_seq", "a"))
        return rows.select("seq", "id", "type", F.col("attr_seq").cast("long"), F.col("a._name").alias("name"), (F.col("a._time") if timed else F.lit(None).cast("string")).alias("time"), F.lit("string").alias("source"), F.coalesce("a._VALUE", F.lit("")).alias("text"))

    return {
        "object_types": types("object-type"), "event_types": types("event-type"), "objects": head(objects),
        "events": head(events, F.col("_time").alias("time")), "object_attrs": attributes(objects, True), "event_attrs": attributes(events, False),
    }


def _first(df: DataFrame, order: str = "seq"):
    rows = df.orderBy(order).limit(1).collect()
    return rows[0] if rows else None


def _check_types(kind: str, rows: DataFrame) -> None:
    flat = _types(rows)
    if r := _first(rows.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"), F.max("type_seq").alias("seq")).filter("n > 1")):
        raise LogError(f"duplicate {kind} type '{r['type_name']}'")
    if r := _first(flat.filter("attr_name IS NOT NULL").groupBy("type_name", "attr_name").agg(F.count(F.lit(1)).alias("n"), F.max("attr_seq").alias("seq")).filter("n > 1")):
        raise LogError(f"duplicate attribute '{r['attr_name']}' of {kind} type '{r['type_name']}'")
    if r := _first(flat.filter(F.col("attr_name").isNotNull() & ~F.coalesce(F.col("attr_type").isin(*KINDS), F.lit(False))).withColumn("seq", F.col("type_seq"))):
        raise LogError(f"unknown attribute type '{r['attr_type']}'")


def _typed(attrs: DataFrame, types: DataFrame) -> DataFrame:
    declared = types.filter("attr_name IS NOT NULL").select(F.col("type_name").alias("type"), F.col("attr_name").alias("name"), F.col("attr_type").alias("declared"))
    rows = attrs.join(declared, ["type", "name"], "left").withColumn("attr_type", F.coalesce("declared", "source"))
    return rows.select("*", *[c.alias(n) for n, c in coerce(F.col("attr_type"), F.col("source"), F.col("text")).items()])


def read_log(spark: SparkSession, path: str, hint: str | None = None, validate: bool = True, cut: bool | None = None) -> EventLog:
    """An event log from an OCEL 2.0 document. Raises LogError for the first fault, in a fixed order of checks.

    ``cut``: whether several tasks read a file; the log is the same. If not said, they do where a file is larger than
    ``spark.sql.files.maxPartitionBytes``.
    """
    cut = largest_file(spark, path) > split_size(spark) if cut is None else cut
    head = b""
    if not hint:
        try:
            hint = detect_format(path)
        except LogError:
            head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("head")).first()["head"])
            hint = detect_format(None, head)
    kind = detect_format(hint)
    parts = (_json_parts if kind == "json" else _xml_parts)(spark, path, cut)
    parts = {name: written(df, name) for name, df in parts.items()}  # parsed once for all checks and tables
    event_types, object_types = _types(parts["event_types"]), _types(parts["object_types"])
    events = parts["events"].withColumn("time_ms", parse_time(F.col("time")))
    e2o = _relations(events.select(F.col("id").alias("event_id"), F.col("seq").alias("event_seq"), "relationships"), ["event_id", "event_seq"])
    o2o = _relations(parts["objects"].select(F.col("id").alias("source_id"), "seq", "relationships"), ["source_id", "seq"])
    object_attrs = _typed(parts["object_attrs"], object_types).withColumn("time_ms", parse_time(F.col("time")))
    event_attrs = _typed(parts["event_attrs"], event_types)
    if validate:
        _check_types("event", parts["event_types"])
        _check_types("object", parts["object_types"])
        unset = F.coalesce("v_string", F.col("v_int").cast("string"), F.col("v_float").cast("string"), F.col("v_bool").cast("string"), F.col("v_time_ms").cast("string")).isNull()
        ids = parts["objects"].select(F.col("id").alias("object_id"))
        for what, rows, types in (("object", parts["objects"], object_types), ("event", parts["events"], event_types)):
            if r := _first(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq")).filter("n > 1")):
                raise LogError(f"duplicate {what} id '{r['id']}'")
            if r := _first(rows.join(types.select(F.col("type_name").alias("type")).distinct(), "type", "left_anti")):
                raise LogError(f"{what} '{r['id']}' has unknown type '{r['type']}'")
        if r := _first(e2o.join(ids, "object_id", "left_anti"), "event_seq"):
            raise LogError(f"event '{r['event_id']}' references unknown object '{r['object_id']}'")
        if r := _first(o2o.join(ids, "object_id", "left_anti")):
            raise LogError(f"object '{r['source_id']}' references unknown object '{r['object_id']}'")
        if r := _first(object_attrs.filter(unset | F.col("time_ms").isNull())):
            raise LogError(f"object '{r['id']}' has a bad value or time of attribute '{r['name']}'")
        if r := _first(events.filter("time_ms IS NULL")):
            raise LogError(f"event '{r['id']}' has a bad time '{r['time']}'")
        if r := _first(event_attrs.filter(unset)):
            raise LogError(f"event '{r['id']}' has a bad value of attribute '{r['name']}'")
    shaped = lambda df, name: df.select(*[F.col(f.name).cast(f.dataType) for f in T._parse_datatype_string(SCHEMAS[name]).fields])
    return EventLog(
        shaped(event_types, "event_types"), shaped(object_types, "object_types"),
        shaped(events.withColumnsRenamed({"id": "event_id", "type": "event_type", "seq": "event_seq"}), "events"),
        shaped(event_attrs.withColumnsRenamed({"id": "event_id", "seq": "event_seq"}), "event_attrs"), shaped(e2o, "e2o"),
        shaped(parts["objects"].withColumnsRenamed({"id": "object_id", "type": "object_type", "seq": "object_seq"}), "objects"),
        shaped(object_attrs.withColumnsRenamed({"id": "object_id"}), "object_attrs"), shaped(o2o.withColumnsRenamed({"object_id": "target_id"}), "o2o"), source_format=kind,
    )


def read_text(spark: SparkSession, data: str | bytes, hint: str | None = None) -> EventLog:
    """A log from a document in memory, plain or gzipped."""
    import uuid

    raw = data.encode() if isinstance(data, str) else data
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise LogError("the document isn't valid UTF-8") from e
    kind = detect_format(hint, raw)
    # to where executors can read it, through Spark's own writer
    path = f"{shared_folder(spark)}/tracewright-documents/{uuid.uuid4().hex}"
    spark.createDataFrame([(raw.decode("utf-8"),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return read_log(spark, path, kind)
