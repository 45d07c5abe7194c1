"""Event logs to OCEL 2.0 documents. Entries are made by the executors; the document's frame is put around them here."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_number
from ..model import EventLog
from .values import format_time


def _json_value() -> Column:
    """A value as JSON text."""
    text, number = (F.when(F.col(c).isNotNull(), _string(F.col(c))) for c in ("v_string", "v_float"))
    return F.coalesce(text, F.col("v_int").cast("string"), number, F.col("v_bool").cast("string"), F.concat(F.lit('"'), format_time(F.col("v_time_ms")), F.lit('"')))


def _xml_text(attribute: bool, c: Column) -> Column:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&apos;")] * attribute:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _xml_value() -> Column:
    plain = F.coalesce("v_string", F.col("v_int").cast("string"), plain_number(F.col("v_float")), F.col("v_bool").cast("int").cast("string"), format_time(F.col("v_time_ms")))
    return _xml_text(False, plain)


def _gathered(rows: DataFrame, key: str, seq: str, item: Column, name: str) -> DataFrame:
    """Items of each key as an array, in order of ``seq``."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), item.alias("x")))), lambda e: e["x"]).alias(name))


def _string(c: Column) -> Column:
    return F.regexp_replace(F.substring(F.to_json(F.array(c)), 2, 1 << 30), r"\]$", "")


def json_entries(log: EventLog) -> tuple[DataFrame, DataFrame]:
    """Events and objects as lines of JSON: seq and line, keys in alphabetical order."""
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    array = lambda c: F.concat(F.lit("["), F.coalesce(F.array_join(c, ", "), F.lit("")), F.lit("]"))
    link = obj(field("objectId", _string(F.col("object_id"))), field("qualifier", _string(F.col("qualifier"))))
    plain = obj(field("name", _string(F.col("name"))), field("value", _json_value()))
    timed = obj(field("name", _string(F.col("name"))), field("time", F.concat(F.lit('"'), format_time(F.col("time_ms")), F.lit('"'))), field("value", _json_value()))
    events = log.events.join(_gathered(log.event_attrs, "event_id", "attr_seq", plain, "a"), "event_id", "left").join(_gathered(log.e2o, "event_id", "rel_seq", link, "r"), "event_id", "left")
    links = log.o2o.select(F.col("source_id").alias("object_id"), "rel_seq", "qualifier", F.col("target_id"))
    link2 = obj(field("objectId", _string(F.col("target_id"))), field("qualifier", _string(F.col("qualifier"))))
    objects = log.objects.join(_gathered(log.object_attrs, "object_id", "attr_seq", timed, "a"), "object_id", "left").join(_gathered(links, "object_id", "rel_seq", link2, "r"), "object_id", "left")
    id_, kind = (lambda c: field("id", _string(F.col(c)))), (lambda c: field("type", _string(F.col(c))))
    return (
        events.select(F.col("event_seq").alias("seq"), obj(field("attributes", array("a")), id_("event_id"), field("relationships", array("r")), field("time", F.concat(F.lit('"'), format_time(F.col("time_ms")), F.lit('"'))), kind("event_type")).alias("line")),
        objects.select(F.col("object_seq").alias("seq"), obj(field("attributes", array("a")), id_("object_id"), field("relationships", array("r")), kind("object_type")).alias("line")),
    )


def _declared(types: DataFrame) -> list[dict]:
    out: dict[str, dict] = {}
    for r in types.orderBy("type_seq", "attr_seq").collect():
        entry = out.setdefault(r["type_name"], {"attributes": [], "name": r["type_name"]})
        if r["attr_name"] is not None:
            entry["attributes"].append({"name": r["attr_name"], "type": r["attr_type"]})
    return list(out.values())


def _lines(df: DataFrame) -> Iterator[str]:
    """Lines in order, a partition at a time."""
    return (r["line"] for r in df.orderBy("seq").select("line").toLocalIterator())


def json_chunks(log: EventLog) -> Iterator[str]:
    events, objects = json_entries(log)
    for i, (name, lines) in enumerate((("eventTypes", None), ("events", events), ("objectTypes", None), ("objects", objects))):
        yield ("{\n" if i == 0 else ",\n") + f'  "{name}": '
        if lines is None:
            yield json.dumps(_declared(log.event_types if name == "eventTypes" else log.object_types), ensure_ascii=False, indent=2)
        else:
            yield "["
            for j, line in enumerate(_lines(lines)):
                yield (",\n    " if j else "\n    ") + line
            yield "\n  ]"
    yield "\n}\n"


def xml_chunks(log: EventLog) -> Iterator[str]:
    a = lambda c: _xml_text(True, F.col(c))
    tag = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    link = lambda target: tag('<relationship object-id="', a(target), '" qualifier="', a("qualifier"), '"/>')
    plain = tag('<attribute name="', a("name"), '">', _xml_value(), "</attribute>")
    timed = tag('<attribute name="', a("name"), '" time="', format_time(F.col("time_ms")), '">', _xml_value(), "</attribute>")
    events = log.events.join(_gathered(log.event_attrs, "event_id", "attr_seq", plain, "a"), "event_id", "left").join(_gathered(log.e2o, "event_id", "rel_seq", link("object_id"), "r"), "event_id", "left")
    links = log.o2o.select(F.col("source_id").alias("object_id"), "rel_seq", "qualifier", "target_id")
    objects = log.objects.join(_gathered(log.object_attrs, "object_id", "attr_seq", timed, "a"), "object_id", "left").join(_gathered(links, "object_id", "rel_seq", link("target_id"), "r"), "object_id", "left")
    inner = tag(
        F.coalesce(tag("<attributes>", F.array_join("a", ""), "</attributes>"), F.lit("<attributes/>")),
        F.coalesce(tag("<objects>", F.array_join("r", ""), "</objects>"), F.lit("")),
    )
    event_lines = events.select(F.col("event_seq").alias("seq"), tag('<event id="', a("event_id"), '" type="', a("event_type"), '" time="', format_time(F.col("time_ms")), '">', inner, "</event>").alias("line"))
    object_lines = objects.select(F.col("object_seq").alias("seq"), tag('<object id="', a("object_id"), '" type="', a("object_type"), '">', inner, "</object>").alias("line"))
    from xml.sax.saxutils import quoteattr

    yield "<?xml version='1.0' encoding='UTF-8'?>\n<log>\n"
    for group, types in (("event-type", log.event_types), ("object-type", log.object_types)):
        yield f"  <{group}s>\n"
        for t in _declared(types):
            listed = "".join(f"<attribute name={quoteattr(x['name'])} type={quoteattr(x['type'])}/>" for x in t["attributes"])
            yield f"    <{group} name={quoteattr(t['name'])}>" + (f"<attributes>{listed}</attributes>" if listed else "<attributes/>") + f"</{group}>\n"
        yield f"  </{group}s>\n"
    for group, lines in (("objects", object_lines), ("events", event_lines)):
        yield f"  <{group}>\n"
        for line in _lines(lines):
            yield f"    {line}\n"
        yield f"  </{group}>\n"
    yield "</log>\n"


def export_json(log: EventLog) -> str:
    return "".join(json_chunks(log))


def export_xml(log: EventLog) -> str:
    return "".join(xml_chunks(log))


def feature_file_name(base: str, object_type: str, suffix: str = "features") -> str:
    import re

    safe = re.sub(r"[^a-z0-9]+", "-", object_type.lower()).strip("-") or "objects"
    return f"{base}-{safe}-{suffix}.csv"
