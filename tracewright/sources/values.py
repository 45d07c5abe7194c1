"""Source values to typed ones: kinds of scalars, coercion to declared types, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("string", "time", "integer", "float", "boolean")
#: Shapes of times that are read: RFC 3339, the same without an offset (UTC), and a bare date.
TIME = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
INTEGER, NUMBER = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"


def parse_time(text: Column) -> Column:
    """Epoch milliseconds (finer digits are dropped), null if the text isn't a time. Needs the session's zone to be UTC."""
    text = F.trim(text)
    clean = F.regexp_replace(F.regexp_replace(F.upper(text), "T", " "), "Z$", "+00:00")
    zoned = F.when(clean.rlike(r"[+-]\d{2}:?\d{2}$") & (F.length(clean) > 11), clean).otherwise(F.concat(F.when(F.length(clean) == 10, F.concat(clean, F.lit(" 00:00:00"))).otherwise(clean), F.lit("+00:00")))
    micros = F.regexp_replace(zoned, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(TIME), F.unix_millis(micros.try_cast("timestamp")))


def format_time(ms: Column) -> Column:
    """UTC with Z; whole seconds without a fraction, others with milliseconds."""
    t = F.timestamp_millis(ms)
    return F.when(ms % 1000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def coerce(kind: Column, source: Column, text: Column) -> dict[str, Column]:
    """Typed columns from a value's declared kind, the kind of scalar it came as, and its text; all null if it can't be."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    whole = F.coalesce(F.when(trimmed.rlike(INTEGER), trimmed.try_cast("long")), F.when((source == "float") & (finite == F.floor(finite)), finite.try_cast("long")))
    flag = F.when(source == "integer", F.when(text == "1", True).when(text == "0", False)).when(
        source.isin("boolean", "string"), F.when(F.lower(trimmed).isin("true", "1"), True).when(F.lower(trimmed).isin("false", "0"), False)
    )
    # a number as text: whole ones without decimals
    plain = F.when((source == "float") & (finite == F.floor(finite)) & (F.abs(finite) < 1e15), finite.try_cast("long").cast("string")).otherwise(text)
    return {
        "v_string": F.when(kind == "string", plain),
        "v_int": F.when((kind == "integer") & (source != "boolean"), whole),
        "v_float": F.when((kind == "float") & (source != "boolean"), finite),
        "v_bool": F.when(kind == "boolean", flag),
        "v_time_ms": F.when((kind == "time") & (source == "string"), parse_time(text)),
    }
