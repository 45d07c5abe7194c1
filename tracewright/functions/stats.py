"""Aggregates and scalar expressions that several analyses share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_number

#: The words that mark a recovered state, wherever they stand in its name.
RECOVERED = "(?i)(normal|available|standard)"
EPSILON = 2.220446049250313e-16


def upper_median(c: str) -> Column:
    """The value at place n // 2 (from 0) of the sorted ones: the larger of the two middle ones."""
    # counted by value in each partition, so that no group is gathered
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def duration_stats(c: str) -> list[Column]:
    """min_ms, median_ms (upper), avg_ms (6 decimals) and max_ms of a column."""
    return [
        F.min(c).alias("min_ms"), upper_median(c).alias("median_ms"),
        F.round(F.avg(c), 6).alias("avg_ms"), F.max(c).alias("max_ms"),
    ]


def value_label(prefix: str = "") -> Column:
    """An attribute's value as text: strings as they are, times in ms, floats in plain decimals, whole ones without."""
    c = lambda n: F.col(prefix + n)
    return F.coalesce(c("v_string"), c("v_int").cast("string"), plain_number(c("v_float")), c("v_bool").cast("string"), c("v_time_ms").cast("string"))


def numeric_value(prefix: str = "") -> Column:
    """An attribute's value as a number: times, integers, finite floats, booleans as 0 and 1; never strings."""
    c = lambda n: F.col(prefix + n)
    finite = F.when(~F.isnan(c("v_float")) & (F.abs(c("v_float")) != float("inf")), c("v_float"))
    return F.coalesce(c("v_int").cast("double"), finite, c("v_bool").cast("int").cast("double"), c("v_time_ms").cast("double"))


def format_number(c: Column) -> Column:
    """Whole numbers without decimals, others rounded to six."""
    six = F.regexp_replace(F.round(c, 6).cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(six, r"\.$", ""))
