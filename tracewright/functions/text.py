"""Text as Spark's own functions don't give it: lower-casing of A-Z alone, and numbers without exponents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z; all other letters stay."""
    return F.translate(F.col(c) if isinstance(c, str) else c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_number(n: Column) -> Column:
    """A double in its shortest decimal digits, without an exponent and without decimals where it is whole.

    Spark's text has the shortest digits but an exponent below a thousandth and from ten million on: the point is
    moved. The others are NaN, inf and -inf.
    """
    text = n.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    parts = F.split(F.regexp_replace(text, "^-", ""), "E")
    head = F.split(parts[0], r"\.")
    power = parts[1].try_cast("int")
    digits = F.concat(head[0], F.regexp_replace(head[1], "0+$", ""))
    point, size = F.length(head[0]) + power, F.length(digits)  # the point's place among the digits
    zeros = lambda k: F.repeat(F.lit("0"), k)
    middle = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size))
    written = F.when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point < size, middle).otherwise(F.concat(digits, zeros(point - size)))
    # most numbers have no exponent and end here
    plain = F.when(text.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(text, r"\.0$", ""))
    return plain.when(F.isnan(n), "NaN").when(F.abs(n) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, written))
