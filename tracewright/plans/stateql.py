"""The state language: ``STATE name FOR LEADING OBJECT TYPE t AS CASE WHEN … THEN … ELSE … END``.

Text is parsed on the driver; the query becomes one CASE expression over (event, leading object) rows with the
attributes it names, as of the event's time for objects, so that Catalyst plans and compiles all of it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import EPSILON
from ..functions.text import LOWER, UPPER, ascii_lower, plain_number
from ..model import EventLog, LogError
from ..tables import written


class StateQueryError(LogError):
    """A state query that can't be parsed or applied."""


TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*)
      | (?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<number>-?\d+(?:\.\d+)?)
      | (?P<ident>[A-Za-z_][A-Za-z0-9_-]*)
      | (?P<op><=|>=|!=|<>|[=<>().;])""",
    re.X,
)
#: What a string must look like to count as a number.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
MOST = (1 << 63) - 1
DEFAULT = "STATE state FOR LEADING OBJECT TYPE '{}' AS CASE WHEN event.type IS NOT NULL THEN 'Active' ELSE 'Other' END"


@dataclass(frozen=True)
class Literal:
    value: str | float | bool


@dataclass(frozen=True)
class Field:
    scope: str
    name: str


@dataclass(frozen=True)
class Compare:
    op: str
    left: Literal | Field
    right: Literal | Field


@dataclass(frozen=True)
class IsNull:
    value: Literal | Field
    negated: bool


@dataclass(frozen=True)
class Logic:
    op: str  # AND, OR, NOT
    parts: tuple


@dataclass(frozen=True)
class StateQuery:
    attribute: str
    leading_type: str
    branches: tuple
    otherwise: Literal | Field | None


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            what = "unterminated string" if text[at] in "'\"" else f"unexpected character '{text[at]}'"
            raise StateQueryError(f"{what} at position {at}")
        kind, value = m.lastgroup, m.group()
        if kind == "string":
            value = value[1:-1].replace(value[0] * 2, value[0])
        if kind != "skip":
            out.append((kind, value))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def keyword(self, *words: str) -> bool:
        """Take the words, if they all come next."""
        ahead = self.tokens[self.at : self.at + len(words)]
        if len(ahead) == len(words) and all(k == "ident" and v.upper() == w for (k, v), w in zip(ahead, words, strict=True)):
            self.at += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        for w in words:
            if not self.keyword(w):
                raise StateQueryError(f"expected {w}, found '{self.peek()[1] or 'end of query'}'")

    def op(self, sign: str) -> bool:
        if self.peek() == ("op", sign):
            self.at += 1
            return True
        return False

    def name(self, strings: bool = False) -> str:
        kind, value = self.next()
        if kind == "ident" or strings and kind == "string":
            return value
        raise StateQueryError(f"expected a name, found '{value or 'end of query'}'")

    def query(self) -> StateQuery:
        self.expect("STATE")
        attribute = self.name()
        self.expect("FOR", "LEADING", "OBJECT", "TYPE")
        leading = self.name(strings=True)
        self.expect("AS", "CASE")
        branches = []
        while self.keyword("WHEN"):
            condition = self.either()
            self.expect("THEN")
            branches.append((condition, self.value()))
        if not branches:
            raise StateQueryError("expected at least one WHEN")
        otherwise = self.value() if self.keyword("ELSE") else None
        self.expect("END")
        self.op(";")
        if self.peek()[0] != "end":
            raise StateQueryError(f"unexpected '{self.peek()[1]}' after END")
        return StateQuery(attribute, leading, tuple(branches), otherwise)

    def either(self):
        parts = [self.both()]
        while self.keyword("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("OR", tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.keyword("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Logic("AND", tuple(parts))

    def negation(self):
        return Logic("NOT", (self.negation(),)) if self.keyword("NOT") else self.predicate()

    def predicate(self):
        if self.op("("):
            inner = self.either()
            if not self.op(")"):
                raise StateQueryError("expected )")
            return inner
        left = self.value()
        if self.keyword("IS", "NOT", "NULL"):
            return IsNull(left, True)
        if self.keyword("IS", "NULL"):
            return IsNull(left, False)
        if self.keyword("LIKE"):
            return Compare("LIKE", left, self.value())
        kind, sign = self.next()
        if kind != "op" or sign not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise StateQueryError(f"expected a comparison, found '{sign or 'end of query'}'")
        return Compare("!=" if sign == "<>" else sign, left, self.value())

    def value(self) -> Literal | Field:
        kind, value = self.next()
        if kind == "string":
            return Literal(value)
        if kind == "number":
            return Literal(float(value))
        if kind == "ident":
            if value.lower() in ("event", "object") and self.op("."):
                return Field(value.lower(), self.name(strings=True).translate(ASCII))
            return Literal({"TRUE": True, "FALSE": False}.get(value.upper(), value))
        raise StateQueryError(f"expected a value, found '{value or 'end of query'}'")


def parse(text: str) -> StateQuery:
    return Parser(text).query()


_NAMED = r"(?:'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_][A-Za-z0-9_-]*)"
_HEADER = re.compile(rf"^\s*STATE\s+(?P<name>[A-Za-z_][A-Za-z0-9_-]*)(?:\s+FOR\s+LEADING\s+OBJECT\s+TYPE\s+{_NAMED})?\s+AS\s+CASE", re.I | re.M)


def default_query(object_type: str) -> str:
    """A query to start from."""
    return DEFAULT.format(object_type.replace("'", "''"))


def with_leading_type(text: str, object_type: str) -> str:
    """``text`` with its header naming another leading type; a query to start from, where there is no header."""
    found = _HEADER.search(text)
    if not found:
        return default_query(object_type)
    quoted = object_type.replace("'", "''")
    blank = re.match(r"\s*", text)[0]
    return f"{text[: found.start()]}{blank}STATE {found['name']} FOR LEADING OBJECT TYPE '{quoted}' AS CASE{text[found.end() :]}"


def fields(node) -> set[Field]:
    """Fields that an expression names."""
    if isinstance(node, Field):
        return {node}
    parts = {Compare: lambda: (node.left, node.right), IsNull: lambda: (node.value,), Logic: lambda: node.parts}.get(type(node), tuple)()
    return set().union(*map(fields, parts)) if parts else set()


def _number_text(n: Column) -> Column:
    """Whole numbers as 64-bit integers, the largest and smallest beyond those; others in plain decimals."""
    whole = F.when(n >= 2.0**63, MOST).when(n <= -(2.0**63), -MOST - 1).otherwise(F.when(F.abs(n) < 2.0**63, n).cast("long")).cast("string")
    return F.when((n == F.rint(n)) & (F.abs(n) < float("inf")), whole).otherwise(plain_number(n))


def typed(s: Column | None = None, n: Column | None = None, b: Column | None = None) -> Column:
    """A value as a struct: b if it is a boolean, n if it is or reads as a number, s if it is a string; all null if missing.

    Numbers are written as text only where text is asked for, by ``text_of``.
    """
    null = lambda t: F.lit(None).cast(t)
    s, n, b = s if s is not None else null("string"), n if n is not None else null("double"), b if b is not None else null("boolean")
    trimmed = F.trim(s)
    read = F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))
    return F.struct(b.alias("b"), F.coalesce(n, read).alias("n"), s.alias("s"))


def text_of(v: Column) -> Column:
    return F.coalesce(v["s"], _number_text(v["n"]), v["b"].cast("string"))


ASCII = str.maketrans(UPPER, LOWER)


def like_pattern(pattern: str) -> str:
    """% is any run; segments are found leftmost, without going back, and case (of ASCII) doesn't count."""
    quote = lambda s: "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E" if s else ""
    parts = pattern.translate(ASCII).split("%")
    if len(parts) == 1:
        return f"(?s)^{quote(parts[0])}\\z"
    body = quote(parts[0]) + "".join(f"(?>.*?{quote(p)})" for p in parts[1:] if p)
    return f"(?s)^{body}" + ("" if parts[-1] == "" else "\\z")


def _like(value: Column, pattern, compiled: Column) -> Column:
    if isinstance(pattern, Literal):
        p = pattern.value
        text = ("true" if p else "false") if isinstance(p, bool) else (str(int(p)) if isinstance(p, float) and p == int(p) else str(p))
        return ascii_lower(text_of(value)).rlike(like_pattern(text))
    quote = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    p = ascii_lower(text_of(compiled))
    parts = F.split(p, "%")
    rest = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: x != ""), lambda x: F.concat(F.lit("(?>.*?"), quote(x), F.lit(")")))
    whole = F.concat(F.lit("(?s)^"), quote(F.get(parts, F.lit(0))), F.array_join(rest, ""), F.when(p.endswith("%"), "").otherwise("\\z"))
    return F.regexp_like(ascii_lower(text_of(value)), whole)


class Compiler:
    """Expressions to columns. Without an object in context, object fields are missing."""

    def __init__(self, with_object: bool):
        self.with_object = with_object

    def value(self, v: Literal | Field) -> Column:
        if isinstance(v, Literal):
            kind = "b" if isinstance(v.value, bool) else "n" if isinstance(v.value, float) else "s"
            return typed(**{kind: F.lit(v.value)})
        if v.scope == "object" and not self.with_object:
            return typed()
        return F.col(f"`{v.scope}.{v.name}`")

    def condition(self, node) -> Column:
        if isinstance(node, Logic):
            parts = [self.condition(p) for p in node.parts]
            out = parts[0]
            if node.op == "NOT":
                return ~out
            for p in parts[1:]:
                out = out & p if node.op == "AND" else out | p
            return out
        if isinstance(node, IsNull):
            value = self.value(node.value)
            missing = F.coalesce(value["s"], value["n"].cast("string"), value["b"].cast("string")).isNull()
            return ~missing if node.negated else missing
        left, right = self.value(node.left), self.value(node.right)
        if node.op == "LIKE":
            return F.coalesce(_like(left, node.right, right), F.lit(False))
        numbers, flags = left["n"].isNotNull() & right["n"].isNotNull(), left["b"].isNotNull() & right["b"].isNotNull()
        if node.op in ("=", "!="):
            apart = F.nanvl(F.abs(left["n"] - right["n"]), F.lit(1.0))  # what isn't a number equals nothing
            same = F.when(flags, left["b"] == right["b"]).when(numbers, apart < EPSILON).otherwise(text_of(left) == text_of(right))
            return F.coalesce(same if node.op == "=" else ~same, F.lit(False))
        test = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[node.op]
        ordered = ~(F.isnan(left["n"]) | F.isnan(right["n"]))
        return F.coalesce(F.when(numbers, ordered & test(left["n"], right["n"])).otherwise(test(text_of(left), text_of(right))), F.lit(False))


def _attribute() -> Column:
    n = F.coalesce(F.col("v_int").cast("double"), F.col("v_float"), F.col("v_time_ms").cast("double"))
    return typed(F.col("v_string"), n, F.col("v_bool"))


def as_of(probes: DataFrame, changes: DataFrame, names: list[str]) -> DataFrame:
    """``probes`` (object_id, time_ms, …) with each named attribute's last value at or before time_ms, as ``object.<name>``.

    Probes and changes are put in one order of time for each object, so no change is paired with a probe.
    """
    more = [c for c in probes.columns if c not in ("object_id", "time_ms")]
    changes = changes.withColumn("name", ascii_lower("name")).filter(F.col("name").isin(names))
    left = probes.select("object_id", "time_ms", F.lit(1).alias("_probe"), F.lit(None).cast("long").alias("attr_seq"), F.struct(*more).alias("_row"))
    values = [F.when(F.col("name") == n, _attribute()).alias(f"_v{i}") for i, n in enumerate(names)]
    right = changes.select("object_id", "time_ms", F.lit(0).alias("_probe"), "attr_seq", *values)
    order = Window.partitionBy("object_id").orderBy("time_ms", "_probe", "attr_seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True)
    rows = rows.select("object_id", "time_ms", "_probe", "_row", *[F.last(f"_v{i}", ignorenulls=True).over(order).alias(f"object.{n}") for i, n in enumerate(names)])
    found = rows.filter("_probe = 1").select("object_id", "time_ms", "_row.*", *[F.col(f"`object.{n}`") for n in names])
    return found


def assignments(log: EventLog, query: StateQuery) -> DataFrame:
    """event_seq, event_id and value of the events that get a state."""
    log.require_type(query.leading_type)
    named = set().union(*[fields(c) | fields(v) for c, v in query.branches], fields(query.otherwise) if query.otherwise else set())
    special = {"id", "type", "activity", "time", "timestamp"}
    event_names = sorted({f.name for f in named if f.scope == "event"} - special)
    object_names = sorted({f.name for f in named if f.scope == "object"} - {"id", "type"})
    objects = log.objects.filter(F.col("object_type") == query.leading_type).select("object_id")
    rows = log.e2o.select("event_seq", "rel_seq", "object_id").join(objects, "object_id").join(log.events, "event_seq")
    if object_names:
        rows = as_of(rows, log.object_attrs, object_names)
    if event_names:
        attrs = log.event_attrs.withColumn("name", ascii_lower("name")).filter(F.col("name").isin(event_names))
        last = [F.max_by(F.when(F.col("name") == n, _attribute()), F.when(F.col("name") == n, F.col("attr_seq"))).alias(f"event.{n}") for n in event_names]
        rows = rows.join(attrs.groupBy("event_seq").agg(*last), "event_seq", "left")
        rows = rows.select(*[c for c in rows.columns if "." not in c], *[F.col(f"`{c}`") for c in rows.columns if c.startswith("object.")], *[F.coalesce(F.col(f"`event.{n}`"), typed()).alias(f"event.{n}") for n in event_names])
    time = typed(n=F.col("time_ms").cast("double"))
    text = lambda c: typed(s=F.col(c))
    rows = rows.select(
        *[F.col(f"`{c}`") for c in rows.columns], text("event_id").alias("event.id"), text("event_type").alias("event.type"), text("event_type").alias("event.activity"),
        time.alias("event.time"), time.alias("event.timestamp"), text("object_id").alias("object.id"), typed(s=F.lit(query.leading_type)).alias("object.type"),
    )
    if object_names:
        rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), typed()).alias(c) if c in {f"object.{n}" for n in object_names} else F.col(f"`{c}`") for c in rows.columns])
    found = lambda i, v: F.struct(F.lit(i).alias("branch"), F.col("rel_seq"), text_of(v).alias("value"))
    case = None
    for i, (condition, value) in enumerate(query.branches):
        compiler = Compiler(any(f.scope == "object" for f in fields(condition)))
        hit, out = compiler.condition(condition), found(i, compiler.value(value))
        case = F.when(hit, out) if case is None else case.when(hit, out)
    if query.otherwise is not None:
        case = case.otherwise(found(len(query.branches), Compiler(True).value(query.otherwise)))
    best = rows.groupBy("event_seq", "event_id").agg(F.min(case).alias("best"))
    return best.filter(F.col("best.value").isNotNull()).select("event_seq", "event_id", F.col("best.value").alias("value"))


def write_states(log: EventLog, attribute: str, leading_type: str, labels: DataFrame) -> EventLog:
    """The log whose events have ``labels`` (event_seq, event_id, value) as their only attribute of that name.

    Labels are written once: most analyses read them more than once.
    """
    labels = written(labels.select("event_id", "event_seq", "value"), "labels")
    columns = log.event_attrs.columns
    new = labels.select("event_id", "event_seq", F.lit(1 << 40).cast("long").alias("attr_seq"), F.lit(attribute).alias("name"), F.lit("string").alias("attr_type"), F.col("value").alias("v_string"))
    attrs = log.event_attrs.filter(F.col("name") != attribute).unionByName(new, allowMissingColumns=True).select(*columns)
    defs = log.event_types
    has = defs.filter(F.col("attr_name") == attribute).select("type_name").distinct()
    add = defs.groupBy("type_name", "type_seq").agg((F.coalesce(F.max("attr_seq"), F.lit(-1)) + 1).cast("long").alias("attr_seq")).join(has, "type_name", "left_anti")
    add = add.select("type_name", "type_seq", F.lit(attribute).alias("attr_name"), F.lit("string").alias("attr_type"), "attr_seq")
    return log.but(event_attrs=attrs, event_types=defs.unionByName(add), leading_object_type=leading_type)


def apply_state_query(log: EventLog, text: str) -> EventLog:
    query = parse(text)
    return write_states(log, query.attribute, query.leading_type, assignments(log, query))
