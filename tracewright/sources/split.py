"""Rows of a document that several tasks read: its arrays' elements (JSON), or its row tags (XML), in the file's order.

A file is cut at one character, ``}`` or ``>``, by Spark's own line reader, which splits files at byte ranges. What a
piece means follows from what stands before it, by running sums: quotes tell whether it begins inside a string, and
brackets how deep it lies. Sums within a byte range need no other range; the ranges' totals (a row each, for both cases
of what they may begin with) give what to add. So no task reads a whole file, whatever its lines are.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import LogError
from ..tables import ranked, written

#: Arrays of JSON documents, and row tags of XML ones.
ARRAYS = ["objectTypes", "eventTypes", "objects", "events"]
TAGS = ["event-type", "object-type", "event", "object"]
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0


def split_size(spark: SparkSession) -> int:
    """Bytes up to which a file is one task's anyway."""
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def _pieces(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(path, block, id, value): what stands between two ``at``; blocks are byte ranges, and ids ascend within them."""
    rows = spark.read.option("lineSep", at).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")


def _within(upto: int = -1):
    return Window.partitionBy("path", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, upto)


def _blocks():
    return Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _count(text: Column, *chars: str) -> Column:
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")


def _bare(inside: Column) -> Column:
    """A piece without its strings, if it begins inside one or not."""
    return F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "plain"), r'"[^"]*(?:"|$)', "")


def _deep(inside: Column) -> Column:
    """By how much a piece, with the brace behind it, goes deeper, if it begins inside a string or not."""
    bare = _bare(inside)
    closed = (inside.cast("long") + F.col("quotes")) % 2 == 0
    return _count(bare, "{", "[") - _count(bare, "]") - closed.cast("long")


def _heads():
    """Of a piece that passes through the root: the array it is in at its end, all that it opens, where an element
    begins in it (from 0; -1 if none does), and whether it reads as JSON there. Such pieces are few."""

    def read(value: pd.Series, depth: pd.Series) -> pd.DataFrame:
        out = []
        for text, d in zip(value, depth, strict=True):
            named, key, opened, start, sound = None, None, [], -1, True
            for m in _TOKEN.finditer(text):
                t = m[0]
                if t[0] == '"' and d == 1:
                    named = t[1:-1]
                elif t in ("{", "["):
                    if d == 1:
                        key = named if t == "[" else None
                        opened += [named] if t == "[" and named is not None else []
                    elif d == 2 and t == "{":
                        start = m.start()
                        break
                    d += 1
                elif t in ("}", "]"):
                    d -= 1
                elif d <= 0 or d == 2 and key in ARRAYS and t != ",":
                    sound = False
            out.append((key, opened, start, sound))
        return pd.DataFrame(out, columns=["key", "opened", "start", "sound"])

    return F.pandas_udf(read, "key string, opened array<string>, start int, sound boolean")


def json_elements(spark: SparkSession, path: str) -> tuple[DataFrame, set[str]]:
    """(key, seq, text): each element of the root's arrays, numbered over all files in the order of their paths; and
    the keys of arrays that every file has."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without what a backslash escapes
    rows = _pieces(spark, path, "}").withColumn("plain", plain).withColumn("quotes", _count(F.col("plain"), '"'))
    rows = rows.withColumn("before", _zero(F.sum("quotes").over(_within())))
    odd = lambda n: n % 2 == 1
    totals = rows.groupBy("path", "block").agg(F.sum("quotes").alias("q"), F.sum(_deep(odd(F.col("before")))).alias("out"), F.sum(_deep(~odd(F.col("before")))).alias("in"))
    states = totals.withColumn("inside", odd(_zero(F.sum("q").over(_blocks())))).withColumn("deeper", F.when(F.col("inside"), F.col("in")).otherwise(F.col("out")))
    states = written(states.select("path", "block", "inside", _zero(F.sum("deeper").over(_blocks())).alias("depth")), "blocks")
    rows = rows.join(F.broadcast(states), ["path", "block"])  # a row for each byte range
    rows = rows.withColumn("inside", odd(F.col("before") + F.col("inside").cast("long")))
    rows = rows.withColumn("deeper", _deep(F.col("inside"))).withColumn("closed", ~odd(F.col("inside").cast("long") + F.col("quotes")))
    rows = rows.withColumn("depth", F.col("depth") + _zero(F.sum("deeper").over(_within()))).withColumn("after", F.col("depth") + F.col("deeper"))
    leading = F.regexp_extract(_bare(F.col("inside")), r"^[^{\[]*", 0)  # a piece leaves what it is in before it opens anything
    blank = F.col("value").rlike(r"^\s*$")
    rows = rows.select(
        "path", "block", "id", "value", "depth", "after", "inside", (F.col("depth") - _count(leading, "]") < 2).alias("root"),
        (F.col("closed") & (F.col("after") == 2)).alias("last"), (blank & (F.col("depth") <= 0)).alias("tail"),
    )
    rows = written(rows, "pieces")
    # the number of an element: how many have ended before
    ended = rows.groupBy("path", "block").agg(F.sum(F.col("last").cast("long")).alias("n")).select("path", "block", _zero(F.sum("n").over(_blocks())).alias("ended"))
    rows = rows.join(F.broadcast(ended), ["path", "block"]).withColumn("number", F.col("ended") + _zero(F.sum(F.col("last").cast("long")).over(_within())))
    quoted = F.concat(F.when(F.col("inside"), '"').otherwise(""), "value")
    heads = rows.filter(F.col("root") & ~F.col("tail")).select("path", "block", "id", "number", "after", F.col("inside").cast("int").alias("more"), _heads()(quoted, F.col("depth")).alias("h"))
    heads = written(heads.select("path", "block", "id", "number", "after", "h.*", (F.col("h.start") - F.col("more")).alias("from")), "heads")
    place = F.struct("block", "id")
    end = rows.groupBy("path").agg(F.max_by("after", place).alias("after"), F.max_by("tail", place).alias("tail"), F.max(F.col("depth") > 0).alias("opened"))
    if not end.filter("after <> IF(tail, -1, 0) OR NOT opened").isEmpty() or not heads.filter("NOT sound").isEmpty():
        raise LogError("the document isn't valid JSON")
    files = end.count()
    keys = heads.select("path", F.explode("opened").alias("key")).distinct().groupBy("key").count().filter((F.col("count") == files) & F.col("key").isin(ARRAYS))
    # arrays, by the number of the first element that can be theirs; the last one that begins at a number has it
    order = Window.partitionBy("path").orderBy("block", "id")
    held = heads.filter("after >= 2").select("path", "key", F.col("number").alias("first"), F.lead("number").over(order).alias("next"))
    cut = rows.join(heads.select("path", "block", "id", "from"), ["path", "block", "id"], "left")
    own = F.when((F.col("depth") == 2) & ~F.col("inside"), F.locate("{", F.col("value")) - 1).when(F.col("depth") > 2, 0).otherwise(-1)
    start = F.when(F.col("root"), F.coalesce("from", F.lit(-1))).otherwise(own)
    begins = F.when(F.col("root") | (F.col("depth") == 2), place)
    part = cut.filter(start >= 0).select("path", "number", "block", "id", "last", begins.alias("begins"), F.substr("value", start + 1, F.length("value")).alias("text"))
    whole = part.groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("block", "id", "text"))).alias("parts"), F.max("begins").alias("b"), F.max("last").alias("last")).filter("last AND b IS NOT NULL")
    own = F.filter("parts", lambda p: F.struct(p["block"], p["id"]) >= F.col("b"))
    whole = whole.select("path", "number", F.concat(F.array_join(F.transform(own, lambda p: p["text"]), "}"), F.lit("}")).alias("text"))
    whole = whole.join(held.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.coalesce("next", F.lit(2**62))))
    rows = ranked(whole.filter(F.col("key").isin(ARRAYS)).select("key", "path", "number", "text"), "key", [F.col("path"), F.col("number")], "rank")
    return rows.select("key", (F.col("rank") - 1).alias("seq"), "text"), {r["key"] for r in keys.collect()}  # four at most


def xml_elements(spark: SparkSession, path: str) -> DataFrame:
    """(key, seq, text): each element of a row tag, numbered over all files in the order of their paths.

    Row tags don't nest. Comments and CDATA sections that hold a row tag are taken for it.
    """
    rows = _pieces(spark, path, ">").withColumn("tag", F.nullif(F.regexp_extract("value", r"<(/?[\w:][\w:.-]*)[^<]*$", 1), F.lit("")))
    begins = F.coalesce(F.col("tag").isin(TAGS), F.lit(False)).cast("long")
    totals = rows.groupBy("path", "block").agg(F.sum(begins).alias("n"), F.max(F.coalesce(F.col("tag") == "log", F.lit(False))).alias("log"))
    states = written(totals.select("path", "block", "log", _zero(F.sum("n").over(_blocks())).alias("first")), "blocks")
    if not states.groupBy("path").agg(F.max("log").alias("log")).filter("NOT log").isEmpty():
        raise LogError("the root isn't <log>")
    rows = rows.join(F.broadcast(states.drop("log")), ["path", "block"])  # a row for each byte range
    rows = rows.withColumn("number", F.col("first") + F.sum(begins).over(_within(0))).filter("number > 0")
    whole = rows.groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("block", "id", "value"))).alias("parts"))
    first = F.regexp_replace(F.col("parts")[0]["value"], r"(?s)^.*(?=<[^<]*$)", "")
    text = F.concat_ws(">", first, F.transform(F.slice("parts", 2, F.size("parts")), lambda p: p["value"]), F.lit(""))
    whole = whole.select("path", "number", F.regexp_extract(first, r"^<([\w:][\w:.-]*)", 1).alias("key"), text.alias("text"))
    close = F.concat(F.lit("</"), "key", F.lit(">"))
    end = F.when(F.instr(F.col("text"), close) > 0, F.instr(F.col("text"), close) + F.length(close) - 1).otherwise(F.locate("/>", F.col("text")) + 1)
    rows = ranked(whole.select("key", "path", "number", F.substr("text", F.lit(1), end).alias("text")), "key", [F.col("path"), F.col("number")], "rank")
    return rows.select("key", (F.col("rank") - 1).alias("seq"), "text")
