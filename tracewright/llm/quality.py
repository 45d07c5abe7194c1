"""Quality rules: texts' own counts, and lines that too many documents of one host share.

Lines are normalised (lower case, runs of white space as one space, ends trimmed) and hashed. For each host the
distinct texts that hold a line are counted (partial counts on the map side, so one line in a third of all
documents is no hot task); lines above the limit are removed, and a document that they deplete is rejected.
Only narrow rows travel: (host, line hash) counts and the matched lines' word counts, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, join_small, let, materialise, split_words

WINDOW = 8


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in ``width``-word windows that occur twice or more in ``words`` (an array; long)."""

    def windows(h: Column) -> Column:
        # hashes of all windows, from hashes of words; compared by 64-bit hash
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.when(F.size(h) >= width, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))).otherwise(
            F.array().cast("array<bigint>")
        )

    def starts(sorted_: Column) -> Column:
        same = lambda i, j: F.get(sorted_, i)["h"] == F.get(sorted_, j)["h"]
        twice = F.filter(sorted_, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        gap = F.transform(s, lambda p, i: F.least(F.coalesce(F.get(s, i + 1) - p, F.lit(width)), F.lit(width)))
        return F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: a + g)

    def count(w: Column) -> Column:
        order = lambda w: F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        slow = let(order(w), lambda s: let(starts(s), covered))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(slow)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), count))


def text_counts(text: Column) -> dict[str, Column]:
    """The base counts of a text as long columns, except for n_words and word_chars, which take its words."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.regexp_replace(line, SPACE, "")) > 0)
    return {
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_lines(text: Column) -> Column:
    """The lines of ``text`` with a word, as structs of hash and word count, in order."""
    clean = F.transform(F.split(F.lower(text), "\n"), lambda line: F.trim(F.regexp_replace(line, SPACE, " ")))
    words = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.filter(clean, lambda line: line != ""), lambda line: F.struct(F.xxhash64(line).alias("h"), words(line).alias("n")))


def apply_rules(
    docs: DataFrame, max_docs: int = 20, min_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """Judge each row of ``docs``: its id, the base counts, ``base_failed``, ``removed_words`` and ``kept``.

    A line is removed where more than ``max_docs`` distinct texts of the row's host hold it. ``kept`` is false
    for rows that fail the base rules, and for those of whose words less than ``min_share`` is left.

    Null or empty text: no words, so base_failed. Null hosts are one host. Exact copies count once in a line's
    documents, so copies of a good text don't condemn it. Equal rows get equal verdicts. No rows: no rows.
    Columns beyond the three named are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))  # of rows, below
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    rows = rows.withColumn("th", F.xxhash64(text))
    lines = rows.select("doc_id", "host", "th", normal_lines(text).alias("lines"))
    distinct = lines.select("host", "th", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    # copies: a text counts with its first id only, found among (host, text hash) rows
    first = rows.groupBy("host", "th").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("host", "th", "copies")
    weight = materialise(first, "copies")
    once = join_small(distinct, weight, ["host", "th"], "left").select(
        "host", "h", (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("share")
    )
    frequent = materialise(once.groupBy("host", "h").agg(F.sum("share").alias("docs")).filter(F.col("docs") > max_docs + 0.5).select("host", "h"), "frequent")
    hit = lines.select("doc_id", "host", "th", F.posexplode("lines").alias("pos", "line")).select("doc_id", "host", "th", "pos", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    hit = join_small(hit, frequent, ["host", "h"], "left_semi")
    # equal rows yield the same lines twice: once for each place
    removed = hit.groupBy("doc_id", "host", "th", "pos").agg(F.max("n").alias("n")).groupBy("doc_id", "host", "th").agg(F.sum("n").cast("long").alias("removed_words"))
    removed = removed.select(F.col("doc_id").alias("_d"), F.col("host").alias("_h"), F.col("th").alias("_t"), "removed_words")
    counted = rows.select("doc_id", "host", "th", text.alias("text")).withColumn("words", split_words(F.col("text"), SPACE))
    base = counted.select(
        "doc_id", "host", "th", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        *[c.alias(k) for k, c in text_counts(F.col("text")).items()], repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("host") == F.col("_h")) & (F.col("th") == F.col("_t"))
    out = base.join(removed, same, "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    left = F.col("n_words") - F.col("removed_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed",
        (~F.col("base_failed") & (left >= F.col("n_words") * min_share)).alias("kept"),
    )
