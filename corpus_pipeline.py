"""The corpus pipeline: toxic documents go, one of each group of near copies stays, documents with benchmark passages
go, sources are interleaved to their weights, and token ids are written in blocks.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid
from pathlib import Path

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontam, minhash, mixing, tokens, toxicity
from tracewright.llm.shared import join_small, materialise, shared_dir

#: Token ids run over several stages; SQL has no rANS, no FTRL and no min-hashes.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, d, t): the rows whole, so that no name of a column clashes, their ids as text and the hashes of their texts."""
    return docs.select(F.struct("*").alias("row"), _plain("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def _plain(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) isn't in ``bad``; null ids compare as equal."""
    bad = materialise(bad.select(_plain("doc_id").alias("d"), F.col("th").alias("t")).distinct(), "bad")
    return join_small(_keyed(docs), bad, ["d", "t"], "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of toxicity 0.5 or more, by a model of the labelled ones among them.

    Null and empty texts score as the model's intercept; rows that repeat an id are judged each by its text, equal
    rows alike. No rows, or no labels: all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.toxic_rows(docs, model, 0.5))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 0.8 of their five-word shingles; of rows that
    repeat an id and its text, one. Rows of one id with unlike texts, and rows without an id, are documents of their
    own, and one without an id is kept only where its group has no other."""
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).alias("_row")
    found = minhash.near_duplicates(docs.select(row, "text"), shingle=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "th", "component_id")
    found = materialise(found.distinct().join(docs.select(row, "doc_id").distinct(), "_row"), "groups")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row"))
    single = _without(docs, found.join(first, "_row", "left_anti"))
    keyed = _keyed(docs)
    again = materialise(keyed.groupBy("d", "t").count().filter("count > 1").select("d", "t"), "again")
    if again.isEmpty():
        return single
    keyed = _keyed(single)
    first = join_small(keyed, again, ["d", "t"], "left_semi").dropDuplicates(["d", "t"])
    return join_small(keyed, again, ["d", "t"], "left_anti").unionByName(first).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a window of a benchmark item occurs.

    Null and empty texts have no words and stay; rows that repeat an id are judged each by its text, equal rows alike.
    No rows or no items: all stay.
    """
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: its files, by number, and their rows hold it.

    Null sources are one source, null texts take a byte; equal rows stay, side by side. No rows: no rows.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks in the order of the files that ``docs`` reads (of ids, where it reads none), read back.

    Null texts are empty: an end alone. Rows that repeat an id, and equal rows, are all written. No rows: no rows.
    """
    try:
        docs.select("_metadata.row_index")
        by_files = True
    except AnalysisException:  # not straight from files
        by_files = False
    path = f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    tokens.write_blocks(docs, path, Path(public_tokenizers.path("word_bpe_49k.json")).read_text(), 2, by_files)
    return tokens.read_blocks(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
