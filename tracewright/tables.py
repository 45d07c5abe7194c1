"""Tables kept in the folder that driver and executors share, and ranks that need no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import LogError


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is set, a temporary one, on a local master alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise LogError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once and read from there, where several branches of a plan would each work it out again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracewright-tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place from 1 among its group's, in ``order``: a column ``name``.

    Rows are sorted over range partitions and written with their place in the partition; the partitions' sizes (a row
    each) give where each begins, so no task holds all rows.
    """
    df = written(df, "unranked")  # the bounds of ranges are drawn from it before it is sorted
    rows = df.orderBy(group, *order).withColumn("_pid", F.spark_partition_id())
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)), "ranked")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col("_pid").alias("p")).agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = rows.join(F.broadcast(starts), F.col("_pid") == F.col("p")).withColumn("_at", F.col("_at") + F.col("start")).drop("_pid", "p", "start")
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min("_at").alias("_first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_g", "_first")


def order_statistics(df: DataFrame, value: str, shares: list[float]) -> dict[float, object]:
    """For each share q the value at place floor(n * q) (from 0) of the sorted ones, exactly; null values are left out.

    Values are counted before they are sorted, and sorted over range partitions whose totals (a row each) tell in which
    partition a place lies; only the values at the places asked for reach the driver. No values: an empty dict.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = written(counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").withColumn("p", F.spark_partition_id()), "counts")
    totals = rows.groupBy("p").agg(F.sum("n").alias("t"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(totals.select("p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"), "t"), "starts")  # a row a partition
    total = starts.agg(F.sum("t")).first()[0] or 0
    places = {q: int(total * q) for q in shares if int(total * q) < total}
    if not places:
        return {}
    inside = F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("low", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts.drop("t")), "p").withColumn("low", F.col("low") + F.col("start"))
    hit = F.lit(False)
    for at in set(places.values()):
        hit = hit | ((F.col("low") <= at) & (F.col("low") + F.col("n") > at))
    found = rows.filter(hit).select("v", "low", "n").collect()  # a row for each share at most
    return {q: next(r["v"] for r in found if r["low"] <= at < r["low"] + r["n"]) for q, at in places.items()}


def with_quantiles(df: DataFrame, value: str, shares: list[float], name: str) -> DataFrame:
    """``df`` with a column ``name``: 1 for values up to the first share's, and so on; one more than shares beyond the last."""
    df = written(df, "samples")
    cuts = order_statistics(df, value, sorted(shares))
    kind = F.lit(len(shares) + 1)
    for i, q in reversed(list(enumerate(sorted(shares), 1))):
        kind = F.when(F.col(value) <= cuts[q], i).otherwise(kind) if q in cuts else kind
    return df.withColumn(name, F.when(F.col(value).isNotNull(), kind))
