"""What the operators of this subpackage share: durable tables, ordered prefix sums, checked broadcasts.

Lineage is cut with Parquet tables in the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a wrong or missing row.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__package__])  # executors need no copy of this package

#: ASCII upper- and lower-case letters, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of ASCII white space, between two words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows up to which a narrow, already materialised table is broadcast.
BROADCAST_ROWS = 400_000
#: Rows of a batch for Python: texts of 4 KB make 8 MB.
ARROW_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one, on a local master alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """While it holds, what starts hands Python ARROW_ROWS rows at once at most: an executor holds a batch several times
    outside its heap for each task, and the worker once more. The session's own number is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, ARROW_ROWS if int(before) <= 0 else min(ARROW_ROWS, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``small`` (already materialised) if it has at most ``rows`` rows, else by a shuffle."""
    return big.join(F.broadcast(small) if small.limit(rows + 1).count() <= rows else small, on, how)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Plain ``lower`` does that for texts of ASCII characters alone, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separator: str) -> Column:
    """The non-empty pieces of ``text`` between runs of ``separator``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Prefix:
    """Exclusive running sums in a global order, with no task that holds a whole group.

    Rows are range-partitioned by (group, order) and written with their partition's number. Each partition's
    totals by group give offsets (a small table: groups plus partitions rows); the sums within a partition are
    then independent of all others. A group with a third of all rows spreads over a third of the partitions.
    Rows that tie in ``order`` are told apart by where they were read, so equal rows also spread.
    """

    def __init__(self, df: DataFrame, group: Iterable[str], order: Iterable[str], measures: Iterable[str], label: str):
        self.group, self.order, self.measures = list(group), list(order), list(measures)
        keys = [*self.group, *self.order]
        df = df.withColumn("_row", F.monotonically_increasing_id())
        ranged = df.repartitionByRange(partitions(df.sparkSession), *[F.col(k).asc_nulls_first() for k in keys], "_row")
        self.rows = materialise(ranged.withColumn("_pid", F.spark_partition_id()), label)
        self.totals = self.rows.groupBy("_pid", *self.group).agg(*[F.sum(m).alias(f"_t_{m}") for m in self.measures])

    def grand_totals(self) -> list[int]:
        return [x or 0 for x in self.totals.agg(*[F.sum(f"_t_{m}") for m in self.measures]).first()]

    def sums(self) -> DataFrame:
        """The rows with ``before_<measure>`` for each measure."""
        offsets = Window.partitionBy(*self.group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        inside = (
            Window.partitionBy("_pid", *self.group)
            .orderBy(*[F.col(k).asc_nulls_first() for k in self.order], "_row")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        at = self.totals.select(
            F.col("_pid").alias("_p"),
            *[F.col(g).alias(f"_g_{g}") for g in self.group],
            *[zero(F.sum(f"_t_{m}").over(offsets)).alias(f"_o_{m}") for m in self.measures],
        )
        rows = self.rows.select("*", *[zero(F.sum(m).over(inside)).alias(f"_i_{m}") for m in self.measures])
        same = rows["_pid"] == at["_p"]
        for g in self.group:
            same = same & rows[g].eqNullSafe(at[f"_g_{g}"])
        joined = rows.join(at if self.group else F.broadcast(at), same)  # without groups: a row for each partition
        keep = [c for c in self.rows.columns if c not in ("_pid", "_row")]
        return joined.select(*keep, *[(F.col(f"_i_{m}") + F.col(f"_o_{m}")).alias(f"before_{m}") for m in self.measures])


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of texts, lower-cased in A-Z and parted by ASCII white space: offsets by text, codes, distinct words.

    Null and empty texts have none. Splitting and numbering run in Arrow's C++ code.
    """
    texts = pc.take(texts.cast(pa.large_string()), pa.array(np.arange(len(texts))))  # ascii_lower misreads slices
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = lists.values.slice(lists.offsets[0].as_py()), np.asarray(lists.offsets)
    offsets = (offsets - offsets[0]).astype(np.int64)
    flat = flat.slice(0, int(offsets[-1]))
    keep = np.asarray(pc.not_equal(flat, ""))  # ends of texts leave empty pieces
    before = np.concatenate([[0], np.cumsum(keep)])
    named = pc.dictionary_encode(flat.filter(pa.array(keep)))
    return before[offsets], np.asarray(named.indices).astype(np.int64), named.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of words; NumPy takes strings from Arrow ten times as fast as ``to_pylist``."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_numpy(zero_copy_only=False)), np.uint64, len(distinct))


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; ``np.unique`` hashes them before it sorts, which takes longer where most differ."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def release() -> None:
    """Give memory that isn't used back to the system: a worker that waits for its next task should hold little."""
    pa.default_memory_pool().release_unused()


def freeing(batches):
    """Record batches as they are; after each one, memory that isn't used goes back to the system."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives back what it doesn't need; two workers share an executor
    for batch in batches:
        yield batch
        batch = None
        release()


def chunks(batches, size: int = 8_000_000):
    """Record batches cut to at most about ``size`` bytes, so that memory follows the longest text, not the batch."""
    for batch in freeing(batches):
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        batch = None
