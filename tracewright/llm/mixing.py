"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in order, are cut into blocks of equal bytes. With a weight w of all slots, block k of a source is
released at slot floor(k / w) and due at ceil((k + 1) / w); earliest deadline first then puts every block between the
two, so that at any slot of the whole run each source that still has blocks has been given its weight's share within
less than one block. Weights are taken as the exact ratios of their doubles, so nothing drifts. The schedule is a row
for each block (64 KB), worked out by one task that holds a row for each source and writes as it goes. Nothing is
dropped or repeated: a source that has run out leaves its slots empty, and the others go on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, Prefix, join_small, materialise

PERIOD = 4096
#: Sources whose schedule is worked out on the driver at most; more raise an error.
MOST = 1 << 16


def whole_slots(weights: dict[str, float], period: int) -> dict[str, int]:
    """Weights rounded to whole slots of ``period``, at least one each, by largest remainders (for ``schedule``)."""
    total = sum(weights.values())
    shares = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in shares.items()}
    while (left := period - sum(slots.values())) != 0:
        by = sorted((s for s in weights if left > 0 or slots[s] > 1), key=lambda s: (slots[s] - shares[s], s), reverse=left < 0)
        for s in by[: abs(left)]:
            slots[s] += 1 if left > 0 else -1
    return slots


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratios of ``weights``."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * unit) for s, w in exact.items()}


def windows(weights: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, due, slot) of all blocks, by slot: earliest deadline first among the released ones."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 0) for s, w in weights.items() if blocks[s]]
    heapq.heapify(waiting)
    ready, t = [], 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])  # the slots of sources that have run out
        while waiting and waiting[0][0] <= t:
            release, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k, release))
        due, s, k, release = heapq.heappop(ready)
        assert release <= t < due
        yield s, k, release, due, t
        if k + 1 < blocks[s]:  # it can't go before the next slot
            heapq.heappush(waiting, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))
        t += 1


def schedule(slots: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """One period of weights that fill it: (source, block, slot)."""
    assert sum(slots.values()) == period
    return [(s, k, t) for s, k, _, _, t in windows(slots, slots)]


def place(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, block_bytes: int = 1 << 16,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix's order of ``docs``: doc_id, th, source, size, at (bytes of its source before it), block, release,
    due, slot. The order is (slot, at, doc_id, th).

    ``weights`` are the sources' shares of bytes; sources without one, and all of them by default, get their bytes
    to the power ``temperature`` (among given weights: scaled to the mean). A row belongs to the block in which it
    begins. Rows go by (doc_id, text hash), nulls first; equal rows stay separate rows. A null source is one source
    with the empty name, a null text has one byte. A row larger than a block leaves the slots of the blocks that it
    covers empty. No rows: no rows. Other columns are not read.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
    )
    prefix = Prefix(rows, ["source"], ["doc_id", "th"], ["size"], "mix")
    totals = prefix.totals.groupBy("source").agg(F.sum("_t_size").alias("n"))
    found = {r["source"]: r["n"] for r in totals.limit(MOST + 1).collect()}
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} sources")
    own = {s: float(n) ** temperature for s, n in found.items()}
    given = {s: w for s, w in (weights or {}).items() if s in found and w > 0}
    scale = sum(given.values()) / sum(own[s] for s in given) if given else 1.0
    whole = whole_weights({s: given.get(s, w * scale) for s, w in own.items()})
    blocks = {s: (n - 1) // block_bytes + 1 for s, n in found.items()}
    total = sum(whole.values())
    if any(n * total // whole[s] >= 1 << 62 for s, n in blocks.items()):
        raise ValueError("a weight is so small that its slots don't fit 63 bits")

    def run(batches):
        for _ in batches:
            rows = windows(whole, blocks)
            while some := list(islice(rows, 1 << 16)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some, strict=True)], ["source", "block", "release", "due", "slot"])

    plan = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "source string, block long, release long, due long, slot long")
    placed = prefix.sums().withColumnRenamed("before_size", "at").withColumn("block", F.floor(F.col("at") / block_bytes).cast("long"))
    placed = join_small(placed, materialise(plan, "schedule"), ["source", "block"], "inner")  # a row for each block
    return placed.select("doc_id", "th", "source", "size", "at", "block", "release", "due", "slot")


def ranked(placed: DataFrame) -> DataFrame:
    """``placed`` with ``position``: each row's place in the mix, gapless from 0."""
    prefix = Prefix(placed.withColumn("one", F.lit(1).cast("long")), [], ["slot", "at", "doc_id", "th"], ["one"], "ranks")
    return prefix.sums().drop("one").withColumnRenamed("before_one", "position")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in the mix's order: partitions, and rows within them, and so the files they are written to."""
    names = {"id_col": "doc_id", "text_col": "text"} | {k: v for k, v in how.items() if k in ("id_col", "text_col")}
    order = place(docs, **how).groupBy("doc_id", "th").agg(F.min(F.struct("slot", "at")).alias("_order")).withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    th = F.xxhash64(F.coalesce(F.col(names["text_col"]), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), F.col(names["id_col"]).alias("i"), th.alias("h"))  # whole, so that no names clash
    order = materialise(order, "order")
    few = order.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then rows aren't shuffled for the join, only for the order
    same = rows["i"].eqNullSafe(F.col("_d")) & (rows["h"] == F.col("_t"))
    return rows.join(F.broadcast(order) if few else order, same).orderBy("_order", "i", "h").select("row.*")
