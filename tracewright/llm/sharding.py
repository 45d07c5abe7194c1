"""Sharding: contiguous shards of equal bytes, cut from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix


def shard_contiguous(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Deal ``docs`` to ``n_shards`` contiguous shards whose byte sizes are as near equal as whole rows allow.

    Rows are taken in ascending order of (id, CRC-32 of the text). A row belongs to the shard in whose equal
    share of all bytes its middle byte lies, so a shard's size is off its share by at most half of the rows at
    its two ends. Returns a struct ``row`` with the input's columns (those in ``keep``, if given), plus ``size`` (UTF-8 bytes of the text and
    1), ``text_crc32`` (unsigned), ``shard`` and ``slot`` (gapless from 0 within the shard).

    Null text: size 1, checksum 0, like an empty text. Null ids come first. Equal rows stay separate rows, next
    to each other. A text larger than a share leaves some shards empty. No rows: no rows. Input columns of any
    name are safe inside ``row``.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"),
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit(1).cast("long").alias("one"),
    )
    prefix = Prefix(rows, [], ["_id", "text_crc32"], ["size", "one"], "shards")
    total = max(1, prefix.grand_totals()[0])
    middle = (F.lit(2) * F.col("before_size") + F.col("size")).cast("decimal(38,0)") * n_shards
    cut = F.least(F.floor(middle / F.lit(2 * total)).cast("int"), F.lit(n_shards - 1)).alias("shard")
    placed = prefix.sums().select("row", "size", "text_crc32", "before_one", cut)
    first = placed.groupBy(F.col("shard").alias("_s")).agg(F.min("before_one").alias("_first"))
    slot = (F.col("before_one") - F.col("_first")).alias("slot")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_s")).select("row", "size", "text_crc32", "shard", slot)  # n_shards rows
