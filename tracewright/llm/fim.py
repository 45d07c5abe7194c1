"""Fill-in-the-middle: a stated share of the texts is cut in three and put in another order, between markers.

DuckDB works inside ``mapInArrow``: each piece of a batch is registered as a table, cut and joined by SQL over its
lists of units, and comes back as Arrow. Rows stay where they are: nothing is shuffled, sorted or gathered.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Runs of ASCII letters, and every other code point by itself.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Bytes of text that DuckDB holds as units at a time, if no single text is longer.
HELD = 2_000_000

_SQL = f"""
WITH cut AS (
  SELECT i, text, regexp_extract_all(text, '{UNIT}') AS u, sha256('{{seed}}:' || id) AS h FROM piece),
drawn AS (
  SELECT i, text, u, len(u) AS n,
    ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
           OR ('0x' || h[17:24])::BIGINT % 100 >= 100 - {{plain}} THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT i, text, n, form,
    CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, 1, least(a, b)), ''), '') END AS p,
    CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), ''), '') END AS m,
    CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, greatest(a, b) + 1, n), ''), '') END AS s FROM drawn)
SELECT i, n, form, length(p) AS prefix_chars, length(m) AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM parts"""


def _transform(seed: int, plain: int, spm: int):
    query = _SQL.format(seed=seed, plain=plain, spm=spm)
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches):
        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        try:
            for batch in chunks(batches, HELD):
                ids, texts = batch.column("id"), batch.column("text")
                con.register("piece", pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "id": ids, "text": texts}))
                # one thread keeps the order; the numbers put it right if that should change
                made = con.sql(query).to_arrow_table().sort_by("i")
                con.unregister("piece")
                yield pa.record_batch(
                    [batch.column("row"), *[made[c].combine_chunks().cast(t) for c, t in kinds]], names=["row", *[c for c, _ in kinds]]
                )
        finally:
            con.close()

    return run


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Cut each text at two of its ends of units, drawn by a hash of the seed and the id, and put the middle last.

    A unit is a run of A-Z and a-z or any other code point. Returns a struct ``row`` with the input's columns (those
    in ``keep``, if given), ``n`` (units), ``form`` (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle;
    ``plain``: as it was), ``prefix_chars`` and ``middle_chars`` (code points; null where plain) and ``output``.

    Null and empty texts, and texts that hold a marker, are plain, so that ``restore`` is exact. A null id draws like
    an empty one. Draws depend on seed and id alone: equal rows, and rows that repeat an id, are cut alike where their
    units are as many, and no row depends on another. A long text is held by itself, in units of 16 bytes. No rows: no
    rows. Input columns of any name are safe inside ``row``.
    """
    rows = docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = StructType([rows.schema["row"], *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")])
    return rows.mapInArrow(_transform(seed, plain_percent, spm_percent), kind)


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of: no part holds a marker, so each marker stands once."""
    psm = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{SUFFIX}|{MIDDLE}", 3)  # prefix, suffix, middle
    spm = F.split(F.substr(output, F.lit(len(SUFFIX) + 1)), f"{PREFIX}|{MIDDLE}", 3)  # suffix, prefix, middle
    return (
        F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
    )
