"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Features are the distinct words, their stems, pairs of neighbours and pairs one word apart, hashed to 2**BITS
places; a stem is a word's first STEMS letters, which inflected and compound forms share. Each place has its own learning rate, and the L1 term leaves most weights at nought, so that the model is a short list of
(place, weight): at most 2**BITS of them, whatever the corpus, and so safe to send to all executors.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, freeing, sorted_distinct, word_codes

BITS = 20
CHUNK = 2_000_000  # bytes of text whose words are numbered at a time
SLICE = 250_000  # words whose pairs are hashed at a time, so that memory doesn't follow the longest text's features
STEMS = (4, 6)
#: Ends of a word that aren't part of it for features.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
GAPS = ((1, M2), (2, M3))


def _place(key: np.ndarray) -> np.ndarray:
    return (((key ^ (key >> np.uint64(29))) * M2) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed features of texts as sorted ``text << BITS | place``; of all places, or of those ``wanted``."""
    offsets, codes, distinct = word_codes(texts)
    words = [w.strip(PUNCTUATION) for w in distinct.to_numpy(zero_copy_only=False)]
    named = lambda found, salt: np.array([xxhash.xxh3_64_intdigest(w, salt) for w in found], np.uint64)
    h = named(words, 0)
    single = [_place(h * M1), *[_place(named([w[:k] for w in words], k) * M1) for k in STEMS]]
    single = [(x, wanted[x] if wanted is not None else np.ones(len(x), bool)) for x in single]
    first, second = h * M1, [h * m for _, m in GAPS]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(codes), SLICE):
        own, doc = (x[a : a + SLICE + 2] for x in (codes, docs))  # and the two words that pairs reach into
        some = []
        for place, keep in single:
            hit = keep[own[:SLICE]]
            some.append((doc[:SLICE][hit] << BITS) | place[own[:SLICE][hit]])
        for (gap, _), late in zip(GAPS, second, strict=True):
            if len(own) > gap:
                x, y = own[:SLICE][: len(own) - gap], own[gap:][:SLICE]
                place = _place(first[x] + late[y])
                hit = doc[: len(x)] == doc[gap:][: len(y)]
                if wanted is not None:
                    hit &= wanted[place]
                some.append((doc[: len(x)][hit] << BITS) | place[hit])
        out.append(sorted_distinct(np.concatenate(some)))
    return sorted_distinct(np.concatenate(out))


class Ftrl:
    """FTRL-proximal with a rate for each coordinate (McMahan and others, 2013)."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.zb = self.nb = 0.0  # the intercept, without L1

    def weights(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        z, n = self.z[at], self.n[at]
        w, b = self.weights(z, n, self.l1), float(self.weights(self.zb, self.nb, 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.zb += g - (np.sqrt(self.nb + g * g) - np.sqrt(self.nb)) / self.alpha * b
        self.nb += g * g


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most about ``max_rows`` labelled rows, drawn by a hash of the id: places, weights, intercept.

    ``labels`` has 0/1 labels by id; of labels that contradict each other the larger counts. Rows without one are left
    out, as are null ids and labels; null texts are empty, and rows that repeat an id are all learnt. With no rows
    the model says 0.5 throughout.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).filter("_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(known.filter(drawn), "_id")

    def featurise(batches):
        for batch in chunks(batches, CHUNK):
            found = features(batch.column(2))
            ends = np.searchsorted(found >> BITS, np.arange(batch.num_rows + 1))
            place = (found & ((1 << BITS) - 1)).astype("<u4")
            data = [place[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["h", "y", "data"])

    def fit(batches):
        model, sizes, ys = Ftrl(alpha, beta, l1, l2), [], []
        with tempfile.TemporaryFile() as held:  # the task's own, for its epochs; gone with it
            for batch in freeing(batches):
                ys += batch.column(0).to_pylist()
                for x in batch.column(1).to_pylist():
                    sizes.append(len(x))
                    held.write(x)
            for _ in range(epochs):
                held.seek(0)
                for y, n in zip(ys, sizes, strict=True):
                    model.learn(np.frombuffer(held.read(n), "<u4").astype(np.int64), y)
        w = model.weights(model.z, model.n, l1)
        at = np.flatnonzero(w)
        at = np.append(at, 1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(w, model.weights(model.zb, model.nb, 0.0))[at])], ["at", "w"])

    features_ = rows.select(F.xxhash64("_id", F.lit(1)).alias("h"), "y", "text").mapInArrow(featurise, "h long, y int, data binary")
    ordered = features_.repartition(1).sortWithinPartitions("h", "y", "data").select("y", "data")  # one bounded sample, learnt in turn
    found = ordered.mapInArrow(fit, "at long, w double").collect()  # at most 2**BITS + 1 rows
    weights = {r["at"]: r["w"] for r in found}
    intercept = weights.pop(1 << BITS, 0.0)
    at = np.array(sorted(weights), np.int64)
    return at, np.array([weights[i] for i in at.tolist()]), intercept


def _probability(texts: pa.Array, dense: np.ndarray, intercept: float) -> np.ndarray:
    found = features(texts, dense != 0)
    total = np.bincount(found >> BITS, dense[found & ((1 << BITS) - 1)], minlength=len(texts)) + intercept
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, from whole texts. Null and empty texts score as the intercept does.

    Input columns keep their order; one named like ``out_col`` is replaced. Equal texts score alike, however long. All
    columns pass through Python: where rows are wide, score their keys and texts and join.
    """
    at, weights, intercept = model
    kept = [c for c in docs.columns if c != out_col]
    docs = docs.select(*kept)
    col = kept.index(text_col)

    def run(batches):
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        for batch in chunks(batches, CHUNK):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_probability(batch.column(col), dense, intercept))], schema=pa.schema([*batch.schema, pa.field(out_col, pa.float64())]))

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out_col, DoubleType()))


def toxic_rows(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and th (the text's hash) of the rows of ``docs`` that score ``least`` or more: texts don't come back."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    at, weights, intercept = model

    def run(batches):
        dense = np.zeros(1 << BITS)
        dense[at] = weights
        for batch in chunks(batches, CHUNK):
            bad = pa.array(_probability(batch.column(2), dense, intercept) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(bad), batch.column(1).filter(bad)], ["doc_id", "th"])

    from pyspark.sql.types import StructType

    return rows.mapInArrow(run, StructType(rows.schema.fields[:2]))
