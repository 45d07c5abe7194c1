"""MinHash near-duplicates: a multi-index Hamming join of signatures, confirmed on full shingle sets.

A signature is CHUNKS x WIDTH min-hashes. Signatures within a distance (components that differ) of
2 * CHUNKS - 1 have, by the pigeonhole principle, a chunk with at most one differing component; each chunk is
therefore entered WIDTH times, with each component left out in turn, and such a pair shares an entry. Two sets of
Jaccard similarity 0.8 differ in a component with probability 0.2 and miss all entries with one of 3 in a million.

Equal sets are one class from the start. In a bucket of one entry every member is first held against the best connected;
confirmed links give components, and only members of different components are then paired, so a large group of
near copies never becomes all its pairs, and no link between components is lost. Pairs must also fit by size and
by odd sketches (both bounds are exact), and their signatures must be near, before full sets are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import chunks, freeing, join_small, materialise, word_codes, word_hashes

CHUNKS, WIDTH = 12, 6
TEXT = 2_000_000  # bytes of text whose shingles are held at a time
K = CHUNKS * WIDTH
#: Signatures of candidates further apart than this are of sets too unlike: at 0.8, one in a million is.
FAR = 32
#: 64-bit words of an odd sketch: for each of 64 * ODD places, whether an odd number of shingles falls on it. As many
#: places differ between two sketches as elements between their sets, at most.
ODD = 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``n``-word shingles of each text (of all its words, if fewer): offsets, sorted hashes."""
    offsets, codes, distinct = word_codes(texts)
    names = word_hashes(distinct)
    h = names[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.diff(offsets)
    shingles = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), shingles)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + offsets[doc]
    length = np.minimum(counts, n)[doc]
    key = length.astype(np.uint64) * M2
    for j in range(n):
        at = np.minimum(first + j, max(0, len(h) - 1))
        key = np.where(j < length, mix(key * M1 + h[at]), key) if len(h) else key
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]), key


def signatures(offsets: np.ndarray, key: np.ndarray) -> np.ndarray:
    """K 32-bit min-hashes of each set; zeros for an empty one."""
    rng = np.random.default_rng(20_240_229)
    a, b = rng.integers(1 << 32, size=K, dtype=np.uint64) | np.uint64(1), rng.integers(1 << 62, size=K, dtype=np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, K), np.uint32)
    if not len(full):
        return out
    high, low = (key >> np.uint64(32)).astype(np.uint32), key.astype(np.uint32)
    for k in range(K):
        x = (high ^ np.uint32(b[k] >> np.uint64(30))) * np.uint32(a[k]) + low * np.uint32((b[k] & np.uint64(0xFFFFFFFF)) | np.uint64(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[full, k] = np.minimum.reduceat(x, offsets[full])
    return out


def odd_sketches(offsets: np.ndarray, key: np.ndarray) -> np.ndarray:
    docs, places = len(offsets) - 1, 64 * ODD
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    odd = np.bincount(owner * places + (key % np.uint64(places)).astype(np.int64), minlength=docs * places) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, places), axis=1, bitorder="little").view("<i8")


def entries(signature: np.ndarray) -> np.ndarray:
    """The K keys of each signature: of each chunk, with each component left out in turn."""
    out = np.zeros(signature.shape, np.uint64)
    s = signature.astype(np.uint64)
    for c in range(CHUNKS):
        for left in range(WIDTH):
            x = np.full(len(s), c * WIDTH + left + 1, np.uint64)
            for j in range(WIDTH):
                if j != left:
                    x = mix(x * M1 + s[:, c * WIDTH + j])
            out[:, c * WIDTH + left] = x
    return out


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For each row of ``docs``: doc_id, th, n_shingles, component_id and ``kept`` (whether it is its component's first).

    Rows are linked whose sets of ``shingle``-word shingles share at least ``percent`` hundredths of their union;
    component_id is the smallest id reachable. Words are lower-cased in A-Z and parted by ASCII white space.

    Texts without words (null ones too) are linked with nothing. Null ids take no part in links. Rows that repeat
    an id are one node if their sets are equal, else nodes of one id, which joins their links; ``th`` tells their
    rows apart. Equal rows get equal results. Other columns are not read. No rows: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(batches):
        for batch in chunks(batches, TEXT):
            offsets, key = shingle_sets(batch.column(2), shingle)
            s = signatures(offsets, key)
            names = [xxhash.xxh3_128_digest(key[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(names, pa.binary()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array(list(odd_sketches(offsets, key)), pa.list_(pa.int64()))],
                ["doc_id", "th", "n", "set", "sig", "odd"],
            )

    sketched = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").mapInArrow(sketch, "doc_id long, th long, n long, set binary, sig binary, odd array<long>")
    sketched = materialise(sketched, "sketches")
    # one node for each distinct set, named by its smallest id
    nodes = materialise(
        sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("odd").alias("odd")), "nodes"
    )

    def enter(batches):
        for batch in freeing(batches):
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, K)
            e = entries(s).view(np.int64)
            n = len(s)
            for at in range(0, n, 2000):
                part = e[at : at + 2000]
                ids = np.repeat(np.arange(at, at + len(part)), K)
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), batch.column(0).take(pa.array(ids)), batch.column(2).take(pa.array(ids))], ["key", "id", "n"])

    entered = nodes.select("id", "sig", "n").mapInArrow(enter, "key long, id long, n long")
    sizes = entered.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialise(entered.join(sizes, "key"), "buckets")  # entries of buckets with two members or more
    # a bucket's centre is the member that meets most others, over all buckets: of a group of near copies, the text
    # that they were made from rather than one of them, which is further from the rest
    score = shared.groupBy("id", "n").agg(F.sum("size").alias("score"))
    centre = shared.select("key", "id", "n").join(score, ["id", "n"]).groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("score", "n", "id")).alias("c"))
    # node names may repeat where one id has several sets, so nodes go by (id, n)
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    stars = shared.join(centre, "key").filter(fits(F.col("n"), F.col("c.n"))).select(F.col("c.id").alias("a"), F.col("c.n").alias("an"), F.col("id").alias("b"), F.col("n").alias("bn"))
    links = _confirm(rows, nodes, stars, shingle, percent)
    found = components(links)
    place = join_small(shared.select("key", "id", "n"), found.select(F.col("node").alias("id"), "component"), ["id"], "left")
    place = place.withColumn("component", F.coalesce("component", "id"))
    mixed = place.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    odd = nodes.select("id", "n", *[F.get("odd", F.lit(i)).alias(f"o{i}") for i in range(ODD)])
    rest = materialise(place.join(mixed, "key").join(odd, ["id", "n"]), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    differ = F.expr(" + ".join(f"bit_count(x.o{i} ^ y.o{i})" for i in range(ODD)))
    close = differ <= F.floor((F.col("x.n") + F.col("y.n")) * (100 - percent) / (100 + percent) + 1e-9)  # what their sets may differ by
    apart = F.expr("x.key = y.key AND x.component < y.component") & fits(F.col("x.n"), F.col("y.n")) & close
    pairs = x.join(y, apart).select(F.col("x.id").alias("a"), F.col("x.n").alias("an"), F.col("y.id").alias("b"), F.col("y.n").alias("bn"))
    more = _confirm(rows, nodes, pairs, shingle, percent)
    # an id with several sets is one node of the graph
    links = materialise(links.union(more), "links")
    # rows of one id and unlike sets: the id stands for all of them
    twins = sketched.filter("n > 0 AND doc_id IS NOT NULL").select("set", "doc_id").distinct().join(nodes.select("set", "id"), "set").filter("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    whole = components(links.union(twins))
    out = sketched.join(whole, (sketched["doc_id"] == whole["node"]) & (sketched["n"] > 0), "left")
    return out.select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _confirm(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, an, b, bn; repeats are fine) whose sets are near enough, as (a, b)."""
    pairs = materialise(pairs.filter("a <> b").distinct(), "pairs")
    sig = lambda s: nodes.select(F.col("id").alias(s), F.col("n").alias(f"{s}n"), F.col("sig").alias(f"{s}s"))

    def near(batches):
        for batch in freeing(batches):
            s = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, K) for i in (2, 3)]
            keep = (s[0] != s[1]).sum(axis=1) <= FAR if len(s[0]) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    close = pairs.join(sig("a"), ["a", "an"]).join(sig("b"), ["b", "bn"]).select("a", "b", "as", "bs").mapInArrow(near, "a long, b long")
    close = materialise(close.distinct(), "close")
    ends = materialise(close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")

    def full(batches):
        for batch in chunks(batches, TEXT):
            offsets, key = shingle_sets(batch.column(1), shingle)
            sets = [key[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    sets = join_small(rows, ends, ["doc_id"], "left_semi").mapInArrow(full, "id long, set binary")
    sets = materialise(sets.filter(F.length("set") > 0).distinct(), "sets")  # an id with several sets has them all

    def alike(batches):
        for batch in freeing(batches):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    side = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"{s}s"))
    return materialise(close.join(side("a"), "a").join(side("b"), "b").select("a", "b", "as", "bs").mapInArrow(alike, "a long, b long").distinct(), "links")
