"""LM scoring: a word n-gram model as an Elias-Fano trie in compact, memory-mapped levels.

Level 1 has the words: sorted 63-bit hashes (Elias-Fano), whose rank is a word's number, and exact counts. Level 2
has, for each word, the words that follow it, and level 3 (order 3), for each such pair, the words that follow that:
monotone pointers (Elias-Fano) give a context's range, the followers' numbers are one Elias-Fano sequence made
monotone by adding up each context's last value, and each has a quantised count. A query finds its context's range
and searches the successor within it; discounted probabilities back off from level to level.

Levels are cut into segments of bounded size, each a file of arrays in the shared folder, written by one task under
a name that a repeated task writes again. Workers map the files; only the pages that queries touch are read.
Pairs and triples are one shuffle: a row for each pair and the word after it, so that a pair's count is the sum of
its rows. A frequent context, of either length, spreads over segments: cuts are pairs with the word after them.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano
from .shared import chunks, materialise, partitions, shared_dir, word_codes, word_hashes

END = 1  # the hash of a text's end, which is also the context of its first word
DISCOUNT = 0.75
NONE = (1 << 31) - 1  # the number of no word: what comes after an end, or after any pair in a model of order 2
CHUNK = 8_000_000  # bytes of text whose n-grams are counted at a time
SAMPLE = 2_000_000  # words, about, from which cuts between segments are chosen; results don't depend on them
SCORED = 4_000_000  # bytes scored at a time: a score takes about a hundred bytes a token


def write_arrays(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays as one file in the shared folder: count, then kinds and lengths, then data at multiples of 8 bytes."""
    head = np.array([len(arrays), *[x for a in arrays for x in (np.dtype(a.dtype).itemsize * (1 if a.dtype.kind == "u" else -1), len(a))]], np.int64)
    body = [head.tobytes(), *[a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays]]
    part = f"{name}.{uuid.uuid4().hex}"
    if urlparse(folder).scheme in ("", "file"):
        path = urlparse(folder).path
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{part}", "wb") as f:
            f.writelines(body)
        os.replace(f"{path}/{part}", f"{path}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    with store.open_output_stream(f"{path}/{part}") as f:
        f.write(b"".join(body))
    store.move(f"{path}/{part}", f"{path}/{name}")


def map_arrays(folder: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped; from a store without local paths it is fetched once for a worker."""
    where = urlparse(folder)
    path = f"{where.path}/{name}"
    if where.scheme not in ("", "file"):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        path = os.path.join(tempfile.mkdtemp(prefix="levels-"), name)
        fs.copy_files(f"{base}/{name}", path, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
    data = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain view: each access through a memmap object costs more
    count = int(data[:8].view(np.int64)[0])
    head, at, out = data[8 : 8 + 16 * count].view(np.int64), 8 + 16 * count, []
    for size, n in head.reshape(-1, 2).tolist():
        kind = np.dtype(f"{'u' if size > 0 else 'i'}{abs(size)}")
        out.append(data[at : at + abs(size) * n].view(kind))
        at += abs(size) * n + (-abs(size) * n % 8)
    return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts (words, then an end each): offsets by text, codes, hashes by code (the last code is the end)."""
    offsets, codes, distinct = word_codes(texts)
    named = word_hashes(distinct)
    hashes = np.append(np.maximum(named >> np.uint64(1), np.uint64(2)), np.uint64(END))
    n = len(offsets) - 1
    out = np.full(len(codes) + n, len(hashes) - 1, np.int64)
    ends = offsets[1:] + np.arange(n)
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = codes
    return np.concatenate([[0], ends + 1]), out, hashes


def distinct(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, from 0 to ``most``, in order, and each element's place among them, as ``np.unique`` finds them.

    Keys and their places are sorted as one number where they fit, which takes less than half as long.
    """
    bits = len(keys).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.unique(keys, return_inverse=True)
    both = np.sort((keys << bits) | np.arange(len(keys)))
    found, at = runs(both >> bits)
    back = np.empty(len(keys), np.int64)
    back[both & ((1 << bits) - 1)] = at
    return found, back


class Words:
    """Level 1: numbers and counts of hashed words."""

    def __init__(self, folder: str, pids: list[int], firsts: list[int], bases: list[int]):
        self.folder, self.pids, self.firsts, self.bases, self.open = folder, pids, np.array(firsts, np.uint64), np.array([*bases], np.int64), {}

    def segment(self, i: int):
        if i not in self.open:
            *sequence, counts = map_arrays(self.folder, f"words-{self.pids[i]}")
            self.open[i] = EliasFano(sequence), counts
        return self.open[i]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1 if unknown) and counts of hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        which = np.searchsorted(self.firsts, h, side="right") - 1
        for i in np.unique(which[which >= 0]).tolist():
            at = np.flatnonzero(which == i)
            sequence, counts = self.segment(i)
            place = sequence.find(h[at], np.zeros(len(at), np.int64), np.full(len(at), sequence.n))
            place, at = place[place >= 0], at[place >= 0]
            number[at], count[at] = place + self.bases[i], counts[place]
        return number, count


def parts_of(cuts: tuple[np.ndarray, np.ndarray], pair: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The segment of each (pair, word after it), which are sorted."""
    lo, hi = np.searchsorted(pair, cuts[0]), np.searchsorted(pair, cuts[0], side="right")
    for j in np.flatnonzero(lo < hi).tolist():
        lo[j] += np.searchsorted(after[lo[j] : hi[j]], cuts[1][j])
    return np.repeat(np.arange(len(lo) + 1, dtype=np.int32), np.diff(np.concatenate([[0], lo, [len(pair)]])))


def followers(groups: np.ndarray, follower: np.ndarray) -> list[np.ndarray]:
    """An Elias-Fano sequence of sorted followers by group: each group's go on from the last value of the one before."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(groups)]])[: len(starts)]
    added = np.concatenate([[0], np.cumsum(follower[ends - 1])[:-1]])[: len(starts)].astype(np.uint64)
    return EliasFano.build(follower.astype(np.uint64) + np.repeat(added, ends - starts))


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs of equal ones, and each element's run."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new], np.cumsum(new) - 1


def find_follower(sequence: EliasFano, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each ``word`` among the followers in [lo, hi) of its context, whose number is in ``of``, or -1."""
    out = np.full(len(word), -1, np.int64)
    below = np.zeros(len(lo), np.uint64)
    later = np.flatnonzero((hi > lo) & (lo > 0))
    below[later] = sequence[lo[later] - 1]
    some = np.flatnonzero((hi > lo)[of] & (word >= 0))
    of = of[some]
    out[some] = sequence.find(word[some].astype(np.uint64) + below[of], lo[of], hi[of])
    return out


def quantise(c: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book of counts: the lower half of the codes are exact, the others grow by a factor."""
    half = 1 << (8 * np.dtype(kind).itemsize - 1)
    book = np.concatenate([np.arange(1, half + 1), np.geomspace(half, max(half + 1, c.max(initial=1)), half + 1)[1:]])
    return np.searchsorted((book[1:] + book[:-1]) / 2, c).astype(kind), book.view(np.uint64)


class Segment:
    """Pairs and the words after them, between two cuts."""

    def __init__(self, folder: str, part: int):
        a = map_arrays(folder, f"grams-{part}")
        self.first, self.pointers, self.words, self.counts, self.book = int(a[0][0]), EliasFano(a[1:5]), EliasFano(a[5:9]), a[9], a[10].view(np.float64)
        self.next_pointers, self.next_words, self.next_counts, self.next_book = EliasFano(a[11:15]), EliasFano(a[15:19]), a[19], a[20].view(np.float64)

    @staticmethod
    def write(folder: str, part: int, pair: np.ndarray, after: np.ndarray, c: np.ndarray) -> list[int]:
        """Write sorted rows; what the driver needs of the segment's first and last words and pairs (``EDGES``)."""
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (after[1:] != after[:-1])]))
        c, pair, after = np.add.reduceat(c, new), pair[new], after[new]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        total, keys = np.add.reduceat(c, starts), pair[starts]
        context = keys >> 32
        first, last = int(context[0]), int(context[-1])
        ranges = np.searchsorted(context, np.arange(first, last + 2))
        more = after != NONE
        of = (np.cumsum(np.concatenate([[True], pair[1:] != pair[:-1]])) - 1)[more]
        next_ranges = np.searchsorted(of, np.arange(len(keys) + 1))
        arrays = [np.array([first], np.int64), *EliasFano.build(ranges), *followers(context, keys & 0xFFFFFFFF), *quantise(total, np.uint16)]
        arrays += [*EliasFano.build(next_ranges), *followers(of, after[more].astype(np.int64)), *quantise(c[more], np.uint8)]
        write_arrays(folder, f"grams-{part}", arrays)
        kinds, next_kinds = np.diff(ranges), np.diff(next_ranges)
        return [part, *(int(x[i]) for i in (0, -1) for x in (keys, kinds, total, next_kinds))]

    def pair(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs (-1: not here) and the number of words after their contexts."""
        place, kinds = np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        c = context - self.first
        at = np.flatnonzero((c >= 0) & (c < self.pointers.n - 1))
        c, of = runs(c[at])
        lo, hi = (x.astype(np.int64) for x in self.pointers.ranges(c))
        kinds[at] = (hi - lo)[of]
        place[at] = find_follower(self.words, lo, hi, of, word[at])
        return place, kinds


EDGES = ["part", "first", "first_kinds", "first_count", "first_next", "last", "last_kinds", "last_count", "last_next"]


class Model:
    """What a worker needs to find and read the levels; small, whatever the corpus: a few numbers for each segment."""

    def __init__(self, folder: str, pids: list[int], firsts: list[int], bases: list[int], total: int, order: int):
        self.folder, self.pids, self.firsts, self.bases, self.total, self.order = folder, pids, firsts, bases, total, order
        self.distinct = bases[-1]
        self.cuts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: set[int] = set()
        # words and pairs at which segments begin or end: the words after them, and the pairs' counts, over all segments
        self.edge_words = self.edge_pairs = (np.zeros(0, np.int64),) * 3
        self._words = self._open = None

    def set_edges(self, rows: list) -> None:
        words, pairs, before = {}, {}, None
        for r in sorted(rows, key=lambda r: r["part"]):
            ends = ["first"] if r["first"] == r["last"] else ["first", "last"]
            for e in ends:
                count, kinds = pairs.get(r[e], (0, 0))
                pairs[r[e]] = count + r[f"{e}_count"], kinds + r[f"{e}_next"]
            for e in ["first"] if r["first"] >> 32 == r["last"] >> 32 else ["first", "last"]:
                again = e == "first" and r["first"] == before  # the pair goes on from the segment before
                words[r[e] >> 32] = words.get(r[e] >> 32, 0) + r[f"{e}_kinds"] - again
            before = r["last"]
        self.parts = {r["part"] for r in rows}
        self.edge_words = tuple(np.array(x, np.int64) for x in zip(*sorted((w, n, 0) for w, n in words.items()), strict=True))
        self.edge_pairs = tuple(np.array(x, np.int64) for x in zip(*sorted((p, *x) for p, x in pairs.items()), strict=True))

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words, self._open = Words(self.folder, self.pids, self.firsts, self.bases), {}
        return self._words

    def segment(self, i: int) -> Segment:
        if i not in self._open:
            self._open[i] = Segment(self.folder, i)
        return self._open[i]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        n, v = max(1, self.total), self.distinct
        rest = DISCOUNT * v / n if self.total else 1.0
        return np.maximum(count - DISCOUNT, 0) / n + rest / (v + 1)

    @staticmethod
    def at_edges(edges: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are at edges, and where there."""
        if not len(edges[0]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.minimum(np.searchsorted(edges[0], keys), len(edges[0]) - 1)
        found = np.flatnonzero(edges[0][i] == keys)
        return found, i[found]

    def pairs(self, context: np.ndarray, context_count: np.ndarray, word: np.ndarray, p: np.ndarray):
        """Of pairs, sorted by numbers (-1: unknown): probabilities from those of their words; segments, places and counts."""
        n = len(word)
        kinds, place, count = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
        known = np.flatnonzero(context >= 0)
        key = (context[known] << 32) | np.maximum(word[known], 0)
        part = np.full(n, -1, np.int64)
        part[known] = parts_of(self.cuts, key, np.full(len(known), -1))
        for i in np.unique(part[known]).tolist():
            if i not in self.parts:
                continue
            at, segment = np.flatnonzero(part == i), self.segment(i)
            place[at], kinds[at] = segment.pair(context[at], word[at])
            hit = at[place[at] >= 0]
            count[hit] = segment.book[segment.counts[place[hit]]]
        at, e = self.at_edges(self.edge_words, context)
        kinds[at] = self.edge_words[1][e]
        at, e = self.at_edges(self.edge_pairs, np.where((context >= 0) & (word >= 0), (context << 32) | word, -1))
        count[at] = self.edge_pairs[1][e]
        share = np.where(kinds > 0, DISCOUNT * kinds / np.maximum(context_count, 1), 1.0)
        return np.maximum(count - DISCOUNT, 0) / np.maximum(context_count, 1) + share * p, part, place, count

    def triples(self, context: np.ndarray, word: np.ndarray, after: np.ndarray, part: np.ndarray, place: np.ndarray, count: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of words after pairs, sorted by numbers, from those that they have after the pairs' second words."""
        part, place = part.copy(), place.copy()
        key = np.where((context >= 0) & (word >= 0), (context << 32) | word, -1)
        edge, e = self.at_edges(self.edge_pairs, key)
        part[edge] = parts_of(self.cuts, key[edge], after[edge])
        seen, kinds = np.zeros(len(after)), np.zeros(len(after), np.int64)
        at_edge = np.zeros(len(after), bool)
        at_edge[edge] = True
        for i in np.unique(part[(place >= 0) | at_edge]).tolist():
            if i not in self.parts:
                continue
            segment, at = self.segment(i), np.flatnonzero(part == i)
            own = at[at_edge[at]]
            place[own] = segment.pair(context[own], word[own])[0]
            at = at[place[at] >= 0]
            contexts, of = runs(place[at])
            lo, hi = (x.astype(np.int64) for x in segment.next_pointers.ranges(contexts))
            kinds[at] = (hi - lo)[of]
            found = find_follower(segment.next_words, lo, hi, of, after[at])
            hit = found >= 0
            seen[at[hit]] = segment.next_book[segment.next_counts[found[hit]]]
        kinds[edge] = self.edge_pairs[2][e]
        count = np.maximum(count, 1)
        return np.maximum(seen - DISCOUNT, 0) / count + np.where(kinds > 0, DISCOUNT * kinds / count, 1.0) * p


def _level1(rows: DataFrame, folder: str) -> tuple[list[int], list[int], list[int], int]:
    def count(batches):
        for batch in chunks(batches, CHUNK):
            _, codes, hashes = tokens_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(codes, minlength=len(hashes)))], ["h", "c"])

    def write(batches):
        from pyspark import TaskContext

        parts = [(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if parts:
            h, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            pid = TaskContext.get().partitionId()
            write_arrays(folder, f"words-{pid}", [*EliasFano.build(h), c.astype(np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([int(h[0])]), pa.array([len(h)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["pid", "h", "n", "c"])

    counts = rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 0")
    counts = materialise(counts, "words")
    ordered = counts.repartitionByRange(partitions(rows.sparkSession), "h").sortWithinPartitions("h")
    segments = sorted(ordered.mapInArrow(write, "pid int, h long, n long, c long").collect(), key=lambda r: r["h"])  # a row for each segment
    return [r["pid"] for r in segments], [r["h"] for r in segments], [r["n"] for r in segments], sum(r["c"] for r in segments)


def train(rows: DataFrame, order: int = 2) -> Model:
    """Learn from ``rows`` (text; null: empty): n-grams of up to ``order`` (2 or 3) words. No rows: every word is unknown."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}/levels-{uuid.uuid4().hex}"
    pids, firsts, sizes, total = _level1(rows, folder)
    bases = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    if bases[-1] >= NONE:
        raise ValueError("2**31 distinct words or more")
    model = Model(folder, pids, firsts, bases, total, order)
    if not total:
        return model
    parts = 3 * partitions(spark)  # segments, and what a task sorts, stay small beside an executor

    def grams(batch, words):
        """Sorted pairs, the words after them, and their counts: each place of a text gives one row."""
        offsets, codes, hashes = tokens_of(batch.column(0))
        number, _ = words.find(hashes)
        rank = np.argsort(np.argsort(number))
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[offsets[:-1]] = len(hashes) - 1
        n = len(hashes)
        pair = rank[before] * n + rank[codes]
        ordered = np.sort(number)
        if order == 2:
            key, count = np.unique(pair, return_counts=True)
            return (ordered[key // n] << 32) | ordered[key % n], np.full(len(key), NONE), count
        key, back = distinct(pair, n * n)
        after = np.empty_like(codes)
        after[:-1] = rank[codes[1:]]
        after[offsets[1:] - 1] = n
        both, count = np.unique(back * (n + 1) + after, return_counts=True)
        key = key[both // (n + 1)]
        return (ordered[key // n] << 32) | ordered[key % n], np.append(ordered, NONE)[both % (n + 1)], count

    step = max(1, min(total, SAMPLE) // (32 * parts))

    def sample(batches):
        words = Words(folder, pids, firsts, bases)
        for batch in chunks(batches, CHUNK):
            if batch.num_rows:
                pair, after, _ = grams(batch, words)
                some = slice(xxhash.xxh3_64_intdigest(pair.tobytes()[:800]) % step, None, step)
                yield pa.RecordBatch.from_arrays([pa.array(pair[some]), pa.array(after[some])], ["pair", "after"])

    texts = rows.select("text")
    some = texts if total <= SAMPLE else texts.sample(SAMPLE / total, 17)
    found = sorted({(r["pair"], r["after"]) for r in some.mapInArrow(sample, "pair long, after long").collect()})  # about 32 rows a segment
    found = [found[i] for i in sorted({len(found) * k // parts for k in range(1, parts)})] if found else []
    cuts = model.cuts = np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64)

    def count(batches):
        words = Words(folder, pids, firsts, bases)
        for batch in chunks(batches, CHUNK):
            if batch.num_rows:
                pair, after, c = grams(batch, words)
                yield pa.RecordBatch.from_arrays([pa.array(parts_of(cuts, pair, after)), pa.array(pair), pa.array(after.astype(np.int32)), pa.array(c)], ["part", "pair", "after", "c"])

    def build(batches):
        held, part = [], None
        written = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in Segment.write(folder, part, *(np.concatenate(x) for x in zip(*held, strict=True)))], EDGES)
        for batch in batches:
            p = np.asarray(batch.column(0))
            edges = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and p[a] != part:
                    yield written()
                    held = []
                part = int(p[a])
                held.append(tuple(np.asarray(batch.column(i))[a:b] for i in (1, 2, 3)))
        if held:
            yield written()

    counted = texts.mapInArrow(count, "part int, pair long, after int, c long")
    counted = counted.repartition(parts, "part").sortWithinPartitions("part", "pair", "after")
    model.set_edges(counted.mapInArrow(build, ", ".join(f"{c} long" for c in EDGES)).collect())  # a row for each segment
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score (log10 of whole texts).

    Null texts are empty: an end alone. Words are lower-cased in A-Z and parted by ASCII white space. base_score is
    the add-one unigram's. Input columns named like the results are replaced; others may have any name. A long text is
    scored by itself, equal rows score alike, and no rows give no rows.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (*new, text_col)]

    def run(batches):
        words = model.words
        for batch in chunks(batches, SCORED):
            offsets, codes, hashes = tokens_of(batch.column(batch.num_columns - 1))
            number, count = words.find(hashes) if model.total else (np.full(len(hashes), -1), np.zeros(len(hashes), np.int64))
            before = np.empty_like(codes)
            before[1:] = codes[:-1]
            before[offsets[:-1]] = len(hashes) - 1
            # each pair and each triple once, in the order of the trie
            n = len(hashes)
            rank = np.argsort(np.argsort(number, kind="stable"), kind="stable")
            pair, back = distinct(rank[before] * n + rank[codes], n * n)
            order = np.argsort(rank, kind="stable")
            a, b = order[pair // n], order[pair % n]
            p, *found = model.pairs(number[a], count[a], number[b], model.unigram(count[b]))
            logs = np.log10(p)[back]
            if model.order > 2:
                later = np.ones(len(codes), bool)
                later[offsets[:-1]] = False
                later = np.flatnonzero(later)
                triple, to = distinct(back[later - 1] * n + rank[codes[later]], len(pair) * n)
                q, w = triple // n, order[triple % n]
                own = np.searchsorted(pair, rank[b[q]] * n + rank[w])  # the triple's later pair
                logs[later] = np.log10(model.triples(number[a[q]], number[b[q]], number[w], *(x[q] for x in found), p[own]))[to]
            base = np.log10((count + 1) / (model.total + model.distinct + 1))[codes]
            sums = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  no text is without tokens
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1], pa.array(np.diff(offsets)), pa.array(sums((count[codes] > 0).astype(np.int64))),
                    pa.array(np.full(batch.num_rows, model.total, np.int64)), pa.array(sums(base)), pa.array(sums(logs)),
                ],
                ["row", *new],
            )

    from pyspark.sql.types import DoubleType, LongType, StructType

    # the other columns in a struct, so that no name clashes
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([rows.schema["row"]])
    for c in new:
        schema = schema.add(c, DoubleType() if "score" in c else LongType())
    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in keep], *new)
