"""Line dedup: an exact set-similarity join of lines, with prefix, positional, length and bitmap filters.

A line is the set of its words. Lines with equal sets are one class, named by its first line in the order of
(doc_id, line number, set). Words are ordered by rarity; two sets that share ``percent`` hundredths of their union
share a word among the rarest few of each (the prefix), and its place bounds what they can share at all. Rarity is
read from a table of 2**BITS word counts over all texts: its size is fixed, and words that fall together only
change the order, which all lines have in common, never the result.

Entries (prefix word, line) are dealt by word, packed by the thousand, and sorted by size; each run of one word is
compared with the sizes that can match. Of a line's earlier candidates in a run the ROUND whose bitmaps are nearest
are verified on full sets; a line that has none that matches, but had more, is then held against all of that run.
A line is removed where some earlier line matches it, so a group of near copies never becomes all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, freeing, join_small, materialise, partitions, sorted_distinct, word_codes, word_hashes

BITS, ROUND, SLICES = 20, 6, 64
MASK = np.uint64((1 << BITS) - 1)
LINE = "doc_id long, line long, set long"
FOUND = ["doc_id", "line", "set", "x_doc", "x_line", "x_set", "t"]
#: Kinds of packed columns. Entries: words (the steps between them, ascending), sizes, places in the order of words, whether
#: first of their line, sets, doc_ids, lines, words of bitmaps.
ENTRY, PLACE = ["<u4", "<u4", "<u4", "u1", "<i8", "<i8", "<i8", "<u8"], ["<i8", "<i8", "<i8"]
FLUSH = 1_000_000  # entries that a task holds before it packs them


def line_sets(texts: pa.Array, counts: np.ndarray | None = None, only: pa.ListArray | None = None):
    """Sets of the lines with a word of each text: text, line number, set's hash, offsets, words' hashes in order.

    The order is that of ``counts`` (by place of the hash) and hash; without it, of hashes. ``only`` names the
    line numbers that are wanted of each text; the others aren't split into words.
    """
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    ends = np.asarray(lists.offsets).astype(np.int64)
    lines = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends = ends - ends[0]
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    number = np.arange(len(owner)) - ends[owner]
    if only is not None:
        of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(only)))
        wanted = ends[of] + np.asarray(only.flatten()).astype(np.int64)
        wanted = wanted[wanted < ends[of + 1]]  # another row of the same id may have fewer lines
        lines, owner, number = lines.take(pa.array(wanted)), owner[wanted], number[wanted]
    offsets, codes, distinct = word_codes(lines)
    names = word_hashes(distinct)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, counts[(names & MASK).astype(np.int64)] if counts is not None else names))] = np.arange(len(names))
    line = np.repeat(np.arange(len(lines)), np.diff(offsets))
    both = sorted_distinct((line << 32) | rank[codes])
    line = both >> 32
    ranked = np.empty(len(names), np.uint64)
    ranked[rank] = names
    words = ranked[both & 0xFFFFFFFF]
    starts = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(lines)))])
    full = np.flatnonzero(np.diff(starts))
    starts = np.append(starts[full], len(words))
    mixed = (words ^ (words >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    name = np.add.reduceat(mixed, starts[:-1]) if len(full) else np.zeros(0, np.uint64)  # sums don't depend on the order
    return owner[full], number[full], (name * np.uint64(0xC2B2AE3D27D4EB4F) ^ (name >> np.uint64(32))).view(np.int64), starts, words


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes: their lengths, then their first, second, ... bytes side by side, which compress well."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(a) for a in arrays], "<i8").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes, widths = np.frombuffer(data, "<i8", len(kinds)).tolist(), [np.dtype(k).itemsize for k in kinds]
    ends = np.cumsum([0, *(n * w for n, w in zip(sizes, widths, strict=True))]).tolist()
    planes = np.frombuffer(pa.decompress(data[8 * len(kinds) :], ends[-1], "zstd", asbytes=True), np.uint8)
    parts = zip(kinds, sizes, widths, ends, ends[1:], strict=False)
    return [planes[a:b].reshape(w, n).T.copy().view(k).reshape(n) for k, n, w, a, b in parts]


def bitmaps(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each set, four words of 64 bits: each bit the parity of the number of words that fall on it."""
    flags = np.uint64(1) << ((words >> np.uint64(56)) & np.uint64(63))
    of = words >> np.uint64(62)
    return np.stack([np.bitwise_xor.reduceat(np.where(of == k, flags, np.uint64(0)), starts[:-1]) for k in range(4)], axis=1) if len(starts) > 1 else np.zeros((0, 4), np.uint64)


def _wide(n: np.ndarray) -> np.ndarray:
    """Words of the bitmap of a set of n: so many that sets with little in common differ in more bits than they may.

    Short sets, which have few entries, may differ in one or two words alone: of these, few should share a bit.
    """
    return np.where((n >= 16) & (n < 48), 1, np.where((n >= 48) & (n < 96), 2, 4))


def _folded(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The words that are kept, side by side; parities fold."""
    wide = _wide(n)
    out = bits.copy()
    two = np.stack([bits[:, 0] ^ bits[:, 1], bits[:, 2] ^ bits[:, 3]], axis=1)
    out[wide == 2, :2] = two[wide == 2]
    out[wide == 1, 0] = (two[:, 0] ^ two[:, 1])[wide == 1]
    return out[np.arange(4) < wide[:, None]]


def _unfolded(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of one, two and four words."""
    wide = _wide(n)
    four = np.zeros((len(n), 4), np.uint64)
    four[np.arange(4) < wide[:, None]] = flat
    two = np.where((wide == 4)[:, None], np.stack([four[:, 0] ^ four[:, 1], four[:, 2] ^ four[:, 3]], axis=1), four[:, :2])
    return two[:, 0] ^ two[:, 1], two, four


def _numbers(rows: DataFrame) -> DataFrame:
    """Lines with a word of each text (doc_id, n_lines), and parts of each task's counts of words (part, counts)."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in chunks(batches):
            _, codes, distinct = word_codes(batch.column(1))
            slot = (word_hashes(distinct) & MASK).astype(np.int64)
            np.add.at(total, slot, np.bincount(codes, minlength=len(slot)))
            lines = pc.fill_null(pc.count_substring_regex(batch.column(1), r"[^\x20\x09-\x0D][^\n]*"), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), lines, pa.nulls(len(lines), pa.int32()), pa.nulls(len(lines), pa.binary())], names)
        total = total.reshape(SLICES, -1)
        parts = [i for i, x in enumerate(total) if x.any()]
        none = pa.nulls(len(parts), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(parts, pa.int32()), pa.array([pack([total[i]]) for i in parts], pa.binary())], names)

    names = ["doc_id", "n_lines", "part", "counts"]
    return materialise(rows.mapInArrow(count, "doc_id long, n_lines long, part int, counts binary"), "numbers")


def _word_counts(numbers: DataFrame) -> np.ndarray:
    """How often words of each hash occur in all texts, by the last BITS bits of the hash."""

    def add(batches):
        sums = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + unpack(data, ["<i8"])[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack([x]) for x in sums.values()], pa.binary())], ["part", "counts"])

    counts = np.zeros((SLICES, (1 << BITS) // SLICES), np.int64)
    parts = numbers.filter("part IS NOT NULL").select("part", "counts").repartition(12, "part")
    for r in parts.mapInArrow(add, "part int, counts binary").collect():  # SLICES rows at most
        counts[r["part"]] = unpack(r["counts"], ["<i8"])[0]
    return counts.reshape(-1)


def _marked(values: DataFrame) -> np.ndarray:
    """Which slots of 2**BITS the longs of a column fall on."""
    there = np.zeros(1 << BITS, bool)
    there[np.asarray(values.toDF("v").select(F.col("v").bitwiseAND(int(MASK)).alias("v")).distinct().toArrow().column("v"))] = True  # 2**BITS rows at most
    return there


def _entries(rows: DataFrame, counts: np.ndarray, percent: int, only: np.ndarray | None = None) -> DataFrame:
    """Prefix entries dealt by word: for each bucket the packed entries (``ENTRY``), and places of lines that repeat an earlier one (``PLACE``).

    Equal lines that are read together leave one's entries. ``only``: words, by slot, whose entries are wanted.
    """
    buckets = partitions(rows.sparkSession)

    def sketch(batches):
        held, size, seen = [], 0, 0

        def flush():
            doc, line, name, n, bits, of, t, pos, lead = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((line, doc, name))
            new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
            first = np.empty(len(order), np.int64)
            first[order] = order[new][np.cumsum(new) - 1]
            gone = np.flatnonzero((doc != doc[first]) | (line != line[first]))
            gone = gone[np.argsort(name[gone].view(np.uint64) % np.uint64(buckets), kind="stable")]
            mine = np.flatnonzero((first == np.arange(len(first)))[of] & (True if only is None else only[t & np.uint32(MASK)]))
            mine = mine[np.lexsort((t[mine], t[mine] % np.uint32(buckets)))]
            ends = np.searchsorted(t[mine] % np.uint32(buckets), np.arange(buckets + 1))
            gone_ends = np.searchsorted(name[gone].view(np.uint64) % np.uint64(buckets), np.arange(buckets + 1).astype(np.uint64))
            out = []
            for k in range(buckets):
                e, g = mine[ends[k] : ends[k + 1]], gone[gone_ends[k] : gone_ends[k + 1]]
                if not len(e) and not len(g):
                    continue
                o = of[e]
                own = [np.diff(t[e], prepend=np.uint32(0)), n[o].astype(np.uint32), pos[e], lead[e], name[o], doc[o], line[o], _folded(bits[o], n[o])]
                out.append((k, pack(own), pack([doc[g], line[g], name[g]]) if only is None else pack([doc[:0], line[:0], name[:0]])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "entries", "gone"])

        for batch in chunks(batches):
            owner, number, name, starts, words = line_sets(batch.column(1), counts)
            n = np.diff(starts)
            if not len(n):
                continue
            keep = _prefix(n, percent)
            at = np.repeat(np.arange(len(n)), keep)
            place = np.arange(len(at)) - np.repeat(np.cumsum(keep) - keep, keep)
            word = words[starts[at] + place]
            shared = counts[(word & MASK).astype(np.int64)] > 1  # a word of one line alone leads nowhere
            at, place, word = at[shared], place[shared], word[shared]
            lead = np.concatenate([[1], at[1:] != at[:-1]]).astype(np.uint8)[: len(at)]
            held.append((np.asarray(batch.column(0))[owner], number, name, n, bitmaps(words, starts), at + seen, (word >> np.uint64(16)).astype(np.uint32), (place + 1).astype(np.uint32), lead))
            size, seen = size + len(at), seen + len(n)
            if size >= FLUSH:
                yield from flush()
                held, size, seen = [], 0, 0
        if held:
            yield from flush()

    return rows.mapInArrow(sketch, "bucket int, entries binary, gone binary")


def _candidates(entries: DataFrame, percent: int, late: np.ndarray | None = None) -> DataFrame:
    """Lines and earlier ones that may match: (doc_id, line, set, x_doc, x_line, x_set, t).

    With null x and t: the line repeats an earlier one. With null x alone: it has more candidates by the word t than
    the ROUND that are listed. ``late``: lines, by slot of their sets, all whose candidates are wanted, and no others.
    """

    def compare(batches):
        parts, gone = [], []
        for batch in freeing(batches):
            for data, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t, *rest = unpack(data, ENTRY)
                parts.append((np.cumsum(t, dtype=np.uint32), *rest))
                gone.append(unpack(places, PLACE))
        if not parts:
            return
        *cols, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        t, n, pos, lead, name, doc, line = cols
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        one, two, four = _unfolded(flat, n)
        parts = flat = None
        order = np.empty(len(t), np.int64)
        order[np.lexsort((name, line, doc))] = np.arange(len(t))
        # of equal sets the earliest stands for all
        by = np.lexsort((order, name, t))
        new = np.concatenate([[True], (t[by][1:] != t[by][:-1]) | (name[by][1:] != name[by][:-1])])[: len(by)]
        first = by[new][np.cumsum(new) - 1]
        again = (lead[by] > 0) & ((doc[by] != doc[first]) | (line[by] != line[first]))
        if late is None:
            gone.append([doc[by[again]], line[by[again]], name[by[again]]])
            places = [np.concatenate(x) for x in zip(*gone, strict=True)]
            none = pa.nulls(len(places[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in places), none, none, none, none], FOUND)
        by = by[new]
        by = by[np.lexsort((n[by], t[by]))]
        many = np.zeros(len(by), bool)
        many[:-1] = t[by][1:] == t[by][:-1]
        many[1:] |= many[:-1]
        by = by[many]
        t, n, pos, name, doc, line, order, one, two, four = (x[by] for x in (t, n, pos, name, doc, line, order, one, two, four))
        wide = _wide(n)
        wanted = None if late is None else late[name & np.int64(MASK)]
        found, held = [], 0
        keep = np.zeros((0, 3), np.int64)
        more = np.zeros(0, np.int64)

        def settle():
            nonlocal keep, more, found, held
            pairs = np.concatenate([keep, *found])
            if late is None:
                pairs = pairs[np.lexsort((order[pairs[:, 1]], pairs[:, 2], pairs[:, 0]))]
                start = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else np.zeros(0, np.int64)
                nth = np.arange(len(pairs)) - np.repeat(start, np.diff(np.append(start, len(pairs))))
                more = np.union1d(more, pairs[nth >= ROUND, 0])
                pairs = pairs[nth < ROUND]
            keep, found, held = pairs, [], 0

        def listed():
            y, x = keep[:, 0], keep[:, 1]
            arrays = [doc[y], line[y], name[y], doc[x], line[x], name[x]]
            return pa.RecordBatch.from_arrays([*(pa.array(a) for a in arrays), pa.array(t[y].astype(np.int64))], FOUND)

        i = np.arange(len(t) - 1)
        shift = 1
        while len(i):
            i = i[i + shift < len(t)]
            j = i + shift
            live = (t[i] == t[j]) & (n[i] * 100 >= percent * n[j])  # sizes ascend: no later one can fit either
            i, j = i[live], j[live]
            both = n[i] + n[j]
            need = -(-percent * both // (100 + percent))
            ok = np.flatnonzero(1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            most = both - 2 * need
            ok = ok[np.bitwise_count(one[i[ok]] ^ one[j[ok]]) <= most[ok]]
            for least, bits in ((2, two), (4, four)):
                a, b = i[ok], j[ok]
                ok = ok[(np.minimum(wide[a], wide[b]) < least) | (np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most[ok])]
            a, b = i[ok], j[ok]
            swap = order[a] > order[b]
            apart = np.where(np.minimum(wide[a], wide[b]) < 4, np.bitwise_count(one[a] ^ one[b]), np.bitwise_count(four[a] ^ four[b]).sum(axis=1)).astype(np.int64)
            pairs = np.stack([np.where(swap, a, b), np.where(swap, b, a), apart], axis=1)  # the later one, the earlier one, their distance
            if wanted is not None:
                pairs = pairs[wanted[pairs[:, 0]]]
            found.append(pairs)
            held += len(pairs)
            if held > 2_000_000:
                settle()
                if late is not None:
                    yield listed()
                    keep = keep[:0]
            shift += 1
        settle()
        yield listed()
        none = pa.nulls(len(more), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc[more]), pa.array(line[more]), pa.array(name[more]), none, none, none, pa.array(t[more].astype(np.int64))], FOUND)

    dealt = entries.repartitionById(partitions(entries.sparkSession), F.col("bucket"))
    return dealt.mapInArrow(compare, f"{LINE}, x_doc long, x_line long, x_set long, t long")


def _removed(rows: DataFrame, numbers: DataFrame, percent: int) -> DataFrame:
    counts = _word_counts(numbers)
    found = materialise(_candidates(_entries(rows, counts, percent), percent), "found")
    place, pair = ["doc_id", "line", "set"], ["doc_id", "line", "set", "x_doc", "x_line", "x_set"]
    repeats = found.filter("x_set IS NULL AND t IS NULL").select(*place)
    pairs = materialise(found.filter("x_set IS NOT NULL").select(*pair).distinct(), "pairs")
    settled = materialise(_verify(rows, pairs, percent).select(*place).distinct(), "settled")
    # lines that had more candidates than were looked at, and none that matched
    open_ = found.filter("x_set IS NULL AND t IS NOT NULL").select(*place, "t").join(settled, place, "left_anti")
    open_ = materialise(open_, "open")
    if not open_.isEmpty():
        # all lines by those words once more: slots may hold others too, which the join leaves out
        late = _candidates(_entries(rows, counts, percent, _marked(open_.select("t"))), percent, _marked(open_.select("set")))
        late = materialise(late.select(*pair).distinct().join(open_.select(*place).distinct(), place, "left_semi"), "pairs")
        settled = settled.union(_verify(rows, late, percent).select(*place))
    return repeats.union(settled)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")


def _places(rows: DataFrame) -> DataFrame:
    """doc_id, line and set of all lines with a word, one row for each place."""

    def read(batches):
        for batch in chunks(batches):
            owner, number, name, *_ = line_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[owner]), pa.array(number), pa.array(name)], ["doc_id", "line", "set"])

    return rows.mapInArrow(read, LINE).distinct()


def find_removed(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Lines of ``docs`` and those among them to remove, as (doc_id, line, set) each, one row for each place.

    A line is removed where a line before it, in the order of (doc_id, line number, set), shares at least
    ``percent`` hundredths of the union of their words. Words are lower-cased in A-Z and parted by ASCII white
    space; lines without words (so null and empty texts) are never removed and not listed. Rows that repeat an id
    are ordered by their sets; a repeated equal row has the same places and so one verdict. Null ids are left out.
    No rows: no rows. Other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    return _places(rows), _removed(rows, _numbers(rows), percent).distinct()


def _verify(rows: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (materialised) whose sets match, from the texts that hold them."""
    ends = pairs.select("doc_id", "line", "set").union(pairs.select("x_doc", "x_line", "x_set")).distinct()
    mine = [F.collect_set("set").alias("sets"), F.collect_set("line").alias("lines")]  # a text's own lines
    wanted = materialise(ends.groupBy("doc_id").agg(*mine), "wanted")

    def read(batches):
        for batch in chunks(batches):
            owner, _, name, starts, words = line_sets(batch.column(1), only=batch.column(3))
            sets = [set(x) for x in batch.column(2).to_pylist()]
            ids = batch.column(0).to_pylist()
            some = [i for i, (o, s) in enumerate(zip(owner.tolist(), name.tolist(), strict=True)) if s in sets[o]]
            data = [words[starts[i] : starts[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array([ids[owner[i]] for i in some], pa.int64()), pa.array(name[some] if some else [], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "set", "words"])

    sets = join_small(rows, wanted, ["doc_id"], "inner").mapInArrow(read, "doc_id long, set long, words binary")
    sets = materialise(sets.dropDuplicates(["set"]).select("set", "words"), "sets")

    def match(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(6)], ["doc_id", "line", "set", "x_doc", "x_line", "x_set"])

    full = pairs.join(sets, "set").join(sets.select(F.col("set").alias("x_set"), F.col("words").alias("x_words")), "x_set")
    return full.select("doc_id", "line", "set", "x_doc", "x_line", "x_set", "words", "x_words").mapInArrow(match, f"{LINE}, x_doc long, x_line long, x_set long")


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each id: n_lines (lines with a word), ``removed`` (their numbers, ascending) and n_removed."""
    rows = _rows(docs, id_col, text_col)
    numbers = _numbers(rows)
    gone = _removed(rows, numbers, percent).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    lines = numbers.filter("part IS NULL").groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("rows"))
    # rows that repeat an id may share places
    again = materialise(lines.filter("rows > 1").select("doc_id"), "again")
    own = _places(join_small(rows, again, ["doc_id"], "left_semi")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    out = lines.join(own, "doc_id", "left").join(gone, "doc_id", "left")
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    n = F.when(F.col("rows") > 1, F.coalesce("own", F.lit(0))).otherwise(F.col("n_lines")).cast("long")
    return out.select("doc_id", n.alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))
