"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts earlier go.

Suffixes are ordered through ``length`` bytes only, by passes from the most significant digit on; those alone in their
group leave after each pass, and the groups that are left at the end are exactly the repeated windows.

The first digits are drawn so that a suffix need not be shuffled for each byte of text. Among the grams of a window,
the one of the smallest hash, the leftmost where they tie, is the window's anchor; equal windows have equal anchors at
equal distances. All windows that share an anchor travel as one row with the first digit, the gram's hash; the second
digit hashes the stretch of text that they cover together. Rows that agree in both hold the same windows: all but the
earliest are repeats. Rows alone in their first digit are unique. What is left, the first rows of unlike stretches
around one gram, gets its bytes, and the passes go on over them, eight bytes at a time.

Equal rows meet first in their batch, so a passage that many documents hold is a row a batch, not a row a document. A
gram around which more than ``CROWD`` unlike stretches stand isn't taken to one task: the first digit is drawn out, first
to what a fifth of the windows have in common, and where that is a crowd's too, to whole windows, whose groups are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Prefix, chunks, join_small, materialise, partitions

#: Unlike stretches around one gram that one task orders.
CROWD = 1_024
#: Starts of windows that are looked at together, and bytes of texts and of stretches that are held at a time.
BLOCK, HELD, ORDERED = 4_000_000, 4_000_000, 4_000_000

_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64(0xFFFFFF)
_AT = 2**31


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _gram_hashes(data: np.ndarray, gram: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, from prefix sums of a polynomial."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    for _ in range(2):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _least(keys: np.ndarray, wide: int) -> np.ndarray:
    """The least of each run of ``wide`` keys, by running minima from both ends of blocks."""
    n = len(keys) - wide + 1
    blocks = np.concatenate([keys, np.full(-len(keys) % wide, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, wide)
    right = np.minimum.accumulate(blocks, axis=1).ravel()[wide - 1 : wide - 1 + n]
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(left, right)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes as maximal runs, in the order of (doc, start)."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    _, number = np.unique(doc, return_inverse=True)
    far = np.int64(2**32) * number  # a document's runs never reach the next one's
    until = np.maximum.accumulate(end + far)
    fresh = np.concatenate([[True], (start + far)[1:] > until[:-1]])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], until[last] - far[first]


def _anchors(length: int):
    """Rows of documents to rows (k, c, d, q, span): the digits k and c of a stretch, the document d, q with the
    document's number among those of its id and the anchor's place, and span with what stands before the anchor and
    the number of further windows; or, with a negative span, bytes that are repeats already, from q's place on."""
    gram = max(1, length * 24 // 100)
    wide = length - gram + 1
    schema = pa.schema([("k", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("q", pa.int64()), ("span", pa.int32())])
    up = down = np.zeros(0, np.uint64)

    def stretches(data: np.ndarray, ends: np.ndarray):
        """(first window, windows after it, anchor) of each stretch; windows lie within one text, whose end is known."""
        nonlocal up, down
        if len(data) < length:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        if len(up) < len(data):
            up, down = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 2**64), len(data))
        h = _gram_hashes(data, gram, up, down)
        least = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), wide)
        at = (least & _PLACE).astype(np.int64)
        starts = np.flatnonzero(np.arange(len(at)) + length <= ends[: len(at)])
        at = at[starts]
        fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (np.diff(starts) != 1)])) if len(at) else starts
        more = np.diff(np.concatenate([fresh, [len(at)]])) - 1
        return starts[fresh], more, at[fresh], h[at[fresh]]

    def rows(d: np.ndarray, seq: np.ndarray, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        ends = np.repeat(offsets[1:], sizes)
        for low in range(0, max(1, len(whole) - length + 1), BLOCK):
            data = whole[low : low + BLOCK + length - 1]
            first, more, at, k = stretches(data, ends[low : low + len(data)] - low)
            if not len(first):
                continue
            held = data.tobytes()
            c = np.fromiter(
                (xxhash.xxh3_64_intdigest(held[a:b], s) for a, b, s in zip(first.tolist(), (first + more + length).tolist(), (at - first).tolist(), strict=True)),
                np.uint64, len(first),
            )
            doc = np.searchsorted(offsets, low + first, side="right") - 1
            first, at = (x + low - offsets[doc] for x in (first, at))
            place = seq[doc] * _AT + at
            order = np.lexsort((place, d[doc], c, k))
            k, c, doc, first, more, at, place = (x[order] for x in (k, c, doc, first, more, at, place))
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            span = ((at - first) << 15) + more
            yield k[new].view(np.int64), c[new].view(np.int64), d[doc[new]], place[new], span[new]
            gone = ~new
            own, start, end = _merged(doc[gone], first[gone], (first + more + length)[gone])
            yield d[own] * 0x5851F42D4C957F2D, np.zeros(len(own), np.int64), d[own], seq[own] * _AT + start, start - end

    def run(batches):
        for batch in chunks(batches, HELD):
            for out in rows(np.asarray(batch.column("d")), np.asarray(batch.column("seq")), batch.column("text")):
                yield pa.record_batch([pa.array(x).cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _classes(length: int):
    """Rows in the order of (k, c, d, q) to runs of repeated bytes (k null, q the place of the first, span their number)
    and to the first rows of unlike stretches of one k."""
    schema = pa.schema([("k", pa.int64()), ("d", pa.int64()), ("q", pa.int64()), ("span", pa.int32())])

    def run(batches):
        held = None  # the last row, and whether it is out already
        for batch in batches:
            if not batch.num_rows:
                continue
            k, c, d, q, span = (np.asarray(batch.column(x)) for x in ("k", "c", "d", "q", "span"))
            done = span < 0
            if done.any():
                yield pa.record_batch([pa.nulls(int(done.sum()), pa.int64()), d[done], q[done], -span[done]], schema=schema)
                k, c, d, q, span = (x[~done] for x in (k, c, d, q, span))
            if not len(k):
                continue
            if held:
                k, c, d, q, span = (np.concatenate([[x], y]) for x, y in zip(held[:5], (k, c, d, q, span), strict=True))
            same_k = k[1:] == k[:-1]
            repeat = np.concatenate([[False], same_k & (c[1:] == c[:-1])])
            first = ~repeat
            # a first row is wanted if another class of its k stands before or after it
            heads = np.flatnonzero(first)
            near = k[heads[1:]] == k[heads[:-1]]
            wanted = np.zeros(len(k), bool)
            wanted[heads[1:][near]] = True
            wanted[heads[:-1][near]] = True
            fresh = np.ones(len(k), bool)
            if held:
                fresh[0] = False  # the row held over is told once
                if wanted[0] and not held[5]:
                    fresh[0] = True
                repeat[0] = False
            out = wanted & first & fresh
            gone = repeat & fresh
            lead, more = span >> 15, span & 0x7FFF
            yield pa.record_batch(
                [pa.array(np.concatenate([np.zeros(gone.sum(), np.int64), k[out]]), mask=np.arange(gone.sum() + out.sum()) < gone.sum()), np.concatenate([d[gone], d[out]]),
                 np.concatenate([(q - lead)[gone], q[out]]), np.concatenate([(more + length)[gone], span[out]]).astype(np.int32)], schema=schema,
            )
            last = heads[-1]  # the class that the next batch may go on with
            held = (k[last], c[last], d[last], q[last], span[last], bool(wanted[last]) or bool(held and last == 0 and held[5]))

    return run


def _stretches(length: int):
    """Texts with the rows asked of them to (k, d, q, span, bytes)."""

    def run(batches):
        for batch in chunks(batches, HELD):
            texts = batch.column("text").cast(pa.large_binary())
            asked = batch.column("asked")
            of = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths()))
            k, q, span = (np.asarray(asked.flatten().field(x)) for x in ("k", "q", "span"))
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at = (offsets - offsets[0])[of] + (q & (_AT - 1)) - (span >> 15)
            whole = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if len(of) else b""
            parts = [whole[a:b] for a, b in zip(at.tolist(), (at + (span & 0x7FFF) + length).tolist(), strict=True)]
            yield pa.record_batch([k, np.asarray(batch.column("d"))[of], q, span, pa.array(parts, pa.binary())], names=["k", "d", "q", "span", "bytes"])

    return run


def repeated_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``data`` (by their number in ``starts``) that equal another one of their group, and the numbers
    of their classes: radix passes from the first bytes on, which the windows alone in a class leave."""
    words = np.ndarray(len(data) - 7, ">u8", data.tobytes(), strides=(1,))
    left = np.arange(len(starts))
    for depth in [None, *range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        digit = np.zeros(len(left), np.uint64) if depth is None else words[starts[left] + depth].astype(np.uint64)
        order = np.lexsort((digit, groups))
        groups, digit, left = groups[order], digit[order], left[order]
        new = np.concatenate([[True], (groups[1:] != groups[:-1]) | (digit[1:] != digit[:-1])]) if len(left) else np.zeros(0, bool)
        alone = new & np.concatenate([new[1:], [True]]) if len(left) else new
        groups, left = np.cumsum(new)[~alone], left[~alone]
    return left, groups


def _ordered(length: int):
    """Stretches in the order of k to runs of bytes (d, q, span) that repeat an earlier window."""

    def order(table: pa.Table):
        k, d, q, span = (np.asarray(table[x]) for x in ("k", "d", "q", "span"))
        held = table["bytes"].combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2], np.uint8)
        lead, n = (span >> 15).astype(np.int64), (span & 0x7FFF).astype(np.int64) + 1
        of = np.repeat(np.arange(len(k)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        # windows are equal only where their anchors stand at the same place in them
        number = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        left, group = repeated_windows(data, offsets[of] + step, number[of] * 0x10000 + (lead[of] - step), length)
        place = (q - lead)[of[left]] + step[left]
        turn = np.lexsort((place, d[of[left]], group))
        later = turn[np.concatenate([[False], group[turn][1:] == group[turn][:-1]])] if len(turn) else turn
        place, own = place[later], d[of[left]][later]
        turn = np.lexsort((place, own))  # documents of one id are told apart by the upper part of their places
        place, own = place[turn], own[turn]
        doc = np.cumsum(np.concatenate([[0], (own[1:] != own[:-1]) | (place[1:] // _AT != place[:-1] // _AT)]).astype(np.int64)) if len(turn) else turn
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(turn) else turn
        own, seq = own[heads], place[heads] // _AT
        doc, start, end = _merged(doc, place % _AT, place % _AT + length)
        return pa.record_batch([own[doc], seq[doc] * _AT + start, (end - start).astype(np.int32)], names=["d", "q", "span"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < ORDERED:
                continue
            table = pa.Table.from_batches(held)
            k = np.asarray(table["k"])
            cut = int(np.searchsorted(k, k[-1]))  # the last k may go on
            if cut:
                yield order(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), table.slice(cut).nbytes
        if size:
            yield order(pa.Table.from_batches(held))

    return run


def _refined(length: int, width: int):
    """Stretches to shorter ones under a longer first digit: their windows by ranges of ``width`` places of the anchor,
    and all bytes that the windows of a range have in common. Equal ones of a batch become one, and the others runs of
    repeated bytes (k null)."""
    top = length - max(1, length * 24 // 100)  # the last place of an anchor
    schema = pa.schema([("k", pa.int64()), ("d", pa.int64()), ("q", pa.int64()), ("span", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch in chunks(batches, HELD // 4):
            k, d, q, span = (np.asarray(batch.column(x)) for x in ("k", "d", "q", "span"))
            parts = batch.column("bytes").to_pylist()
            lead, low = (span >> 15).astype(np.int64), (span >> 15).astype(np.int64) - (span & 0x7FFF)
            n = lead // width - low // width + 1
            of = np.repeat(np.arange(len(k)), n)
            place = (low // width)[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            last, first = np.minimum(lead[of], (place + 1) * width - 1), np.maximum(low[of], place * width)
            ends = [x.tolist() for x in (lead[of] - last, lead[of] - first + length, lead[of] - place * width, lead[of] - np.minimum((place + 1) * width - 1, top) + length)]
            seeds = (k.view(np.uint64)[of] * np.uint64(_BASE) + place.astype(np.uint64)).tolist()
            own, new, same = [], np.empty(len(of), np.uint64), np.empty(len(of), np.uint64)
            for j, (i, a, b, x, y, seed) in enumerate(zip(of.tolist(), *ends, seeds, strict=True)):
                own.append(parts[i][a:b])
                new[j] = xxhash.xxh3_64_intdigest(parts[i][x:y], seed)
                same[j] = xxhash.xxh3_64_intdigest(own[j], int(last[j]))
            order = np.lexsort((q[of], d[of], same, new))
            head = np.concatenate([[True], (new[order][1:] != new[order][:-1]) | (same[order][1:] != same[order][:-1])]) if len(order) else order.astype(bool)
            keep, gone = order[head], order[~head]
            spans = (last << 15) + last - first
            yield pa.record_batch(
                [pa.array(np.concatenate([new[keep].view(np.int64), np.zeros(len(gone), np.int64)]), mask=np.arange(len(order)) >= len(keep)), d[of][np.concatenate([keep, gone])],
                 np.concatenate([q[of][keep], (q[of] - last)[gone]]), np.concatenate([spans[keep], (last - first + length)[gone]]).astype(np.int32),
                 pa.array([own[j] for j in keep.tolist()] + [None] * len(gone), pa.binary())], schema=schema,
            )

    return run


def _kept():
    """Texts with their runs of repeats to (row, copies, n_removed, n_spans, kept)."""

    def run(batches):
        for batch in chunks(batches, HELD):
            texts, runs = batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("runs")
            n = np.asarray(runs.value_lengths().fill_null(0))
            of = np.repeat(np.arange(batch.num_rows), n)
            q, span = (np.asarray(runs.flatten().field(x)).astype(np.int64) for x in ("q", "span"))
            own, start, end = _merged(of, q % _AT, q % _AT + span)
            removed = np.bincount(own, (end - start), batch.num_rows).astype(np.int64)
            spans = np.bincount(own, minlength=batch.num_rows)
            cuts = np.concatenate([[0], np.cumsum(spans)])
            kept = []
            for i, text in enumerate(texts):
                a, b = start[cuts[i] : cuts[i + 1]].tolist(), end[cuts[i] : cuts[i + 1]].tolist()
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)) if a else text)
            yield pa.record_batch([batch.column("d"), batch.column("unnamed"), batch.column("copies"), pa.array([len(t) for t in texts], pa.int64()), removed, spans.astype(np.int64), pa.array(kept, pa.binary())], names=["d", "unnamed", "copies", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, unnamed, seq, copies, text): each (id, text) once, and each text's number among those of its id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("d"), F.col(id_col).isNull().alias("unnamed"), text.alias("text"), F.xxhash64(text).alias("th")
    )
    some = materialise(rows.groupBy("d").count().filter("count > 1").select("d"), "again")
    if some.isEmpty():
        return rows.select("d", "unnamed", F.lit(0).cast("long").alias("seq"), F.lit(1).cast("long").alias("copies"), "text")
    again = materialise(join_small(rows.select("d", "unnamed", "th"), some, ["d"], "left_semi").groupBy("d", "unnamed", "th").agg(F.count(F.lit(1)).alias("copies")), "again")
    placed = Prefix(again.withColumn("one", F.lit(1).cast("long")), ["d"], ["unnamed", "th"], ["one"], "again").sums()
    placed = materialise(placed.select("d", F.col("unnamed"), "th", "copies", (F.col("before_one")).alias("seq")), "again")
    plain = join_small(rows, some, ["d"], "left_anti").select("d", "unnamed", F.lit(0).cast("long").alias("seq"), F.lit(1).cast("long").alias("copies"), "text")
    others = join_small(rows, some, ["d"], "left_semi").dropDuplicates(["d", "unnamed", "th"]).join(placed, ["d", "unnamed", "th"])
    return plain.unionByName(others.select("d", "unnamed", "seq", "copies", "text"))


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove from each text, as UTF-8 bytes, those covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or an earlier start in the same document; strings are judged on the input, and overlaps
    count. Returns for each row doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: what is
    left may cut a character).

    Null and empty texts, and those under ``length`` bytes, stay as they are. Null ids come first. Unlike texts of one
    id are documents of their own, in the order of a hash; of rows that repeat an id and its text, one counts as the
    first and the others as its copies. Texts of any length are looked at in blocks that overlap, and windows never
    cross documents. No rows: no rows. Other columns aren't read, whatever their names.
    """
    if not 8 <= length < 2**15:
        raise ValueError("windows have 8 to 32,767 bytes")
    texts = _numbered(docs, id_col, text_col)
    anchors = texts.select("d", "seq", "text").mapInArrow(_anchors(length), "k long, c long, d long, q long, span int")
    dealt = anchors.repartition(partitions(docs.sparkSession), "k").sortWithinPartitions("k", "c", "d", "q")
    classes = materialise(dealt.mapInArrow(_classes(length), "k long, d long, q long, span int"), "classes")
    seq = F.shiftright("q", 31).alias("seq")
    asked = classes.filter("k IS NOT NULL").groupBy("d", seq).agg(F.collect_list(F.struct("k", "q", "span")).alias("asked"))
    cut = texts.select("d", "seq", "text").join(asked, ["d", "seq"]).select("d", "text", "asked")
    stretches = materialise(cut.mapInArrow(_stretches(length), "k long, d long, q long, span int, bytes binary"), "stretches")
    runs, few = [classes.filter("k IS NULL").select("d", "q", "span")], []
    shape = "k long, d long, q long, span int, bytes binary"
    for width in (-(-length // 5), 1):
        crowds = materialise(stretches.groupBy("k").count().filter(F.col("count") > CROWD).select("k"), "crowds")
        few.append(join_small(stretches, crowds, ["k"], "left_anti"))
        stretches = materialise(join_small(stretches, crowds, ["k"], "left_semi").mapInArrow(_refined(length, width), shape), "stretches")
        runs.append(stretches.filter("k IS NULL").select("d", "q", "span"))
        stretches = stretches.filter("k IS NOT NULL")
    # single windows now: equal bytes are a group, of which only the first is needed
    first = stretches.groupBy("bytes").agg(F.min(F.struct("d", "q")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = stretches.join(first, "bytes").filter("d <> first.d OR q <> first.q")
    runs.append(later.select("d", (F.col("q") - F.shiftright("span", 15)).alias("q"), F.lit(length).alias("span")))
    for more in few[1:]:
        few[0] = few[0].unionByName(more)
    dealt = few[0].repartition(partitions(docs.sparkSession), "k").sortWithinPartitions("k")
    runs.append(dealt.mapInArrow(_ordered(length), "d long, q long, span int"))
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    by_text = every.groupBy("d", seq).agg(F.collect_list(F.struct("q", "span")).alias("runs"))
    whole = texts.join(by_text, ["d", "seq"], "left").select("d", "unnamed", "copies", "text", "runs")
    out = whole.mapInArrow(_kept(), "d long, unnamed boolean, copies long, n_bytes long, n_removed long, n_spans long, kept binary")
    # copies of a whole row: the first as it was judged, the others covered wherever they have a window
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    covered = (F.col("copy") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        F.when(~F.col("unnamed"), F.col("d")).alias("doc_id"), "n_bytes", F.when(covered, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(covered, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(covered, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
