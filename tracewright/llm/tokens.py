"""Token-ID output: token ids in blocks of a static range asymmetric numeral system (rANS).

Files are Parquet tables of blocks, so that Spark's commit protocol guards them and any store will do. One
frequency table, counted over all tokens and scaled to 2**SCALE, serves all blocks. A block holds whole documents;
its ids are cut into segments of LANES x STEPS. Each segment is LANES interleaved rANS states over one stream of
32-bit words, and a checkpoint (where its words begin, its states) lets it be decoded on its own; here all segments
of a block decode side by side. Checksums guard the table, each block's bytes and its ids.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, freeing, materialise, partitions, release

SCALE, LANES, STEPS, BLOCK = 20, 32, 512, 1 << 20
SEGMENT = LANES * STEPS
LOW = 1 << 31
MAGIC = b"TWR1"
HEAD = "<4sIIIII"  # mark, ids, segments, words, checksum of the table, checksum of the rest
#: Distinct words whose ids a task keeps at hand; beyond them, those that several chunks had stay.
WORDS = 100_000
#: A run of letters whose lower-case forms are one character each and which no normal form changes, and
#: the ASCII signs that make one run of their own after it (an apostrophe may begin an ending).
LETTERS, SIGNS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}", r"!-&(-/:-@\[-`{-~"
CHUNK = 3_000_000  # bytes of text cut into pieces at a time: each chunk looks its distinct pieces up


class Ids:
    """Ids of texts that a tokenizer splits at white space: each word's are found once, and a text's put together.

    Texts are cut at ASCII white space and their distinct pieces numbered in Arrow. A piece of plain letters, and maybe
    signs after them, has the ids of the lower-case word and of the signs; all others go to the tokenizer as they are.
    """

    def __init__(self, tokenizer_json: str, kind: str, last: np.ndarray):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole, self.kind, self.last = Tokenizer.from_str(tokenizer_json), kind, last
        # words of lower-case letters need neither normalising nor the search for runs of letters; the model is shared
        self.light = Tokenizer(self.whole.model)
        self.light.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    @staticmethod
    def ends(vocab: dict) -> np.ndarray:
        """Which ids end a word."""
        ids = vocab["model"]["vocab"]
        last = np.zeros(max(ids.values()) + 1, bool)
        last[[i for t, i in ids.items() if t.endswith(vocab["model"]["end_of_word_suffix"])]] = True
        return last

    @staticmethod
    def fits(vocab: dict) -> bool:
        """Whether white space is dropped, what is left becomes bytes, and ids mark ends of words, so that none spans two."""
        first, *rest = (vocab["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        bytewise = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0]["use_regex"]
        return bool(vocab["model"].get("end_of_word_suffix")) and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and bytewise

    def _forget(self) -> None:
        """Start with the empty string alone, whose number is 0."""
        self.number, self.ids, self.starts, self.uses = {"": 0}, np.zeros(0, self.kind), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def _keep_used(self) -> None:
        """Forget all but words that several chunks had; all, if these are many."""
        old, ids, starts, kept = list(self.number), self.ids, self.starts, np.flatnonzero(self.uses > 1)
        self._forget()
        kept = kept[kept > 0]
        if len(kept) <= WORDS // 2:
            sizes = np.diff(starts)[kept]
            ends = np.cumsum(sizes)
            self._keep([old[i] for i in kept.tolist()], ids[np.repeat(starts[kept] - ends + sizes, sizes) + np.arange(sizes.sum())], ends)

    def _keep(self, texts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.number.update(zip(texts, range(len(self.starts) - 1, len(self.starts) - 1 + len(texts)), strict=True))
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, len(self.ids) + ends])
        self.uses = np.concatenate([self.uses, np.zeros(len(texts), np.int64)])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and their ends, from the tokenizer as it is."""
        found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array([i for ids in found for i in ids], self.kind), np.cumsum([len(x) for x in found], dtype=np.int64)

    def of_words(self, words: list[str]) -> np.ndarray:
        """Numbers of lower-case words, each one run of letters, whose last id ends it."""
        new = [w for w in words if w not in self.number]
        found = self.light.encode_batch_fast([" ".join(new[i : i + 500]) for i in range(0, len(new), 500)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, self.kind), *[np.array(e.ids, self.kind) for e in found]])
        self._keep(new, ids, np.flatnonzero(self.last[ids]) + 1)
        return np.array([self.number[w] for w in words], np.int64)

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: numbers of their first and second parts; ids by number, and where each number's begin."""
        if len(self.number) > WORDS:
            self._keep_used()
        first, second = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        cut = pc.extract_regex(pieces, f"^(?P<letters>[{LETTERS}]+)(?P<signs>[{SIGNS}]*)$")
        plain = np.asarray(pc.is_valid(cut))
        cut = cut.filter(pa.array(plain))
        for part, to in ((0, first), (1, second)):
            named = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(cut, part)))
            texts = named.dictionary.to_numpy(zero_copy_only=False).tolist()
            if part:
                new = [x for x in texts if x not in self.number]
                self._keep(new, *self._whole(new))
                numbers = np.array([self.number[x] for x in texts], np.int64)
            else:
                numbers = self.of_words(texts)
            self.uses[numbers] += 1
            to[plain] = numbers[np.asarray(named.indices)] if len(texts) else 0
        ids, ends = self._whole(pieces.filter(pa.array(~plain)).to_pylist())
        first[~plain] = np.arange(len(ends)) + len(self.starts) - 1
        return first, second, np.concatenate([self.ids, ids]), np.concatenate([self.starts, len(self.ids) + ends])

    def of_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each with its end, one after the other, and where each begins (and the last one ends)."""
        texts = pc.take(pc.fill_null(texts.cast(pa.large_string()), ""), pa.array(np.arange(len(texts))))
        lists = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        named = pc.dictionary_encode(lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
        offsets, codes = offsets - offsets[0], np.asarray(named.indices)
        first, second, ids, starts = self.of_pieces(named.dictionary)
        both = np.stack([first[codes], second[codes]], axis=1).ravel()
        both = np.insert(both, 2 * offsets[1:], len(starts) - 1)  # an end after each text
        ids, starts = np.append(ids, np.array([end_id], self.kind)), np.append(starts, len(ids) + 1)
        sizes = np.diff(starts)[both]
        before = np.concatenate([[0], np.cumsum(sizes)])
        small = np.int32 if max(len(ids), int(before[-1])) < 1 << 31 else np.int64  # half the memory
        out = ids[np.repeat((starts[both] - before[:-1]).astype(small), sizes) + np.arange(before[-1], dtype=small)]
        return out, before[2 * offsets + np.arange(len(offsets))]


class Tables:
    """Frequencies of ids, scaled to a sum of 2**SCALE, with those of ids that occur at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._symbol = None

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Tables:
        total, size = max(1, int(counts.sum())), 1 << SCALE
        there = counts > 0
        if there.sum() > size:
            raise ValueError(f"more than {size} distinct ids")
        freq = np.where(there, np.maximum(1, counts.astype(np.float64) * size // total), 0).astype(np.int64)
        if not there.any():
            freq[0] = size
        order = np.argsort(-freq, kind="stable")
        spare = size - int(freq.sum())
        if spare > 0:
            freq[order[0]] += spare
        for i in order:  # rounding up the rare ids took from the frequent ones
            if spare >= 0:
                break
            take = min(-spare, max(0, int(freq[i]) - 1), max(1, int(freq[i]) // 2))
            freq[i] -= take
            spare += take
        return cls(freq) if spare >= 0 else cls._tight(freq, size)

    @classmethod
    def _tight(cls, freq: np.ndarray, size: int) -> Tables:
        while (over := int(freq.sum()) - size) > 0:
            large = np.flatnonzero(freq > 1)
            freq[large[np.argsort(-freq[large], kind="stable")][:over]] -= 1
        return cls(freq)

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode_block(ids: np.ndarray, tables: Tables) -> bytes:
    n = len(ids)
    segments = -(-n // SEGMENT)
    # positions past the end have an id of certainty, which leaves a state as it is
    freq, start = np.full(segments * SEGMENT, 1 << SCALE, np.uint64), np.zeros(segments * SEGMENT, np.uint64)
    freq[:n], start[:n] = tables.freq[ids], tables.start[ids]
    freq, start = (x.reshape(segments, STEPS, LANES).transpose(1, 0, 2).copy() for x in (freq, start))
    x = np.full((segments, LANES), LOW, np.uint64)
    full, words = np.zeros((STEPS, segments, LANES), bool), np.zeros((STEPS, segments, LANES), np.uint32)
    limit, up, scale = np.uint64(63 - SCALE), np.uint64(32), np.uint64(SCALE)
    for t in range(STEPS - 1, -1, -1):
        f = freq[t]
        out = x >= (f << limit)
        full[t], words[t] = out, x  # the low half
        x = np.where(out, x >> up, x)
        q = x // f
        x = (q << scale) + (x - q * f) + start[t]
    counts = full.sum(axis=(0, 2)).astype("<u4")
    stream = words.transpose(1, 0, 2)[full.transpose(1, 0, 2)].astype("<u4")
    rest = counts.tobytes() + x.astype("<u8").tobytes() + stream.tobytes()
    return struct.pack(HEAD, MAGIC, n, segments, len(stream), tables.crc, zlib.crc32(rest)) + rest


def decode_block(data: bytes, tables: Tables, segments: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of a block, or of its segments from one up to another."""
    mark, n, count, words, table, crc = struct.unpack_from(HEAD, data)
    if mark != MAGIC or table != tables.crc or zlib.crc32(data[struct.calcsize(HEAD) :]) != crc:
        raise ValueError("damaged block, or not of these frequencies")
    a, b = segments or (0, count)
    own = np.frombuffer(data, "<u4", count, struct.calcsize(HEAD)).astype(np.int64)
    x = np.frombuffer(data, "<u8", count * LANES, struct.calcsize(HEAD) + 4 * count).reshape(count, LANES)[a:b].astype(np.uint64)
    stream = np.append(np.frombuffer(data, "<u4", words, struct.calcsize(HEAD) + 4 * count + 8 * LANES * count), 0).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(own)[:-1]])[a:b]
    left = np.clip(n - np.arange(a, b) * SEGMENT, 0, SEGMENT)[:, None] - np.arange(LANES)[None, :]
    out = np.zeros((STEPS, b - a, LANES), np.uint32)
    mask, scale, up, low = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32), np.uint64(LOW)
    for t in range(STEPS):
        live = left > t * LANES
        if not live.any():
            break
        slot = x & mask
        s = tables.symbol[slot]
        y = tables.freq[s] * (x >> scale) + slot - tables.start[s]
        need = live & (y < low)
        seen = np.cumsum(need, axis=1)
        take = np.where(need, at[:, None] + seen - 1, len(stream) - 1)
        x = np.where(live, np.where(need, (y << up) | stream[take], y), x)
        at = at + seen[:, -1]
        out[t] = s
    return out.transpose(1, 0, 2).reshape(-1)[: max(0, min(n, b * SEGMENT) - a * SEGMENT)]


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, pid and seq: rows ranged and sorted by id, then text, with their partition and place in it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # rows that tie go by their texts' hash, so that one id in a third of all rows spreads
    keys = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return ranged.select("doc_id", "text", F.spark_partition_id().alias("pid"), at.alias("seq"))


def placed_by_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``placed`` for rows whose order is that of the files which ``docs`` reads: by part number, name and row. No shuffle."""
    name = F.col("_metadata.file_name")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), name.alias("name"), F.col("_metadata.row_index").alias("seq"))
    number = F.regexp_extract("name", r"^part-(\d+)", 1).try_cast("long")  # as text, the names of many files don't go by their numbers
    files = materialise(rows.select("name").distinct(), "files")  # a row for each file
    files = files.select(F.col("name").alias("n"), (F.row_number().over(Window.orderBy(number, "name")) - 1).alias("pid"))
    return rows.join(F.broadcast(files), F.col("name") == F.col("n")).select("doc_id", "text", "pid", "seq")


def tokenise(rows: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Ids of whole texts of ``placed`` rows: pid, seq, doc_id, n, ids (little-endian)."""
    vocab = json.loads(tokenizer_json)
    top = max([end_id, *vocab["model"]["vocab"].values(), *(t["id"] for t in vocab["added_tokens"])])
    kind = "<u2" if top < 1 << 16 else "<u4"
    width = np.dtype(kind).itemsize
    by_word = Ids.fits(vocab)
    last = Ids.ends(vocab) if by_word else None

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Ids(tokenizer_json, kind, last) if by_word else Tokenizer.from_str(tokenizer_json)
        for batch in chunks(batches, CHUNK):
            if by_word:
                ids, starts = tokenizer.of_texts(batch.column(1), end_id)
            else:
                found = tokenizer.encode_batch_fast(pc.fill_null(batch.column(1), "").to_pylist(), add_special_tokens=False)
                every = [np.array([*e.ids, end_id], kind) for e in found]
                ids, starts = np.concatenate([np.zeros(0, kind), *every]), np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64)
            n = batch.num_rows
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts * width), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(3), batch.column(0).cast(pa.int64()), pa.array(np.diff(starts)), data],
                ["pid", "seq", "doc_id", "n", "ids"],
            )
        tokenizer = ids = starts = data = None
        release()

    return rows.mapInArrow(run, "pid int, seq long, doc_id long, n long, ids binary")


def joined_ids(n: pa.Array, data: pa.Array) -> np.ndarray:
    """The ids of all rows, one after the other, from their numbers of ids and their bytes."""
    data = data.cast(pa.large_binary())
    ends = np.asarray(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]) if len(data) else np.zeros(1, np.int64)
    size = int(ends[-1] - ends[0])
    return np.frombuffer(data.buffers()[2], f"<u{size // pc.sum(n).as_py()}", pc.sum(n).as_py(), int(ends[0])) if size else np.zeros(0, np.uint16)


def write_blocks(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 2, by_files: bool = False, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise all texts, in ascending order of ids, or ``by_files`` as ``docs`` reads them, and write blocks under ``path``.

    Each text's ids are those that the tokenizer gives for the whole text, without special tokens, and ``end_id``.
    Null texts are empty. Null ids come first; rows with equal keys are all written, ordered by their texts. No
    rows: an empty table. Other columns are not read. A text is never cut; one larger than a block has its own.
    """
    rows = placed_by_files(docs, id_col, text_col) if by_files else placed(docs, id_col, text_col)
    ids = materialise(tokenise(rows, tokenizer_json, end_id), "ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in freeing(batches):
            found = np.bincount(joined_ids(batch.column(0), batch.column(1)))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["id", "n"])

    counts = ids.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary
    freq = np.zeros(max([end_id, *(r["id"] for r in counts)]) + 1, np.int64)
    for r in counts:
        freq[r["id"]] = r["n"]
    tables = Tables.of_counts(freq)

    def encode(batches):
        held, head, size = [], None, 0

        def block():
            parts = [np.frombuffer(x[3], f"<u{len(x[3]) // x[2]}") for x in held]
            every = np.concatenate(parts).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([head[0]], pa.int32()), pa.array([head[1]], pa.int64()), pa.array([len(every)], pa.int64()),
                    pa.array([[x[1] for x in held]], pa.list_(pa.int64())), pa.array([[x[2] for x in held]], pa.list_(pa.int64())),
                    pa.array([zlib.crc32(every.astype("<u4").tobytes())], pa.int64()), pa.array([encode_block(every, tables)], pa.binary()),
                ],
                ["pid", "first", "n_tokens", "doc_ids", "lengths", "ids_crc32", "data"],
            )

        for batch in freeing(batches):
            for pid, seq, doc, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (pid != head[0] or seq != head[1] + len(held) or size + n > BLOCK):
                    yield block()
                    held, size = [], 0
                if not held:
                    head = (pid, seq)
                held.append((seq, doc, n, data))
                size += n
        if held:
            yield block()

    spark = docs.sparkSession
    ids.mapInArrow(encode, "pid int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, ids_crc32 long, data binary").write.parquet(f"{path}/blocks")
    table = spark.createDataFrame([(bytearray(tables.freq.astype("<u4").tobytes()), tables.crc)], "freq binary, crc long")
    table.coalesce(1).write.parquet(f"{path}/table")


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What the files hold: doc_id, start (ids before it in the order of writing), n_tokens, ids_crc32, maybe ids."""
    row = spark.read.parquet(f"{path}/table").first()  # one row
    tables = Tables(np.frombuffer(bytes(row["freq"]), "<u4"))
    if tables.crc != row["crc"]:
        raise ValueError("damaged table")

    def decode(batches):
        for batch in freeing(batches):
            for pid, first, docs, lengths, crc, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                raw = decode_block(data, tables).astype("<u4").tobytes()
                if zlib.crc32(raw) != crc:
                    raise ValueError("ids differ from those written")
                ends = np.cumsum(lengths) * 4
                parts = [raw[b - 4 * n : b] for n, b in zip(lengths, ends.tolist(), strict=True)]
                arrays = [
                    pa.array(np.full(len(docs), pid, np.int32)), pa.array(np.full(len(docs), first, np.int64)), pa.array(docs, pa.int64()),
                    pa.array(ends // 4 - lengths), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["pid", "first", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in parts], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "pid int, first long, doc_id long, inside long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    docs = blocks.select("pid", "first", "doc_ids", "lengths", "ids_crc32", "data").mapInArrow(decode, schema)
    # where each block starts: by partition (a row for each), then within it
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("pid").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    by_part = blocks.groupBy(F.col("pid").alias("p")).agg(F.sum("n_tokens").alias("t")).select("p", zero(F.sum("t").over(before)).alias("o"))
    starts = blocks.select("pid", "first", zero(F.sum("n_tokens").over(within)).alias("i")).join(F.broadcast(by_part), F.col("pid") == F.col("p"))
    starts = starts.select("pid", "first", (F.col("i") + F.col("o")).alias("block_start"))
    out = docs.join(starts, ["pid", "first"])
    return out.select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
