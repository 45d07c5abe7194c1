"""What keeps operators within memory and time: batches, words at hand."""

import json
from pathlib import Path

import numpy as np
import pyarrow as pa

import public_tokenizers
from tracewright.llm import shared, tokens

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_tables_are_written_in_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(ROWS)
    got = [r["n"] for r in shared.materialise(spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 9000 and max(got) <= shared.ARROW_ROWS and spark.conf.get(ROWS) == before


def test_words_of_several_chunks_stay_at_hand(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS", 300)
    text = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    ids = tokens.Ids(text, "<u2", tokens.Ids.ends(json.loads(text)))
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    often = [f"often{name(i)}" for i in range(40)]
    for k in range(8):
        chunk = [" ".join(often + [f"rare{name(1000 * k + i)}!" for i in range(100)]), "X " * 3, None]
        got, starts = ids.of_texts(pa.array(chunk), 2)
        want = [[*ids.whole.encode(t or "", add_special_tokens=False).ids, 2] for t in chunk]
        assert [got[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
        if k > 1:
            assert all(w in ids.number for w in often) and len(ids.number) < 600


def test_ids_of_a_batch_are_read_at_once():
    rows = [[1, 2, 70], [2], [9, 9]]
    data = pa.array([np.array(x, "<u2").tobytes() for x in rows], pa.binary())
    assert tokens.joined_ids(pa.array([3, 1, 2]), data).tolist() == [1, 2, 70, 2, 9, 9]
    assert tokens.joined_ids(pa.array([3, 1, 2]).slice(1), data.slice(1)).tolist() == [2, 9, 9]
    assert len(tokens.joined_ids(pa.array([], pa.int64()), pa.array([], pa.binary()))) == 0


def test_line_dedup_packs_entries_and_tells_long_lines_apart(spark):
    from tracewright.llm import linedups

    # lines of more words than 64 bits tell apart, which all share their rarest word; two of them match
    rng = np.random.default_rng(3)
    lines = [["rare", *(f"w{j}" for j in rng.choice(600, 110, replace=False))] for _ in range(80)]
    lines[70] = [*lines[20][:-3], "other"]
    docs = spark.createDataFrame([(i, "\n \n" + " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string")
    rows = linedups._rows(docs, "doc_id", "text")
    numbers = linedups._numbers(rows)
    entries = linedups._entries(rows, linedups._word_counts(numbers), 80)
    assert entries.count() <= 4 * entries.rdd.getNumPartitions()  # a row for each task and bucket, not for each entry
    found = linedups._candidates(entries, 80).filter("x_set IS NOT NULL").select("doc_id", "x_doc").distinct().collect()
    assert [tuple(r) for r in found] == [(70, 20)]
    got = {r["doc_id"]: (r["n_lines"], r["removed"]) for r in linedups.dedup_lines(docs).collect()}
    assert got == {i: (1, [2] if i == 70 else []) for i in range(80)}


def test_ids_of_large_chunks(monkeypatch):
    # distinct pieces are looked up once a chunk: 2.5 MB of text are one, and its ids are those of small ones
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    rng = np.random.default_rng(11)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 3000, 5000)) for _ in range(100)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    assert 2_400_000 < batch.nbytes < 2_900_000
    assert len(list(shared.chunks([batch], tokens.CHUNK))) == 1
    last = tokens.Ids.ends(json.loads(tokenizer))
    ids, starts = tokens.Ids(tokenizer, "<u2", last).of_texts(texts, 2)
    again = tokens.Ids(tokenizer, "<u2", last)
    parts = [again.of_texts(texts.slice(i, 10), 2)[0] for i in range(0, 100, 10)]
    assert (np.concatenate(parts) == ids).all() and starts[-1] == len(ids)


def test_distinct_keys_and_places():
    from tracewright.llm import ngram

    rng = np.random.default_rng(12)
    for n, most in ((0, 5), (1, 1), (5000, 900), (5000, 1 << 50), (5000, (1 << 62) - 1)):
        keys = rng.integers(0, most + 1, n) if n else np.zeros(0, np.int64)
        want, back = np.unique(keys, return_inverse=True)
        got, places = ngram.distinct(keys, most)
        assert (got == want).all() and (places == back).all()
