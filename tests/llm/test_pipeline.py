"""The pipeline on a small corpus with planted cases, stage by stage and as a whole."""

import numpy as np
import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """400 clean documents; toxic ones (300-349), copies of 10 (400-403), near copies of 20 (410-412), leaks (420-422)."""
    rng = np.random.default_rng(9)
    clean = lambda n=80: " ".join(f"v{x}" for x in rng.integers(30_000, size=n))
    passage = clean(30)
    texts = {i: clean() for i in range(400)}
    for i in range(300, 350):
        texts[i] = "vileword " + texts[i] + " nastyword"
    for i in range(400, 404):
        texts[i] = texts[10]
    for i in range(410, 413):
        texts[i] = texts[20] + f" more{i}"
    for i in range(420, 423):
        texts[i] = clean(20) + " " + passage + " " + clean(20)
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t)) for i, t in texts.items()] + [(500, None, None, None, 0), (501, "", "en", "s1", 0), (7, texts[7], "en", "s2", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 350)) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, clean(12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        left[name] = sorted(r["doc_id"] for r in docs.collect())
        assert name == "tokens" or docs.columns == columns
    clean = [i for i in range(400) if not 300 <= i < 350] + [500, 501]
    assert left["toxicity"] == sorted([*clean, 7, *range(400, 404), *range(410, 413), *range(420, 423)])
    assert left["near_copies"] == sorted([*clean, 420, 421, 422])
    assert left["decontamination"] == left["mixing"] == left["tokens"] == sorted(clean)
    mixed, ids = spark.read.parquet(f"file://{tmp_path}/mixing"), spark.read.parquet(f"file://{tmp_path}/tokens")
    order = [r["doc_id"] for r in mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    assert [r["doc_id"] for r in ids.orderBy("start").collect()] == order != sorted(order)


def test_run(spark, corpus):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, corpus).collect()) == sorted([i for i in range(400) if not 300 <= i < 350] + [500, 501])


def test_one_row_of_near_copies_that_share_an_id_or_have_none(spark):
    text = lambda k: " ".join(f"k{k}x{i}" for i in range(60))
    rows = [(5, text(1)), (5, text(1).upper()), (None, text(2)), (None, text(2) + " more"), (None, text(3)), (8, text(3) + " end"), (9, text(4)), (9, text(5)), (9, text(5)), (6, text(6)), (7, text(6) + " x")]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], SCHEMA)
    left = [(r["doc_id"], r["text"].lower().split("x")[0]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(5, "k1"), (None, "k2"), (8, "k3"), (9, "k4"), (9, "k5"), (6, "k6")], key=str)


def test_stages_keep_columns_of_any_name_and_rows_of_any_kind(spark, corpus, tmp_path):
    long = " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [(1, long, "a", 1), (None, "x y z " * 10, None, 2), (None, "x y z " * 10, None, 2), (3, "", "b", 3), (4, None, "b", 4), (4, None, "b", 4), (5, "one two three four five six", "b", 5)]
    more = ["d", "t", "_d", "_t", "_h", "th", "row", "number", "name", "at", "i", "h", "file_name"]
    docs = spark.createDataFrame([(*r[:3], *[r[3] * 10 + k for k in range(len(more))]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in more))
    left = {"toxicity": 7, "near_copies": 5, "decontamination": 5, "mixing": 5, "tokens": 5}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        out.write.parquet(f"file://{tmp_path}/{name}")
        was, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.count() == left[name], name
        if name != "tokens":
            assert docs.columns == was.columns
            assert all([r[c] for c in more] == [r["d"] + k for k in range(len(more))] for r in docs.collect())
    assert docs.filter("doc_id = 4").first()["n_tokens"] == 1


def test_stages_without_rows(spark, corpus, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.count() == 0


def test_rows_go_by_the_numbers_of_their_files(spark, tmp_path):
    import os

    folder, ids = tmp_path / "docs", {"part-99999-a.parquet": 2, "part-100000-a.parquet": 1, "part-00007-a.parquet": 3}
    folder.mkdir()
    for name, i in ids.items():
        spark.createDataFrame([(i, f"text {i}")], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/one-{i}")
        part = next(x for x in os.listdir(tmp_path / f"one-{i}") if x.endswith(".parquet"))
        os.rename(tmp_path / f"one-{i}" / part, folder / name)
    out = corpus_pipeline.write_tokens(spark, spark.read.parquet(f"file://{folder}"), "")
    assert [r["doc_id"] for r in out.orderBy("start").collect()] == [3, 2, 1]
