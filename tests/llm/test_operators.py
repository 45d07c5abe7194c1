"""Each operator against brute force on a small table of odd rows: nulls, empty and long texts, ties, repeated rows,
extra columns whose names clash with the operators' own."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tracewright.llm import chat, components, decontam, linedups, minhash, mixing, ngram, quality, queries, sharding, tokens, toxicity
from tracewright.llm.eliasfano import EliasFano

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, size string, score string, n string, removed string, _id int, row string"


def make(spark, rows):
    more = (7, "size", "score", "n", "removed", 3, "row")
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *more) for i, t, s in rows], SCHEMA).repartition(3)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in SPACE.split(lower) if w]


BASE = [f"w{i * i % 97}x{i % 13} " for i in range(160)]
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my ny xi omikron"
ROWS = [
    (0, None, "a"), (1, "", "a"), (2, "  \n\t ", None), (3, "One", "b"), (4, "ONE", "b"), (5, "".join(BASE), "a"), (6, "".join(BASE), "a"), (6, "".join(BASE), "a"),
    (7, "".join(BASE[:150] + ["new words here "]), "a"), (8, "".join(BASE[:80]), "c"), (9, LINE + "\n" + LINE.replace("xi", "pi") + "\n\n" + LINE + "\nshort line", "a"),
    (10, (LINE + " ").upper() * 9, "b"), (11, "É é $$ # | ok " + LINE + " the end\x0bof it", "b"), (12, "line one here\nline two is here\n" * 3, None),
    (13, "x" * 70_000 + " " + "long text " * 3_000, "a"), (None, "no id at all " + LINE, "a"), (14, "".join(BASE[::-1]), "d"), (15, "the quick brown fox jumps over the lazy dog again and again", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, ROWS).limit(0)


def test_sharding(docs, none):
    rows = sharding.shard_contiguous(docs, 4).collect()
    assert len(rows) == len(ROWS) and rows[0]["row"]["size"] == "size"
    sizes = {(i, t): len((t or "").encode()) + 1 for i, t, _ in ROWS}
    assert all(r["size"] == sizes[r["row"]["doc_id"], r["row"]["text"]] and r["text_crc32"] == zlib.crc32((r["row"]["text"] or "").encode()) for r in rows)
    key = lambda r: (r["row"]["doc_id"] if r["row"]["doc_id"] is not None else -1, r["text_crc32"])
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r) for r in ordered] == sorted(map(key, rows))
    total, before = sum(r["size"] for r in rows), 0
    for r in ordered:
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        before += r["size"]
    for s in range(4):
        assert [r["slot"] for r in ordered if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_contiguous(none, 4).count() == 0


def removed_lines(rows):
    places = sorted({(i, n, frozenset(words(line))) for i, t, _ in rows if i is not None for n, line in enumerate((t or "").split("\n")) if words(line)}, key=lambda p: (p[0], p[1]))
    out = {}
    for k, (i, n, s) in enumerate(places):
        out.setdefault(i, [0, []])
        out[i][0] += 1
        if any(100 * len(s & o) >= 80 * len(s | o) for *_, o in places[:k]):
            out[i][1].append(n)
    return out


def test_line_dedup(spark, docs, none):
    want = removed_lines(ROWS)
    got = {r["doc_id"]: [r["n_lines"], r["removed"]] for r in linedups.dedup_lines(docs).collect()}
    assert {i: want.get(i, [0, []]) for i in got} == got and set(got) == {i for i, *_ in ROWS if i is not None}
    assert linedups.dedup_lines(none).count() == 0


def test_line_dedup_looks_past_the_first_candidates(spark):
    # many lines that nearly match each other's bounds but not the limit, and a group that all match
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        w = [f"t{j}" for j in range(20)]
        for j in rng.choice(20, rng.integers(1, 4), replace=False):
            w[j] = f"u{rng.integers(4)}"
        rows.append((i, " ".join(w), "a"))
    got = {r["doc_id"]: [r["n_lines"], r["removed"]] for r in linedups.dedup_lines(make(spark, rows)).collect()}
    assert got == removed_lines(rows)


def test_quality(docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.apply_rules(docs, max_docs=1).collect()}
    for i, text, _ in ROWS:
        w = [x for x in SPACE.split(text or "") if x]
        r = got[i, len(w)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)), i
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    hosts = Counter((s or "", line) for i, t, s in {(t, s): (i, t, s) for i, t, s in ROWS}.values() for line in {" ".join(words(x)) for x in (t or "").split("\n")} if line)
    for i, text, s in ROWS:
        n = sum(len(words(x)) for x in (text or "").split("\n") if hosts[s or "", " ".join(words(x))] > 1)
        assert got[i, len(words(text))]["removed_words"] == n, i
    assert quality.apply_rules(none).count() == 0


def test_quality_rejects_depleted(spark):
    rows = [(i, LINE + "\n" + " ".join(f"own{i}a{j}" for j in range(5 + 30 * (i % 2))), "h") for i in range(8)]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.apply_rules(make(spark, rows), max_docs=4).collect()}
    assert got == {i: (False, i % 2 == 1) for i in range(8)}


JSON = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()


def test_tokens(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(JSON)
    tokens.write_blocks(docs, f"file://{tmp_path}/a", JSON)
    got = sorted(tokens.read_blocks(spark, f"file://{tmp_path}/a", with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([i for i, *_ in ROWS], key=lambda i: -1 if i is None else i)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [2])) for i, x, _ in ROWS)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    tokens.write_blocks(none, f"file://{tmp_path}/b", JSON)
    assert tokens.read_blocks(spark, f"file://{tmp_path}/b").count() == 0


def test_splitting_gives_the_tokenizers_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    odd = ["It's  <|endoftext|>x, Straße! ΑΣ Σ é́a İx I. a\x1cb c\x85d 12ab, x.y?", ".", "́x", "don't;", "a\tb\rc", "naïve: CAFÉ?", "ﬁx   y"]
    t = Tokenizer.from_str(JSON)
    tokens.write_blocks(make(spark, list(zip(range(len(odd)), odd, odd, strict=True))), f"file://{tmp_path}/c", JSON)
    got = {r["doc_id"]: r["ids"] for r in tokens.read_blocks(spark, f"file://{tmp_path}/c", with_ids=True).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids + [2] for i, x in enumerate(odd)}
    other = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    tokens.write_blocks(make(spark, [(1, "One  two\nthree", "a")]), f"file://{tmp_path}/d", other, 50256)
    assert tokens.read_blocks(spark, f"file://{tmp_path}/d", with_ids=True).first()["ids"] == Tokenizer.from_str(other).encode("One  two\nthree").ids + [50256]


@pytest.mark.parametrize("n", [1, 31, 33, tokens.SEGMENT, tokens.SEGMENT + 1, 3 * tokens.SEGMENT + 7])
def test_blocks(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.002, n) - 1, 60_000)
    table = tokens.Tables.of_counts(np.bincount(ids, minlength=60_001))
    assert int(table.freq.sum()) == 1 << tokens.SCALE
    block = tokens.encode_block(ids, table)
    assert (tokens.decode_block(block, table) == ids).all()
    last = -(-n // tokens.SEGMENT)
    assert (tokens.decode_block(block, table, (last - 1, last)) == ids[(last - 1) * tokens.SEGMENT :]).all()
    with pytest.raises(ValueError, match="damaged"):
        tokens.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)


@pytest.mark.parametrize("n, top", [(1, 1), (1, 10**6), (5, 3), (1000, 10**12), (20_000, 2**62), (30_000, 100)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e = EliasFano(EliasFano.build(v))
    assert (e[np.arange(n)] == v).all()
    q = np.concatenate([rng.integers(0, top + 5, 500, dtype=np.uint64), v[:500], v[:500] + np.uint64(1)])
    assert (e.successor(q, np.zeros(len(q), np.int64), np.full(len(q), n)) == np.searchsorted(v, q)).all()


def test_ngram(spark, docs, none):
    model = ngram.train(docs.filter("doc_id < 10"))
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram.score(docs, model).collect()}
    seqs = {(i, t): [*words(t), None] for i, t, _ in ROWS}
    learnt = [[*words(t), None] for i, t, _ in ROWS if i is not None and i < 10]
    c, pairs = Counter(w for s in learnt for w in s), Counter(p for s in learnt for p in zip([None, *s], s, strict=False))
    n, v, kinds, d = sum(c.values()), len(c), Counter(a for a, _ in pairs), 0.75
    one = lambda w: max(c[w] - d, 0) / n + d * v / n / (v + 1)
    for (i, _), s in seqs.items():
        r = got[i, len(s)]
        assert (r["n_known"], r["train_tokens"]) == (sum(c[w] > 0 for w in s), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s), rel_tol=1e-9)
        full = sum(math.log10(max(pairs[a, w] - d, 0) / c[a] + d * kinds[a] / c[a] * one(w) if c[a] else one(w)) for a, w in zip([None, *s], s, strict=False))
        assert abs(r["score"] - full) < 0.02 * len(s)
    empty = ngram.score(docs, ngram.train(none)).collect()
    assert len(empty) == len(ROWS) and all(r["score"] == 0 for r in empty if r["n_tokens"] == 1) and ngram.score(none, model).count() == 0


def test_ngram_of_order_3(spark, docs, none):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "the", "of", f"x{i % 7}"], rng.integers(0, 60))) for i in range(150)]
    rows = [*[(1000 + i, t, "a") for i, t in enumerate(texts)], *ROWS]
    more = make(spark, [*rows, (5000, "a b never c d a the of the", "a")])
    learnt = [[*words(t), None] for i, t, _ in rows if i is not None and i != 1003]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        model = ngram.train(make(spark, [r for r in rows if r[0] is not None and r[0] != 1003]), order=3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(model.parts) > 100 and len(np.unique(model.cuts[0])) < len(model.cuts[0])  # words and pairs over several segments
    c = Counter(w for s in learnt for w in s)
    two = Counter(p for s in learnt for p in zip([None, *s], s, strict=False))
    three = Counter(p for s in learnt for p in zip([None, *s], s, s[1:], strict=False))
    n, v, kinds, next_kinds, d = sum(c.values()), len(c), Counter(a for a, _ in two), Counter(x[:2] for x in three), 0.75
    p1 = lambda w: max(c[w] - d, 0) / n + d * v / n / (v + 1)
    p2 = lambda a, w: (max(two[a, w] - d, 0) + d * kinds[a] * p1(w)) / c[a] if c[a] else p1(w)
    p3 = lambda a, b, w: (max(three[a, b, w] - d, 0) + d * next_kinds[a, b] * p2(b, w)) / two[a, b] if next_kinds[a, b] else p2(b, w)
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in ngram.score(more, model).collect()}
    for i, t, _ in [*rows, (5000, "a b never c d a the of the", "a")]:
        s = [*words(t), None]
        full = math.log10(p2(None, s[0])) + sum(math.log10(p3(*x)) for x in zip([None, *s], s, s[1:], strict=False))
        assert abs(got[i, len(s)] - full) < 1e-3 * len(s)
    assert ngram.score(docs, ngram.train(none, order=3)).count() == len(ROWS)


def test_mixing(spark, docs, none):
    rows = [(i, "x" * (50 + i * 37 % 200), "abcde"[min(4, int(math.log2(1 + i % 31)))]) for i in range(3000)]
    placed = mixing.ranked(mixing.place(make(spark, rows), {"a": 1.0, "b": 2.0, "c": 1.0, "d": 3.0, "e": 5.0}, block_bytes=400)).collect()
    assert sorted(r["doc_id"] for r in placed) == list(range(3000)) and sorted(r["position"] for r in placed) == list(range(3000))
    assert all(r["release"] <= r["slot"] < r["due"] for r in placed)
    slots = {r["slot"]: r["source"] for r in placed}
    assert len({(r["source"], r["block"]) for r in placed}) == len(slots)
    whole = mixing.whole_slots({"a": 1, "b": 2, "c": 1, "d": 3, "e": 5}, mixing.PERIOD)
    taken = Counter()
    for t, (s, k, slot) in enumerate(mixing.schedule(whole, mixing.PERIOD)):
        taken[s] += 1
        assert slot == t and k == taken[s] - 1 and all(abs(taken[x] - (t + 1) * w / mixing.PERIOD) < 1 for x, w in whole.items())
    assert mixing.place(docs).count() == len(ROWS) and mixing.place(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(ROWS)


@pytest.mark.parametrize("n, large", [(20, 0.5), (500, 1 / 3)])
def test_mixing_keeps_to_the_given_weights(spark, n, large):
    given = {f"s{i:03}": large if i == 0 else (1 - large) / (n - 1) for i in range(n)}
    rows = [(i, "x" * 9, s) for s, w in given.items() for i in range(math.ceil(10_000 * w))]  # a block each
    placed = mixing.place(make(spark, rows), given, block_bytes=10).select("source", "block", "slot", "release", "due").collect()
    assert len(placed) == len(rows) == len({r["slot"] for r in placed})
    taken, slots = Counter(), {r["slot"]: r for r in placed}
    for t in range(10_000):  # several times 4096 slots
        r = slots[t]
        w = given[r["source"]] / math.fsum(given.values())
        assert r["release"] <= t < r["due"] and abs(r["release"] - r["block"] / w) < 1 + 1e-6 and abs(r["due"] - (r["block"] + 1) / w) < 1 + 1e-6
        taken[r["source"]] += 1
        if t % 512 == 511 or t % 4096 == 4095:
            assert all(abs(taken[s] - (t + 1) * w) < 1 + 1e-6 for s, w in given.items())


def test_mixing_goes_on_past_sources_that_run_out():
    rows = list(mixing.windows({"a": 1, "b": 10**12}, {"a": 3, "b": 4}))
    assert [(s, k) for s, k, *_ in rows] == [("b", 0), ("b", 1), ("b", 2), ("b", 3), ("a", 0), ("a", 1), ("a", 2)]
    assert all(release <= t < due for *_, release, due, t in rows)
    assert list(mixing.windows(mixing.whole_weights({"a": 0.1}), {"a": 2})) == [("a", 0, 0, 1, 0), ("a", 1, 1, 2, 1)]


def near(rows, n, percent=80):
    sets = {}
    for i, t, _ in rows:
        w = words(t)
        if i is not None:
            sets.setdefault(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, docs, none, n):
    got = minhash.near_duplicates(docs, n).collect()
    assert len(got) == len(ROWS) and all(r["kept"] for r in got if r["doc_id"] is None)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == near(ROWS, n)
    assert minhash.near_duplicates(none, n).count() == 0


def test_chains_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows, w = [], [f"k{x}" for x in rng.integers(10**6, size=120)]
    for i in range(60):  # each a little unlike the one before; ids out of order
        w = w.copy()
        w[rng.integers(120)] = f"n{i}"
        rows.append((i * 37 % 60, " ".join(w), "a"))
    got = minhash.near_duplicates(make(spark, rows), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(rows, 2)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 3)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90, 200: 1}


BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs, none):
    tests = [(1, LINE), (2, "lazy DOG; again"), (3, "the"), (4, None), (5, "?!"), (6, "never seen words at all"), (7, "".join(BASE[20:60])), (7, "".join(BASE[20:60])), (8, "again and again")]
    items = spark.createDataFrame([(i, t, "x") for i, t in tests], "item_id long, text string, th string")
    split = lambda t: [w for w in BREAK.split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    got = {(r["doc_id"], r["n_words"]): r for r in decontam.contamination(docs, items, near=4).collect()}
    freq = Counter(w for _, text, _ in ROWS for w in split(text))
    for i, text, _ in ROWS:
        w, hit, seen, near = split(text), set(), set(), set()
        for item, t in tests:
            q = split(t)
            k = min(10, len(q))
            for s in range(len(q) - k + 1 if k else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == q[s : s + k]:
                        hit |= set(range(at, at + k))
                        seen.add(item)
            pair = sorted(set(q), key=lambda x: (freq[x], x))[:2]
            if len(pair) == 2 and any({w[x], w[y]} == set(pair) for x in range(len(w)) for y in range(x + 1, min(x + 5, len(w)))):
                near.add(item)
        assert got[i, len(w)]["n_near"] == len(near), i
        r = got[i, len(w)]
        names = ",".join(sorted(map(str, seen)))
        assert (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(hit), len(seen), hashlib.sha256(names.encode()).hexdigest(), bool(hit)), i
    assert decontam.contamination(none, items, near=4).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(docs, items.limit(0)).collect()} == {0}


def test_decontamination_by_items_without_an_id_or_with_one_for_several_texts(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, "one five three"), (4, "six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three"), (None, "four five six seven"), (None, "four five"), (9, "one two three"), (9, "x five y"), (8, "six")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs, items).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {1: (3, 2, sha("9"), True), 2: (2, 1, sha(""), True), 3: (0, 0, sha(""), False), 4: (1, 1, sha("8"), True)}


def test_proximity(spark, docs):
    pairs = spark.createDataFrame([("fox", "dog"), ("again", "again")], "a string, b string")
    got = {(r["a"], r["pos_a"], r["b"], r["pos_b"]) for r in decontam.near_matches(docs.filter("doc_id = 15"), pairs, 5).collect()}
    assert got == {("fox", 3, "dog", 8), ("again", 9, "again", 11), ("again", 11, "again", 9)}


def test_chat(spark):
    said = ["", None, "</s>[INST] ok [/INST]", "a\\b <s>", "<<SYS>> \\", "é" * 3000, "plain\n\ntext", "<<ROLE:x::>>"]
    rows = [(1, t, ["system", "user", "assistant", "tool", None, "a::>>b"][t % 6] if t else "system", said[t % 8]) for t in range(40)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, None, "assistant", "who"), (3, 5, "assistant", "x" * 5000), (3, 1, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit("w"), "at": F.lit(1)}).repartition(3)
    windows = chat.format_conversations(df, 300, 100)
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), sha(text), len(loss), sha(loss)), conv
    many = windows.filter("conv_id = 1").orderBy("window").collect()
    assert len(many) > 3 and all(w["text"].startswith("<<SYS>>") for w in many) and any(w["context"] > 1 for w in many[1:])
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(["scumword"] * bad + [f"z{x}" for x in rng.integers(5000, size=60)])
    rows = [(i, text(i % 5 == 0), "a") for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), None) for i in range(1000)] + [(None, 1, 0), (3, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(make(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make(spark, rows), model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(1000, 1500)) and len(model[0]) < 1000
    scored = toxicity.score(docs, model)
    assert set(scored.columns) == set(docs.columns) and scored.count() == len(ROWS) and scored.filter("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert toxicity.score(none, model).count() == 0 and toxicity.train(none, labels)[2] == 0.0


def test_queries_have_one_operator_each():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
