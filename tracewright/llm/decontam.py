"""Benchmark decontamination: a positional inverted index over documents, searched for phrases and near terms.

The index is a table with one posting (row key, position, term) for each occurrence of a term that the tests hold,
written in one pass over the texts; terms that no test holds can't take part in a match and are left out. A reserved
term stands after the last word of each row, so the index also tells the rows and their numbers of words. Lists are
read from the rarest terms on: each window (a phrase to find) names its two rarest terms, whose offset-adjusted
lists must meet at one alignment of test and document; the lists of all other terms are then read at those
alignments alone. Proximity joins the lists of two terms by blocks of positions. What is broadcast (the terms of the
tests, the alignments) is counted first; beyond the bound the same joins shuffle narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, join_small, materialise, split_words

#: Between two words: ASCII characters that are neither digits nor lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term after a row's last word and its number; a character that parts words is in none.
END, END_T = "\x00", -1


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), BREAK)


def index_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written postings (doc_id, th, pos, t) in ``docs`` of ``terms`` (a materialised table: term, t) and of END.

    ``th`` is the hash of the text. Each row of ``docs`` has its own postings, equal rows too; null texts have END at 0.
    """
    spark = docs.sparkSession
    ended = F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("pos", "term")
    words = docs.select("doc_id", F.xxhash64("text").alias("th"), ended)
    terms = materialise(terms.select("term", "t").union(spark.range(1).select(F.lit(END), F.lit(END_T).cast("long"))), "terms")
    return materialise(join_small(words, terms, ["term"], "inner").select("doc_id", "th", "pos", "t"), "postings")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """Windows (item, s, k) of items: ``k`` words from ``s`` on."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    return items.filter(n > 0).select("item", F.explode(starts).alias("s"), F.least(n, F.lit(width)).alias("k"))


class Index:
    """The index of ``docs`` (doc_id, text) for ``tests`` (item_id, text), and what it is searched for.

    A null item_id is an item like others, and one id may have several texts; equal tests count once. ``th``, the
    text's hash, tells rows with one doc_id apart.
    """

    def __init__(self, docs: DataFrame, tests: DataFrame):
        named = materialise(tests.select(F.col("item_id").cast("string").alias("name"), words_of(F.col("text")).alias("words")).distinct(), "named")
        # a number for each text, which ids that repeat or are null don't tell apart
        self.items = materialise(named.select("words").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
        self.names = materialise(named.join(self.items, "words").select("item", "name"), "names")
        slots = self.items.select("item", F.posexplode("words").alias("q", "term"))
        terms = materialise(slots.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
        self.postings = index_terms(docs, terms)
        lengths = self.postings.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        known = terms.join(lengths, "t", "left").select("term", "t", F.coalesce("n", F.lit(0)).alias("n"))
        self.slots = materialise(slots.join(known, "term"), "slots")  # item, q, term, t, n: the length of the term's list

    def rows(self) -> DataFrame:
        """doc_id, th and n_words of each row of the documents."""
        return self.postings.filter(F.col("t") == END_T).select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))

    def phrases(self, width: int = 10) -> DataFrame:
        """All places where a window of a test occurs: doc_id, th, item (its id), s (in the test), start, k.

        A window is ``width`` consecutive words of a test, or all words of a shorter one. Equal rows and equal tests
        give each match once. Null texts hold no words. No documents or tests: no rows.
        """
        slots = self.slots.select("item", "q", "t")
        inside = (F.col("q") >= F.col("s")) & (F.col("q") < F.col("s") + F.col("k"))
        rank = F.array_sort(F.collect_list(F.struct("n", "term", "q")))
        rarest = _windows(self.items, width).join(self.slots, "item").filter(inside).groupBy("item", "s", "k").agg(rank.alias("r"))
        rarest = rarest.select("item", "s", "k", F.col("r")[0]["q"].alias("q1"), F.coalesce(F.get("r", F.lit(1))["q"], F.col("r")[0]["q"]).alias("q2"))
        rarest = materialise(rarest, "windows")
        anchors = materialise(rarest.select("item", F.explode(F.array("q1", "q2")).alias("q")).distinct().join(slots, ["item", "q"]), "anchors")
        # first and second lists, adjusted to the place where the test would begin
        hits = join_small(self.postings, anchors, ["t"], "inner").select("doc_id", "th", "item", (F.col("pos") - F.col("q")).alias("at"), "q")
        aligned = hits.groupBy("doc_id", "th", "item", "at").agg(F.collect_set("q").alias("qs"))
        first = aligned.select("doc_id", "th", "item", "at", "qs", F.explode("qs").alias("q1"))  # at most ``width`` windows name it
        meet = join_small(first, rarest, ["item", "q1"], "inner").filter(F.array_contains("qs", F.col("q2")) & (F.col("at") + F.col("s") >= 0))
        meet = materialise(meet.select("doc_id", "th", "item", "at", "s", "k"), "meet")
        # the other lists, at those alignments
        spot = F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1)).alias("q")
        due = meet.select("doc_id", "th", "item", "at", spot).distinct().join(slots, ["item", "q"])
        due = materialise(due.select("doc_id", "th", "item", "at", "q", "t", (F.col("at") + F.col("q")).alias("pos")), "due")
        keys = materialise(due.select("doc_id", "th").distinct(), "keys")
        some = self.postings
        if keys.limit(200_001).count() <= 200_000:  # else all postings meet ``due``
            same = some["doc_id"].eqNullSafe(keys["doc_id"]) & (some["th"] == keys["th"])
            some = some.join(F.broadcast(keys), same, "left_semi")
        # each alignment is due once, so equal rows' postings needn't be made distinct
        here = F.expr("d.doc_id <=> l.doc_id AND d.th = l.th AND d.pos = l.pos AND d.t = l.t")
        got = due.alias("d").join(some.alias("l"), here, "left_semi").select("doc_id", "th", "item", "at", "q")
        sets = got.groupBy("doc_id", "th", "item", "at").agg(F.collect_set("q").alias("qs"))  # as many as a test has words
        same = F.expr("a.doc_id <=> m.doc_id AND a.th = m.th AND a.item = m.item AND a.at = m.at")
        whole = F.forall(F.expr("sequence(m.s, m.s + m.k - 1)"), lambda q: F.array_contains(F.col("a.qs"), q))
        found = sets.alias("a").join(meet.alias("m"), same).filter(whole).select("m.doc_id", "m.th", "m.item", "m.s", (F.col("m.at") + F.col("m.s")).alias("start"), "m.k")
        return join_small(found, self.names, ["item"], "inner").select("doc_id", "th", F.col("name").alias("item"), "s", "start", "k").distinct()

    def near_items(self, distance: int = 10) -> DataFrame:
        """doc_id, th and item (its id) where the item's two rarest terms stand at most ``distance`` words apart.

        Rarity is the length of a term's list, then its text. An item of one term has no such pair.
        """
        rank = F.array_sort(F.collect_set(F.struct("n", "term", "t")))
        pairs = self.slots.groupBy("item").agg(rank.alias("r")).filter(F.size("r") > 1)
        pairs = materialise(pairs.select("item", F.col("r")[0]["t"].alias("a"), F.col("r")[1]["t"].alias("b")), "pairs")
        met = _near(self.postings, pairs.select("a", "b").distinct(), distance).select("doc_id", "th", "a", "b").distinct()
        return join_small(join_small(met, pairs, ["a", "b"], "inner"), self.names, ["item"], "inner").select("doc_id", "th", F.col("name").alias("item")).distinct()


def phrase_matches(docs: DataFrame, tests: DataFrame, width: int = 10) -> DataFrame:
    """See ``Index.phrases``; ``docs`` has doc_id and text, ``tests`` item_id and text."""
    return Index(docs, tests).phrases(width)


def _near(postings: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Postings of the terms ``a`` and ``b`` at most ``distance`` apart, at two places: doc_id, th, a, b, pos_a, pos_b.

    Lists meet by blocks of ``distance`` positions (each posting of b is also offered to the two blocks beside its
    own), so no list is paired with a whole other list.
    """
    used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct(), "terms")
    listed = materialise(join_small(postings, used, ["t"], "left_semi").distinct(), "lists")
    block = F.floor(F.col("pos") / max(1, distance)).cast("long")
    a = listed.select("doc_id", "th", F.col("pos").alias("pos_a"), F.col("t").alias("a"), block.alias("block")).join(pairs.select("a", "b").distinct(), "a")
    b = listed.select("doc_id", "th", F.col("pos").alias("pos_b"), F.col("t").alias("b"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    near = F.expr("x.doc_id <=> y.doc_id AND x.th = y.th AND x.b = y.b AND x.block = y.block") & (F.abs(F.col("pos_a") - F.col("pos_b")) <= distance)
    return a.alias("x").join(b.alias("y"), near & (F.col("pos_a") != F.col("pos_b"))).select("x.doc_id", "x.th", "x.a", "x.b", "pos_a", "pos_b")


def near_matches(docs: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Proximity search: places where the terms ``a`` and ``b`` of ``pairs`` stand at most ``distance`` words apart.

    Returns doc_id, th, a, b, pos_a, pos_b. Pairs with a null term are left out. No documents or pairs: no rows.
    """
    terms = pairs.select(F.explode(F.array("a", "b")).alias("term")).dropna().distinct()
    terms = materialise(terms.withColumn("t", F.monotonically_increasing_id()), "terms")
    first, second = terms.select(F.col("term").alias("a"), F.col("t").alias("ta")), terms.select(F.col("term").alias("b"), F.col("t").alias("tb"))
    numbers = materialise(pairs.select("a", "b").distinct().join(first, "a").join(second, "b"), "pairs")
    met = _near(index_terms(docs, terms), numbers.select(F.col("ta").alias("a"), F.col("tb").alias("b")), distance)
    met = met.withColumnsRenamed({"a": "ta", "b": "tb"})
    return join_small(met, numbers, ["ta", "tb"], "inner").select("doc_id", "th", "a", "b", "pos_a", "pos_b")


def contamination(docs: DataFrame, tests: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", near: int = 0) -> DataFrame:
    """For each row of ``docs``: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated; with ``near``, n_near.

    A word is hit if it lies inside an occurrence of a window of a test (see Index.phrases). n_near: the items
    whose two rarest terms stand at most ``near`` words apart, in any order. Equal rows get equal results. Rows with null or no text have no words. Items without an id are one item, counted in n_items, whose name
    items_sha256 leaves out. With no tests nothing is hit.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    index = Index(docs, tests)
    matches = materialise(index.phrases(width), "matches")
    spans = matches.groupBy("doc_id", "th", "start").agg(F.max("k").alias("k"))
    end = F.col("start") + F.col("k")
    reached = "max(start + k) OVER (PARTITION BY doc_id, th ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    covered = spans.select("doc_id", "th", F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.expr(reached), F.lit(0)))).alias("new"))
    hit = covered.groupBy("doc_id", "th").agg(F.sum("new").cast("long").alias("n_hit"))
    items = matches.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("item"))).alias("items"))  # a struct, as sets leave out nulls
    both = hit.alias("h").join(items.alias("i"), F.expr("h.doc_id <=> i.doc_id AND h.th = i.th")).select(F.col("h.doc_id").alias("_d"), F.col("h.th").alias("_t"), "n_hit", "items")
    rows, key = index.rows(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))
    out = rows.join(both, key, "left")
    zero = F.lit(0).cast("long")
    out = out.select(
        "doc_id", "th", "n_words", F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items.item", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )
    if near:
        met = index.near_items(near).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count(F.lit(1)).alias("n_near"))
        out = out.join(met, key, "left").withColumn("n_near", F.coalesce("n_near", zero)).drop("_d", "_t")
    return out
