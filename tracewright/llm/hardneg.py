"""Hard negatives by branch and bound over ball trees.

Vectors are dealt to trees by a hash, so that no label, source or group of copies makes a tree large. Each tree takes
the anchors in pieces: a node's centre and radius bound the inner products of an anchor with all of its points from
above and from below, and a node goes where its bounds lie outside the score window or strictly beneath the score of
the k-th found so far. The best k of each tree meet by anchor, k rows a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, partitions

#: Vectors of a tree at most, about, and of a leaf; anchors that a tree takes at a time.
TREE, LEAF, PIECE = 65_536, 64, 1_024
_NONE = np.iinfo(np.int64).max


class BallTree:
    """A complete binary tree over points; each node is a run of the points in the tree's order."""

    def __init__(self, points: np.ndarray):
        order, ends = np.arange(len(points)), np.array([0, len(points)])
        while np.diff(ends).max(initial=0) > LEAF:
            cuts = [0]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = points[order[a:b]]
                across = np.argmax(own.max(axis=0) - own.min(axis=0)) if own.shape[1] and b > a else 0
                mid = (b - a) // 2
                if own.shape[1] and b - a > 1:
                    order[a:b] = order[a:b][np.argpartition(own[:, across], mid)]
                cuts += [a + mid, b]
            ends = np.array(cuts)
        self.order, self.ends, self.points = order, ends, points[order]
        self.levels = []  # (centres, radii) from the root on
        at = ends
        while True:
            n = np.maximum(np.diff(at), 1)[:, None]
            centres = np.add.reduceat(np.vstack([self.points, np.zeros((1, points.shape[1]))]), at[:-1], axis=0) if len(points) else np.zeros((1, points.shape[1]))
            centres = np.where(np.diff(at)[:, None] > 0, centres / n, 0)
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))
            far = np.sqrt(((self.points - centres[of]) ** 2).sum(axis=1))
            radii = np.zeros(len(at) - 1)
            np.maximum.at(radii, of, far)
            self.levels.insert(0, (centres, radii))
            if len(at) == 2:
                break
            at = at[::2]

    def best(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ids: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places (in ``points``) of each query's best k among those with low <= score <= high that
        ``fits(queries, places)`` allows; scores that tie by ``ids``. -inf where there are fewer than k."""
        size = np.sqrt((q**2).sum(axis=1))[:, None]
        open_ = np.ones((len(q), 1), bool)
        for depth, (centres, radii) in enumerate(self.levels):
            open_ = np.repeat(open_, 2, axis=1)[:, : len(radii)] if depth else open_
            middle, reach = q @ centres.T, size * radii
            slack = 0.5 + 1e-9 * (np.abs(middle) + reach)  # scores are whole numbers, so rounding errors matter little
            above = middle + reach + slack
            open_ &= (above >= low[:, None]) & (middle - reach - slack <= high[:, None])
        scores, places = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        named = np.full((len(q), k), _NONE)
        for leaf in np.argsort(-np.where(open_, above, -np.inf).max(axis=0), kind="stable"):
            a, b = self.ends[leaf], self.ends[leaf + 1]
            asked = np.flatnonzero(open_[:, leaf] & (above[:, leaf] >= scores[:, -1]))
            if not len(asked) or a == b:
                continue
            found = q[asked] @ self.points[a:b].T
            here = np.broadcast_to(np.arange(a, b), found.shape)
            fit = (found >= low[asked, None]) & (found <= high[asked, None]) & (found >= scores[asked, -1:]) & fits(asked, slice(a, b))
            some = fit.any(axis=1)
            asked, found, here = asked[some], np.where(fit, found, -np.inf)[some], here[some]
            all_scores = np.hstack([scores[asked], found])
            all_places = np.hstack([places[asked], here])
            all_named = np.hstack([named[asked], np.where(np.isfinite(found), ids[a:b], _NONE)])
            top = np.lexsort((all_named, -all_scores), axis=-1)[:, :k]
            scores[asked], places[asked], named[asked] = (np.take_along_axis(x, top, axis=1) for x in (all_scores, all_places, all_named))
        return scores, places


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    n = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    out = np.zeros((len(n), int(n.max(initial=0))))
    of = np.repeat(np.arange(len(n)), n)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return np.hstack([m, np.zeros((len(m), max(0, width - m.shape[1])))])[:, :width]


def _search(k: int, window: tuple[int, int] | None):
    """Best k of each tree for its anchors. ``window``: percents of the positives' scores; none: positives are sought."""
    schema = pa.schema([("anchor", pa.int64()), ("positive", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def ask(tree: BallTree, of: pa.Table, asked: pa.Table):
        ids, rows, labels = (np.asarray(of[c])[tree.order] for c in ("vec_id", "row", "label"))
        width = tree.points.shape[1]  # further components meet none
        for at in range(0, asked.num_rows, PIECE):
            piece = asked.slice(at, PIECE).combine_chunks()
            q, own, mine = _wide(_matrix(piece["v"].combine_chunks()), width), np.asarray(piece["row"]), np.asarray(piece["label"])
            positive = np.asarray(piece["positive"])
            if window is None:
                low, high = np.full(len(q), -np.inf), np.full(len(q), np.inf)
                fits = lambda x, y: (labels[y] == mine[x, None]) & (rows[y] != own[x, None])
            else:
                p = np.asarray(piece["score"])
                low, high = -(-(window[0] * p) // 100).astype(float), ((window[1] * p) // 100).astype(float)
                fits = lambda x, y: labels[y] != mine[x, None]
            scores, places = tree.best(q, low, high, k, ids, fits)
            x, y = np.nonzero(np.isfinite(scores))
            found = places[x, y]
            yield pa.record_batch([own[x], positive[x], rows[found], ids[found], scores[x, y].astype(np.int64)], schema=schema)

    def run(batches):
        """Rows come in the order of trees, a tree's vectors before its anchors."""
        number, points, tree, asked = None, [], None, []

        def flush():
            nonlocal tree, asked, points
            if asked and points:
                if tree is None:
                    whole = pa.Table.from_batches(points)
                    tree = (BallTree(_matrix(whole["v"].combine_chunks())), whole.select(["vec_id", "row", "label"]))
                yield from ask(*tree, pa.Table.from_batches(asked))
            asked = []

        for batch in batches:
            trees, kinds = np.asarray(batch.column("tree")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((np.diff(trees) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if trees[a] != number:
                    yield from flush()
                    number, points, tree = trees[a], [], None
                if kinds[a]:
                    asked.append(batch.slice(a, b - a))
                    if sum(x.num_rows for x in asked) >= PIECE:
                        yield from flush()
                else:
                    points.append(batch.slice(a, b - a))
        yield from flush()

    return run


_FOUND = "anchor long, positive long, row long, vec_id long, score long"


def _nearest(vectors: DataFrame, anchors: DataFrame, trees: int, k: int, window: tuple[int, int] | None, by: list[str]) -> DataFrame:
    """The best k of all trees for each anchor; ``anchors`` has row, label, v, positive and score."""
    none = F.lit(-1).cast("long")
    points = vectors.select(F.pmod(F.xxhash64("row"), F.lit(trees)).alias("tree"), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", none.alias("positive"), none.alias("score"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree"), F.lit(1).alias("kind"), "row", "vec_id", "label", "v", "positive", "score")
    dealt = points.unionByName(asked).repartitionById(trees, F.col("tree").cast("int")).sortWithinPartitions("tree", "kind", "row")
    found = dealt.mapInArrow(_search(k, window), _FOUND)
    first = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label",
) -> DataFrame:
    """For each anchor and each of its nearest rows of the same label, the nearest rows of other labels that score
    between the two percents of ``window`` of the positive's score.

    A component x becomes floor(scale * x); scores are inner products of these whole numbers, exact while they stay
    below 2**53. Higher scores come first, ties by the smaller id. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score.

    Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part; ``is_anchor`` that
    is null means no. Vectors of unlike lengths are filled up with zeros, and an empty one scores 0 with all. Equal
    rows, and rows that repeat an id, are rows of their own: each is an anchor, and each can be found, also by the
    other. An anchor alone in its label has no positive, and a positive of a negative score has no window: neither
    gives rows. No rows, or no anchors: no rows. Other columns aren't read, whatever their names.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # null ids are left out here: such a row could neither be named nor ranked
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("double")).alias("v"), sound.alias("sound"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND sound")
    rows = materialise(rows.drop("sound").withColumn("row", F.monotonically_increasing_id()), "vectors")
    trees = max(partitions(vectors.sparkSession), -(-rows.count() // TREE))
    anchors = rows.filter("asks").drop("asks").withColumns({c: F.lit(-1).cast("long") for c in ("positive", "score")})
    near = materialise(_nearest(rows, anchors, trees, positives, None, ["anchor"]).drop("rank", "positive"), "positives")
    pairs = anchors.drop("positive", "score").join(near.select(F.col("anchor").alias("row"), F.col("row").alias("positive"), "score"), "row")
    found = _nearest(rows, pairs, trees, negatives, window, ["anchor", "positive"])
    of = near.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = found.join(of, ["anchor", "positive"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
