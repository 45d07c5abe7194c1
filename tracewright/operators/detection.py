"""Execution states found from data: windows over lifecycles, two principal components and a self-organising map.

Windows, their features, the Gram matrix, projections and assignments are distributed. The driver holds the means
and the Gram matrix of the features, two components and the map (at most 144 cells). The map is trained there on all
points, one by one and in order, as each depends on the one before: they are streamed to a file of 16 bytes a window
in the driver's temporary folder, which every epoch reads in pieces, by a loop that Spark's own compiler makes for the
driver's JVM. Time is epochs times windows times cells.
``training="batch"`` trains another map, by Spark alone and at every size: each epoch is one pass over the written
points that sums them by cell, and the driver sees a row a cell.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import EPSILON, format_number, numeric_value, value_label
from ..model import EventLog, LogError, lifecycle
from ..tables import written
from .features import CATEGORIES, attribute_features, feature_columns

PIECE = 1 << 16  # points that are read at a time
TRAININGS = {"sequential": 120, "batch": 20}  # with their usual epochs


@dataclass(frozen=True)
class Detection:
    object_type: str
    columns: list[str]
    width: int
    height: int
    weights: list[tuple[float, float]]
    ratios: tuple[float, float]
    variances: tuple[float, float]
    log: EventLog
    windows: DataFrame
    points: DataFrame  # object_id, object_seq, start, pc1, pc2, x, y
    events: DataFrame  # object_id, start, pos, event_seq, event_id, event_type, time_ms


def windows(log: EventLog, object_type: str, size: int = 4) -> DataFrame:
    """object_id, object_seq, start, end_ms, length: every run of ``size`` events, or all of a shorter lifecycle."""
    log.require_type(object_type)
    size = min(max(size, 1), 30)
    rows = lifecycle(log, object_type=object_type)
    ahead = Window.partitionBy("object_id").orderBy("pos").rowsBetween(0, size - 1)
    total = F.count(F.lit(1)).over(Window.partitionBy("object_id"))
    rows = rows.select("object_id", "object_seq", F.col("pos").alias("start"), F.last("time_ms").over(ahead).alias("end_ms"), F.count(F.lit(1)).over(ahead).alias("length"), total.alias("n"))
    return rows.filter(F.col("start") <= F.greatest(F.col("n") - size, F.lit(0))).drop("n")


def window_events(log: EventLog, object_type: str, size: int = 4) -> DataFrame:
    """One row for each event of each window."""
    size = min(max(size, 1), 30)
    rows = lifecycle(log, object_type=object_type)
    n = F.count(F.lit(1)).over(Window.partitionBy("object_id"))
    rows = rows.withColumn("n", n)
    first = F.greatest(F.col("pos") - size + 1, F.lit(0).cast("long"))
    last = F.least(F.col("pos"), F.greatest(F.col("n") - size, F.lit(0).cast("long")))
    return rows.select("object_id", F.explode(F.sequence(first, last)).alias("start"), "pos", "event_seq", "event_id", "event_type", "time_ms")


def window_features(log: EventLog, object_type: str, size: int = 4) -> DataFrame:
    """object_id, start, feature, value (zeros left out); attributes as of the window's last event."""
    size = min(max(size, 1), 30)
    spans, events = windows(log, object_type, size), window_events(log, object_type, size)
    key = ["object_id", "start"]
    activity = events.groupBy(*key, F.concat(F.lit("activity."), F.col("event_type")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    kinds = log.objects.select(F.col("object_id").alias("other"), F.col("object_type").alias("type"))
    met = events.select(*key, "event_seq").distinct().join(log.e2o.select("event_seq", F.col("object_id").alias("other")), "event_seq").filter("other <> object_id").select(*key, "other")
    linked = spans.select(*key).join(log.o2o.select(F.col("source_id").alias("object_id"), F.col("target_id").alias("other")), "object_id").select(*key, "other")
    others = met.unionByName(linked).distinct().join(kinds, "other").groupBy(*key, F.concat(F.lit("related_objects."), F.col("type")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    names = feature_columns(attribute_features(log, object_type))
    hot = sorted({n[10:].split("=", 1)[0] for n in names if "=" in n})
    plain = sorted({n[10:] for n in names if "=" not in n})
    own = log.object_attrs.filter(F.col("name").isin(hot + plain))
    value = F.struct(numeric_value().alias("number"), value_label().alias("label"))
    left = spans.select("object_id", F.col("end_ms").alias("time_ms"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("attr_seq"), "start")
    right = own.select("object_id", "time_ms", F.lit(0).alias("probe"), "attr_seq", "name", value.alias("v"))
    order = Window.partitionBy("object_id").orderBy("time_ms", "probe", "attr_seq", "start").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True)
    last = {n: F.last(F.when(F.col("name") == n, F.col("v")), ignorenulls=True).over(order) for n in hot + plain}
    out = activity.unionByName(others)
    if last:
        entry = lambda n: F.struct(F.lit(n).alias("name"), last[n].alias("v"))
        rows = rows.select(*key, "probe", F.array(*map(entry, last)).alias("a")).filter("probe = 1").select(*key, F.explode("a").alias("a")).select(*key, "a.name", "a.v.*")
        found = rows.filter(F.col("label").isNotNull())
        as_hot = found.filter(F.col("name").isin(hot) & F.col("number").isNull()).select(*key, F.concat(F.lit("attribute."), F.col("name"), F.lit("="), F.col("label")).alias("feature"), F.lit(1.0).alias("value"))
        as_plain = found.filter(F.col("name").isin(plain)).select(*key, F.concat(F.lit("attribute."), F.col("name")).alias("feature"), F.col("number").alias("value"))
        out = out.unionByName(as_hot.filter(F.col("feature").isin(names))).unionByName(as_plain)
    return out


def _power(matrix: np.ndarray, steps: int = 80) -> np.ndarray:
    v = (np.arange(len(matrix)) + 1) / len(matrix)
    v = v / (np.linalg.norm(v) or 1.0)
    for _ in range(steps):
        w = matrix @ v
        size = np.linalg.norm(w)
        if size <= EPSILON:
            return w
        v = w / size
    return v


def _grid(lo, hi, width: int, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A map's first weights, two rows, over the bounds of its points; the cells' columns; squared distances of cells."""
    y, x = np.divmod(np.arange(width * height), width)
    share = lambda i, n: i / (n - 1) if n > 1 else np.full(len(i), 0.5)
    w = np.stack([lo[0] + (hi[0] - lo[0]) * share(x, width), lo[1] + (hi[1] - lo[1]) * share(y, height)])
    return w, x, ((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2).astype(float)


def _radius(width: int, height: int, done: float) -> float:
    return max(max(width, height) / 2, 1.0) * (1 - done) + 0.75 * done


#: One epoch over a file of points: the same sums, in the same order, as ``_epoch``.
_LOOP = """
public class MapEpoch {
    public byte[] run(String path, byte[] weights, byte[] pull) throws java.io.IOException {
        double[] w = doubles(weights, weights.length), h = doubles(pull, pull.length);
        java.io.FileInputStream in = new java.io.FileInputStream(path);
        try {
            byte[] piece = new byte[1 << 20];
            for (int n = in.readNBytes(piece, 0, piece.length); n > 0; n = in.readNBytes(piece, 0, piece.length)) points(doubles(piece, n), w, h);
        } finally { in.close(); }
        java.nio.ByteBuffer out = java.nio.ByteBuffer.allocate(weights.length).order(java.nio.ByteOrder.nativeOrder());
        out.asDoubleBuffer().put(w);
        return out.array();
    }
    private static double[] doubles(byte[] b, int n) {
        double[] out = new double[n / 8];
        java.nio.ByteBuffer.wrap(b, 0, n).order(java.nio.ByteOrder.nativeOrder()).asDoubleBuffer().get(out);
        return out;
    }
    private static void points(double[] p, double[] w, double[] h) {
        int cells = w.length / 2;
        for (int i = 0; i < p.length; i += 2) {
            double x = p[i], y = p[i + 1];
            long least = Long.MAX_VALUE;
            int best = 0;
            for (int c = 0; c < cells; c++) {
                double dx = x - w[c], dy = y - w[cells + c];
                long away = Double.doubleToLongBits(dx * dx + dy * dy); // of numbers from 0 on: in their order, and no branch
                best = away < least ? c : best;
                least = Math.min(away, least);
            }
            int row = best * cells;
            for (int c = 0; c < cells; c++) {
                w[c] += (x - w[c]) * h[row + c];
                w[cells + c] += (y - w[cells + c]) * h[row + c];
            }
        }
    }
}"""


@lru_cache(maxsize=1)
def _compiled(gateway):
    """``_LOOP`` in the driver's JVM, under a new name, as the gateway keeps methods by their class's."""
    compiler, name = gateway.jvm.org.codehaus.janino.SimpleCompiler(), f"MapEpoch{uuid.uuid4().hex}"
    compiler.cook(_LOOP.replace("MapEpoch", name))
    return compiler.getClassLoader().loadClass(name).newInstance()


def _epoch(points: np.ndarray, w: np.ndarray, pull: np.ndarray) -> None:
    """Moves the weights, two rows, towards each point by how near a cell is to the point's: ``pull``, a row a cell."""
    d, square, away = np.empty_like(w), np.empty_like(w), np.empty(w.shape[1])
    for i in range(0, len(points), PIECE):
        for p in np.array(points[i : i + PIECE])[:, :, None]:
            np.subtract(p, w, out=d)
            np.multiply(d, d, out=square)
            np.add(square[0], square[1], out=away)
            np.multiply(d, pull[away.argmin()], out=d)
            w += d


def train_map(points: np.ndarray, width: int, height: int, epochs: int) -> np.ndarray:
    """Weights of a self-organising map, trained point by point; they start as a grid over the points' bounds.

    Points of a mapped file are read from there by the driver's JVM, others by NumPy, with equal weights.
    """
    pieces = range(0, len(points), PIECE)
    lo, hi = (f([f(points[i : i + PIECE], axis=0) for i in pieces], axis=0) for f in (np.min, np.max))
    w, _, far = _grid(lo, hi, width, height)
    context = SparkContext._active_spark_context
    loop = _compiled(context._gateway) if context and isinstance(points, np.memmap) else None
    for epoch in range(epochs):
        done = epoch / (epochs - 1) if epochs > 1 else 1.0
        rate, radius = 0.5 * (1 - done) + 0.05 * done, _radius(width, height, done)
        pull = rate * np.exp(-far / (2 * max(radius * radius, 0.01)))
        if loop is None:
            _epoch(points, w, pull)
        else:
            w = np.frombuffer(loop.run(os.path.realpath(points.filename), bytearray(w.tobytes()), bytearray(pull.tobytes()))).reshape(2, -1)
    return w.T


def _nearest(weights) -> Column:
    """The cell whose weights are nearest to (pc1, pc2), the first of several."""
    away = [F.struct(((F.col("pc1") - float(a)) * (F.col("pc1") - float(a)) + (F.col("pc2") - float(b)) * (F.col("pc2") - float(b))).alias("d"), F.lit(i).alias("i")) for i, (a, b) in enumerate(weights)]
    return F.least(*away)["i"]


def train_batch(points: DataFrame, width: int, height: int, epochs: int) -> np.ndarray:
    """Weights of a map trained epoch by epoch on ``points`` (pc1, pc2), a table that each epoch reads once.

    Points are given to their nearest cell, whose numbers and sums are added up before anything is shuffled; a cell's
    new weights are the mean of all points, each weighed by how near its cell is. The order of points doesn't matter,
    and a lost task is read again. The driver holds a row a cell. No points: noughts.
    """
    lowest = points.agg(F.min("pc1"), F.min("pc2"), F.max("pc1"), F.max("pc2")).first()
    if lowest[0] is None:
        return np.zeros((width * height, 2))
    w, _, far = _grid(lowest[:2], lowest[2:], width, height)
    for epoch in range(epochs):
        done = epoch / (epochs - 1) if epochs > 1 else 1.0
        near = np.exp(-far / (2 * max(_radius(width, height, done) ** 2, 0.01)))
        sums = np.zeros((width * height, 3))
        for r in points.groupBy(_nearest(w.T).alias("cell")).agg(F.sum("pc1"), F.sum("pc2"), F.count(F.lit(1))).collect():  # cells
            sums[r[0]] = r[1:]
        total = near @ sums
        w = (total[:, :2] / total[:, 2:]).T
    return w.T


def _in_order(points: DataFrame, path: str) -> np.ndarray:
    """The points of all windows, by object and start, in a mapped file; a partition at a time passes through the driver."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([np.asarray(c, np.float64) for c in batch.columns]).tobytes()], pa.binary())], ["b"])

    with open(path, "wb") as f:
        for r in points.orderBy("object_seq", "start").select("pc1", "pc2").mapInArrow(pack, "b binary").toLocalIterator():
            f.write(r["b"])
    return np.memmap(path, np.float64, "r").reshape(-1, 2) if os.path.getsize(path) else np.zeros((0, 2))


@dataclass(frozen=True)
class Projection:
    """Windows on two components: points (object_id, object_seq, start, pc1, pc2), and how much the components explain."""

    columns: list[str]
    count: int
    points: DataFrame
    spans: DataFrame
    ratios: tuple[float, float]
    variances: tuple[float, float]


def project(log: EventLog, object_type: str, size: int = 4) -> Projection:
    """The two principal components of the standardised features of all windows.

    Features stay a long table, a row for each value that isn't nought: products are summed by pair of features, and
    points are sums of values times weights, all in the JVM. The driver sees features squared. LogError for a type
    without objects, features or windows.
    """
    log.require_type(object_type)
    if log.objects.filter(F.col("object_type") == object_type).isEmpty():
        raise LogError(f"no objects of type '{object_type}' are in the log")
    features = window_features(log, object_type, size).groupBy("object_id", "start", "feature").agg(F.sum("value").alias("value"))
    features = written(features, "windows")  # names and values are read from it
    columns = feature_columns(features)
    if not columns:
        raise LogError(f"objects of type '{object_type}' have no numeric features")
    spans = windows(log, object_type, size)
    count = spans.count()
    if not count:
        raise LogError(f"lifecycles of type '{object_type}' have no windows")
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    held = features.select("object_id", "start", place[F.col("feature")].alias("i"), "value").filter("value <> 0")
    both = held.join(held.select("object_id", "start", F.col("i").alias("j"), F.col("value").alias("other")), ["object_id", "start"]).filter("i <= j")
    total, g = np.zeros(len(columns)), np.zeros((len(columns), len(columns)))
    for r in both.groupBy("i", "j").agg(F.sum(F.col("value") * F.col("other")).alias("s")).collect():  # features squared
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["s"]
    for r in held.groupBy("i").agg(F.sum("value").alias("s")).collect():  # features
        total[r["i"]] = r["s"]
    n = float(count)
    mean = total / n
    cov = g / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd <= EPSILON, 1.0, sd)
    cov = cov / np.outer(sd, sd) * n / max(1.0, n - 1)
    first = _power(cov)
    l1 = float(first @ cov @ first)
    second = _power(cov - l1 * np.outer(first, first))
    l2 = float(second @ cov @ second)
    trace = float(np.trace(cov)) or 1.0
    weights = lambda c: F.array(*[F.lit(float(x)) for x in c / sd])
    dot = lambda c, name: F.sum(F.col("value") * weights(c)[F.col("i")]).alias(name)
    sums = held.groupBy("object_id", "start").agg(dot(first, "pc1"), dot(second, "pc2"))
    points = spans.select("object_id", "object_seq", "start").join(sums, ["object_id", "start"], "left")
    shifted = lambda name, c: (F.coalesce(name, F.lit(0.0)) - float(mean @ (c / sd))).alias(name)
    points = points.select("object_id", "object_seq", "start", shifted("pc1", first), shifted("pc2", second))
    return Projection(columns, count, points, spans, (l1 / trace, l2 / trace), (l1, l2))


def detect(
    log: EventLog, object_type: str, size: int = 4, width: int | None = None, height: int | None = None, epochs: int | None = None, training: str = "sequential",
) -> Detection:
    """Project all windows to two components and assign each to a cell of a map.

    ``training`` is "sequential" (120 epochs, point by point on the driver) or "batch" (20 epochs, each a job).
    """
    if training not in TRAININGS:
        raise LogError(f"training is one of {', '.join(TRAININGS)}, not '{training}'")
    found = project(log, object_type, size)
    points = written(found.points, "points")
    side = min(max(int(np.ceil(np.sqrt(found.count))), 3), 8)
    width, height = (min(max(d or side, 2), 12) for d in (width, height))
    epochs = min(max(TRAININGS[training] if epochs is None else epochs, 10), 500)
    if training == "batch":
        weights = train_batch(points, width, height, epochs)
    else:
        with tempfile.TemporaryDirectory() as folder:
            local = _in_order(points, f"{folder}/points")
            weights = train_map(local, width, height, epochs) if len(local) else np.zeros((width * height, 2))
    best = _nearest(weights)
    points = points.select("object_id", "object_seq", "start", "pc1", "pc2", (best % width).alias("x"), F.floor(best / width).cast("int").alias("y"))
    return Detection(object_type, found.columns, width, height, [tuple(map(float, w)) for w in weights], found.ratios, found.variances, log, found.spans, points, window_events(log, object_type, size))


def attribute_at_windows(found: Detection, name: str) -> DataFrame:
    """object_id, start, number and label of an attribute as of each window's last event; windows without a value are left out."""
    value = F.struct(numeric_value().alias("number"), value_label().alias("label"))
    left = found.windows.select("object_id", F.col("end_ms").alias("time_ms"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("attr_seq"), "start")
    right = found.log.object_attrs.filter(F.col("name") == name).select("object_id", "time_ms", F.lit(0).alias("probe"), "attr_seq", value.alias("v"))
    order = Window.partitionBy("object_id").orderBy("time_ms", "probe", "attr_seq", "start").rowsBetween(Window.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("v", F.last("v", ignorenulls=True).over(order))
    return rows.filter("probe = 1 AND v.label IS NOT NULL").select("object_id", "start", "v.*")


def _top(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Of each key the row with the largest n, the first by ``what`` among equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), what)
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def cells(found: Detection, colour: str | None = None) -> DataFrame:
    """Every cell of the map: x, y, label, count, avg_pc1, avg_pc2 (its weights, if empty), dominant_activity and colour.

    ``colour`` is an id of ``colour_options``; another one, or none, colours by the number of windows. color_value is
    from 0 to 1: the count's share of the largest, a numeric attribute's mean between the least and largest cell's, or
    the number of windows of the cell's commonest category as a share of the largest such number.
    """
    spark = found.points.sparkSession
    grid = spark.createDataFrame([(i % found.width, i // found.width, a, b) for i, (a, b) in enumerate(found.weights)], "x int, y int, w1 double, w2 double")
    sums = found.points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"), F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"))
    own = found.events.groupBy("object_id", "start", "event_type").agg(F.count(F.lit(1)).alias("n"))
    place = found.points.select("object_id", "start", "x", "y")
    activity = _top(own, ["object_id", "start"], "event_type").drop("n").join(place, ["object_id", "start"]).groupBy("x", "y", "event_type").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(sums, ["x", "y"], "left").join(_top(activity, ["x", "y"], "event_type").drop("n"), ["x", "y"], "left")
    out = out.withColumn("count", F.coalesce("count", F.lit(0).cast("long")))
    kinds = {r["id"]: (r["label"], r["kind"]) for r in colour_options(found.log, found.object_type).collect()} if colour else {}
    name, kind = kinds.get(colour, (None, "count"))
    whole = Window.partitionBy(F.lit(1))  # of a map's cells, 144 at most
    if kind == "count":
        value, label = F.col("count") / F.greatest(F.max("count").over(whole), F.lit(1)), F.concat(F.col("count").cast("string"), F.lit(" windows"))
    elif kind == "numeric":
        mean = attribute_at_windows(found, name).join(place, ["object_id", "start"]).groupBy("x", "y").agg(F.avg("number").alias("mean"))
        out = out.join(mean, ["x", "y"], "left")
        span = F.max("mean").over(whole) - F.min("mean").over(whole)
        value = F.when(F.col("mean").isNull(), 0.0).when(span <= EPSILON, 1.0).otherwise((F.col("mean") - F.min("mean").over(whole)) / span)
        label = F.concat(F.lit(f"avg {name}: "), F.coalesce(format_number(F.col("mean")), F.lit("n/a")))
    else:
        per = attribute_at_windows(found, name).join(place, ["object_id", "start"]).groupBy("x", "y", F.col("label").alias("category")).agg(F.count(F.lit(1)).alias("n"))
        out = out.join(_top(per, ["x", "y"], "category"), ["x", "y"], "left")
        value = F.coalesce(F.col("n") / F.greatest(F.max("n").over(whole), F.lit(1)), F.lit(0.0))
        label = F.concat(F.lit(f"{name}: "), F.coalesce(F.concat("category", F.lit(" ("), F.col("n").cast("string"), F.lit(")")), F.lit("n/a")))
    return out.select(
        "x", "y", F.concat(F.lit("S"), F.col("x") + 1, F.lit("-"), F.col("y") + 1).alias("label"), "count", F.coalesce("m1", "w1").alias("avg_pc1"),
        F.coalesce("m2", "w2").alias("avg_pc2"), F.col("event_type").alias("dominant_activity"),
        F.round(value, 6).alias("color_value"), label.alias("color_label"), F.lit(kind).alias("color_kind"),
    )


def _moves(found: Detection) -> DataFrame:
    order = Window.partitionBy("object_id").orderBy("start")
    lag = lambda c: F.lag(c).over(order)
    rows = found.points.select("*", lag("x").alias("px"), lag("y").alias("py"), lag("start").alias("p_start"))
    return rows.filter(F.col("px").isNotNull() & ((F.col("px") != F.col("x")) | (F.col("py") != F.col("y"))))


def transitions(found: Detection) -> DataFrame:
    """Changes of cell between consecutive windows, with their count and distance on the map."""
    rows = _moves(found).groupBy(F.col("px").alias("source_x"), F.col("py").alias("source_y"), F.col("x").alias("target_x"), F.col("y").alias("target_y")).agg(F.count(F.lit(1)).alias("count"))
    distance = F.abs(F.col("source_x") - F.col("target_x")) + F.abs(F.col("source_y") - F.col("target_y"))
    return rows.withColumn("distance", distance).withColumn("nearby", F.col("distance") <= 1)


def boundary_windows(found: Detection, x: int, y: int) -> DataFrame:
    """Windows that enter or leave a cell: direction, object_id, start, and the other cell."""
    rows = _moves(found)
    entering = rows.filter((F.col("x") == x) & (F.col("y") == y)).select(F.lit("entering").alias("direction"), "object_id", "start", F.col("px").alias("other_x"), F.col("py").alias("other_y"))
    leaving = rows.filter((F.col("px") == x) & (F.col("py") == y)).select(F.lit("exiting").alias("direction"), "object_id", F.col("p_start").alias("start"), F.col("x").alias("other_x"), F.col("y").alias("other_y"))
    return entering.unionByName(leaving)


def _graph(found: Detection, own: DataFrame):
    from .graphs import directly_follows

    rows = found.events.join(own.select("object_id", "start").distinct(), ["object_id", "start"])
    rows = rows.select(F.concat_ws("@", "object_id", "start").alias("object_id"), F.lit(found.object_type).alias("object_type"), "event_type", (F.col("pos") - F.col("start")).alias("pos"))
    return directly_follows(rows)


def cell_graph(found: Detection, x: int, y: int):
    """The directly-follows graph of a cell's windows, START and END around each."""
    return _graph(found, found.points.filter((F.col("x") == x) & (F.col("y") == y)))


def boundary_graph(found: Detection, x: int, y: int, direction: str):
    """The directly-follows graph of the windows ``entering`` or ``exiting`` a cell."""
    return _graph(found, boundary_windows(found, x, y).filter(F.col("direction") == direction))


def boundary_details(found: Detection, x: int, y: int, limit: int | None = None) -> DataFrame:
    """``boundary_windows`` with the events of each: start_event, end_event and ``activities`` in order, with its point
    and the cells that it leaves and enters; the first ``limit`` of each direction, by object and start, if it is given."""
    rows = boundary_windows(found, x, y).join(found.points.select("object_id", "object_seq", "start", "pc1", "pc2"), ["object_id", "start"])
    if limit is not None:
        first = rows.filter("direction = 'entering'").orderBy("object_seq", "start").limit(limit)
        rows = first.unionByName(rows.filter("direction = 'exiting'").orderBy("object_seq", "start").limit(limit))
    events = found.events.groupBy("object_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "event_id", "event_type"))).alias("e"))  # a window has 30 events at most
    rows = rows.join(events, ["object_id", "start"])
    name = lambda x, y: F.concat(F.lit("S"), x + 1, F.lit("-"), y + 1)
    here, other, enters = name(F.lit(x), F.lit(y)), name(F.col("other_x"), F.col("other_y")), F.col("direction") == "entering"
    return rows.select(
        "direction", "object_id", "start", "other_x", "other_y", F.col("e")[0]["event_id"].alias("start_event"), F.element_at("e", -1)["event_id"].alias("end_event"), F.col("e.event_type").alias("activities"),
        F.when(enters, other).otherwise(here).alias("source_cell"), F.when(enters, here).otherwise(other).alias("target_cell"), "pc1", "pc2", "object_seq",
    )


def colour_options(log: EventLog, object_type: str) -> DataFrame:
    """id, label and kind of what cells can be coloured by: the number of windows, attributes of numbers alone, and
    those with some but fewer than CATEGORIES values that are no numbers."""
    rows = log.object_attrs.join(log.objects.filter(F.col("object_type") == object_type).select("object_id"), "object_id", "left_semi")
    kinds = rows.groupBy("name").agg(F.count(numeric_value()).alias("numeric"), F.countDistinct(F.when(numeric_value().isNull(), value_label())).alias("categories"))
    kind = F.when((F.col("categories") == 0) & (F.col("numeric") > 0), "numeric").when((F.col("categories") > 0) & (F.col("categories") < CATEGORIES), "categorical")
    first = log.objects.sparkSession.createDataFrame([("__window_count", "Assigned windows", "count")], "id string, label string, kind string")
    found = kinds.withColumn("kind", kind).filter("kind IS NOT NULL").select(F.concat(F.lit("attribute::"), F.col("name")).alias("id"), F.col("name").alias("label"), "kind")
    return first.unionByName(found)


def projected_windows(found: Detection, limit: int = 500) -> DataFrame:
    """The first windows, by object and start: object_id, start_event, end_event, pc1, pc2 and their cell."""
    some = found.points.orderBy("object_seq", "start").limit(limit)
    ends = found.events.groupBy("object_id", "start").agg(F.min_by("event_id", "pos").alias("start_event"), F.max_by("event_id", "pos").alias("end_event"))
    six = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)  # noqa: E731  no negative zeros
    return some.join(ends, ["object_id", "start"]).select("object_id", "start_event", "end_event", six("pc1"), six("pc2"), F.col("x").alias("cell_x"), F.col("y").alias("cell_y"), "object_seq", "start")


def event_labels(found: Detection) -> DataFrame:
    """event_id, event_seq and value: the cell of most of an event's windows; of ties that of the last window, over all
    objects in their order."""
    rows = found.events.select("event_id", "event_seq", "object_id", "start").join(found.points, ["object_id", "start"])
    votes = rows.groupBy("event_id", "event_seq", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("object_seq", "start")).alias("last"))
    order = Window.partitionBy("event_seq").orderBy(F.desc("n"), F.desc("last"))
    best = votes.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select("event_id", "event_seq", F.concat(F.lit("S"), F.col("x") + 1, F.lit("-"), F.col("y") + 1).alias("value"))
