"""Object features, how they go with states, and fits of simple causal models.

Features are kept long (object_id, feature, value; zeros left out) as far as possible: their number follows the
data, and sums over non-zero values are all that correlations need. Wide tables are made for named columns only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import EPSILON, format_number, numeric_value, value_label
from ..model import STATE, EventLog, LogError, relations
from ..tables import ranked, written
from .episodes import dominant_states

CATEGORIES = 50


def latest_attributes(log: EventLog, object_type: str) -> DataFrame:
    """object_id, name, number and label of each attribute's last value."""
    objects = log.objects.filter(F.col("object_type") == object_type).select("object_id")
    value = F.struct(numeric_value().alias("number"), value_label().alias("label"))
    rows = log.object_attrs.join(objects, "object_id", "left_semi").groupBy("object_id", "name").agg(F.max_by(value, F.struct("time_ms", "attr_seq")).alias("v"))
    return rows.select("object_id", "name", "v.*")


def related(log: EventLog, own: DataFrame) -> DataFrame:
    """object_id, other, type of the objects met in an object's events or linked from it."""
    rel = log.e2o.select("event_seq", F.col("object_id").alias("other"))
    met = log.e2o.join(own, "object_id", "left_semi").select("object_id", "event_seq").distinct().join(rel, "event_seq").filter("other <> object_id").select("object_id", "other")
    linked = log.o2o.join(own.withColumnRenamed("object_id", "source_id"), "source_id", "left_semi").select(F.col("source_id").alias("object_id"), F.col("target_id").alias("other"))
    kinds = log.objects.select(F.col("object_id").alias("other"), F.col("object_type").alias("type"))
    return met.unionByName(linked).distinct().join(kinds, "other")


def attribute_features(log: EventLog, object_type: str) -> DataFrame:
    """object_id, feature, value of the last values of attributes."""
    last = latest_attributes(log, object_type)
    # an attribute with a value that is no number is one-hot if it has few of them, else left out
    kinds = last.groupBy("name").agg(F.countDistinct(F.when(F.col("number").isNull(), F.col("label"))).alias("kinds"))
    last = last.join(F.broadcast(kinds), "name")  # a row a name
    plain = last.filter("kinds = 0").select("object_id", F.concat(F.lit("attribute."), F.col("name")).alias("feature"), F.col("number").alias("value"))
    hot = last.filter((F.col("kinds") > 0) & (F.col("kinds") < CATEGORIES) & F.col("number").isNull())
    hot = hot.select("object_id", F.concat(F.lit("attribute."), F.col("name"), F.lit("="), F.col("label")).alias("feature"), F.lit(1.0).alias("value"))
    return plain.unionByName(hot)


def object_features(log: EventLog, object_type: str) -> DataFrame:
    """object_id, feature, value of all objects of a type, without zeros."""
    log.require_type(object_type)
    own = log.objects.filter(F.col("object_type") == object_type).select("object_id")
    met = log.met(object_type) if log.met is not None else None
    activity = relations(log, object_type).groupBy("object_id", F.concat(F.lit("activity."), F.col("event_type")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    others = (related(log, own) if met is None else met).groupBy("object_id", F.concat(F.lit("related_objects."), F.col("type")).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return activity.unionByName(others).unionByName(attribute_features(log, object_type))


def feature_columns(features: DataFrame) -> list[str]:
    """Names of features: activities, related types, attributes, each by name."""
    rank = {"activity": 0, "related_objects": 1, "attribute": 2}
    names = [r[0] for r in features.select("feature").distinct().collect()]
    return sorted(names, key=lambda n: (rank[n.split(".", 1)[0]], n))


def feature_table(log: EventLog, object_type: str) -> DataFrame:
    """One row an object of the type, with a column a feature (0 where it has none), in document order."""
    features = object_features(log, object_type)
    columns = feature_columns(features)
    own = log.objects.filter(F.col("object_type") == object_type).select("object_id", "object_seq")
    wide = features.groupBy("object_id").pivot("feature", columns).agg(F.sum("value")) if columns else features.select("object_id").distinct()
    quoted = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in columns]
    return own.join(wide, "object_id", "left").orderBy("object_seq").select("object_id", *quoted)


def preview(table: DataFrame, rows: int = 15) -> DataFrame:
    return table.limit(rows)


def write_csv(table: DataFrame, path: str) -> None:
    """A feature table as one CSV with a header; whole numbers without decimals, others with six at most."""
    columns = [F.col("object_id"), *[format_number(F.col(f"`{c}`")).alias(c) for c in table.columns[1:]]]
    table.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def state_correlations(log: EventLog, object_type: str) -> DataFrame:
    """For each feature the state with the strongest point-biserial correlation (ties: first by name)."""
    states = written(dominant_states(log, object_type), "states")
    sizes = states.groupBy(STATE).agg(F.count(F.lit(1)).alias("state_count")).withColumn("one", F.lit(1))
    sizes = ranked(sizes, "one", [F.desc("state_count"), F.col(STATE)], "rank").drop("one")
    n = states.count()
    both = object_features(log, object_type).join(states, "object_id", "left").groupBy("feature", STATE)
    both = written(both.agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")), "sums")
    sums = both.join(sizes, STATE)
    # of the states in which a feature has no value, correlations fall with the state's size: the largest will do, and
    # the first by name where all are nought
    by_rank = Window.partitionBy("feature").orderBy("rank")
    met = sums.select("feature", "rank", (F.col("rank") == F.row_number().over(by_rank)).cast("long").alias("full"))
    missing = met.groupBy("feature").agg((F.sum("full") + 1).alias("rank"))
    names = both.select("feature").distinct()
    least = sizes.agg(F.min(F.struct(STATE, "rank"))["rank"]).first()[0] if n else 1
    absent = names.join(missing, "feature", "left").select("feature", F.explode(F.array_distinct(F.array(F.coalesce("rank", F.lit(1)).cast("long"), F.lit(least).cast("long")))).alias("rank"))
    absent = absent.join(sums.select("feature", F.col("rank").cast("long").alias("rank")), ["feature", "rank"], "left_anti").join(sizes.withColumn("rank", F.col("rank").cast("long")), "rank")
    grid = sums.drop("rank").unionByName(absent.select("feature", STATE, F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), "state_count")).withColumn("n", F.lit(n))
    of = Window.partitionBy("feature")
    grid = grid.withColumn("total", F.sum("s").over(of)).withColumn("squares", F.sum("q").over(of))
    mean, outside = F.col("total") / F.col("n"), F.col("n") - F.col("state_count")
    sd = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    inside = F.col("s") / F.col("state_count")
    without = F.when(outside > 0, (F.col("total") - F.col("s")) / outside).otherwise(0.0)
    share = F.sqrt(F.col("state_count") / F.col("n") * outside / F.col("n"))
    r = F.when((F.col("n") >= 2) & (outside > 0) & (sd > EPSILON), F.least(F.greatest((inside - without) * share / sd, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    grid = grid.select("feature", STATE, F.col("n").alias("sample_count"), "state_count", inside.alias("i"), without.alias("o"), r.alias("r"))
    order = Window.partitionBy("feature").orderBy(F.desc(F.round(F.abs("r"), 12)), STATE)
    best = grid.withColumn("k", F.row_number().over(order)).filter("k = 1")
    six = lambda c, name: (F.round(c, 6) + F.lit(0.0)).alias(name)  # noqa: E731  no negative zeros
    return best.select("feature", STATE, six(F.col("r"), "correlation"), six(F.abs("r"), "strength"), "sample_count", "state_count", six(F.col("i"), "mean_in_state"), six(F.col("o"), "mean_outside_state"))


@dataclass(frozen=True)
class CausalNode:
    id: str
    role: str  # observable, latent, outcome
    feature: str | None = None
    operation: str = "identity"
    label: str = ""


#: Names of operations, and what they stand for.
OPERATIONS = {"identity": "identity", "none": "identity", "log10": "log10", "log_10": "log10", "log_e": "log_e", "ln": "log_e", "log": "log_e", "sqrt": "sqrt"}
ALLOWED = {("observable", "latent"), ("latent", "latent"), ("latent", "outcome")}


def causal_order(nodes: list[CausalNode], edges: list[tuple[str, str]], features: list[str]) -> list[CausalNode]:
    """Nodes with parents before children; LogError for models that can't be fitted."""
    by_id = {n.id: n for n in nodes}
    if not nodes or "" in by_id or len(by_id) != len(nodes):
        raise LogError("causal nodes need ids, each its own")
    for n in nodes:
        if n.role not in ("observable", "latent", "outcome"):
            raise LogError(f"unknown role '{n.role}'")
        if n.role == "latent" and n.feature:
            raise LogError(f"latent node '{n.id}' must not have a feature")
        if n.role != "latent" and n.feature not in features:
            raise LogError(f"unknown feature '{n.feature}' of node '{n.id}'")
        if n.operation.strip().lower() not in OPERATIONS:
            raise LogError(f"unknown operation '{n.operation}'")
    if len(set(edges)) != len(edges):
        raise LogError("an edge is there twice")
    for a, b in edges:
        if a == b or a not in by_id or b not in by_id:
            raise LogError(f"edge {a} -> {b} doesn't join two nodes")
        if (by_id[a].role, by_id[b].role) not in ALLOWED:
            raise LogError(f"edge {a} -> {b} goes from {by_id[a].role} to {by_id[b].role}")
    waiting, out = {n.id: sum(b == n.id for _, b in edges) for n in nodes}, []
    while ready := [n for n in nodes if waiting.get(n.id) == 0]:
        for n in ready:
            del waiting[n.id]
            out.append(n)
            for a, b in edges:
                if a == n.id:
                    waiting[b] -= 1
    if waiting:
        raise LogError("the causal model has a cycle")
    return out


def _transformed(c: Column, operation: str) -> Column:
    kind = OPERATIONS[operation.strip().lower()]
    log = lambda f: F.when(c > 0, f(c)).otherwise(0.0)
    return {"identity": lambda: c, "log10": lambda: log(F.log10), "log_e": lambda: log(F.ln), "sqrt": lambda: F.sqrt(F.greatest(c, F.lit(0.0)))}[kind]()


def fit_causal_model(log: EventLog, object_type: str, nodes: list[CausalNode], edges: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (mean, std_dev) and edges (correlation, intensity, p_value, sample_count) of a fitted model.

    A latent node is the mean of its parents' z-scores. Each level is one aggregate over the objects.
    """
    features = object_features(log, object_type)
    order = causal_order(nodes, edges, feature_columns(features))
    wanted = sorted({n.feature for n in nodes if n.feature})
    own = log.objects.filter(F.col("object_type") == object_type).select("object_id")
    cells = [F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"f{i}") for i, f in enumerate(wanted)]
    wide = own.join(features.filter(F.col("feature").isin(wanted)).groupBy("object_id").agg(*cells), "object_id", "left").na.fill(0.0)
    place = {n.id: f"n{i}" for i, n in enumerate(order)}
    stats: dict[str, tuple[float, float]] = {}

    def measure(names: list[str]) -> None:
        new = [n for n in names if n not in stats]
        if new:
            row = wide.agg(*[x for n in new for x in (F.avg(place[n]), F.stddev_pop(place[n]))]).first()
            stats.update((n, (row[2 * i] or 0.0, row[2 * i + 1] or 0.0)) for i, n in enumerate(new))

    for n in order:
        if n.role != "latent":
            wide = wide.withColumn(place[n.id], _transformed(F.col(f"f{wanted.index(n.feature)}"), n.operation))
    for n in order:
        if n.role == "latent":
            parents = [a for a, b in edges if b == n.id]
            measure(parents)
            scores = [(F.col(place[p]) - stats[p][0]) / stats[p][1] if stats[p][1] > EPSILON else F.lit(0.0) for p in parents]
            wide = wide.withColumn(place[n.id], sum(scores[1:], scores[0]) / len(scores) if scores else F.lit(0.0))
    measure([n.id for n in order])
    spark = log.events.sparkSession
    six = lambda x: math.floor(abs(x) * 1e6 + 0.5) / 1e6 * (-1 if x < 0 else 1) + 0.0  # noqa: E731  no negative zeros
    node_rows = [(n.id, n.label or n.id, n.role, n.feature, OPERATIONS[n.operation.strip().lower()], six(stats[n.id][0]), six(stats[n.id][1])) for n in nodes]
    edge_rows = []
    if edges:
        row = wide.agg(F.count(F.lit(1)), *[F.covar_pop(place[a], place[b]) for a, b in edges]).first()
        for (a, b), cov in zip(edges, row[1:], strict=True):
            n, spread = row[0], stats[a][1] * stats[b][1]
            r = max(-1.0, min(1.0, cov / spread)) if n >= 2 and spread > EPSILON else 0.0
            t = abs(r) * math.sqrt((n - 2) / max(1 - r * r, 1e-12)) if n >= 3 else 0.0
            edge_rows.append((a, b, six(r), six(abs(r)), six(math.exp(-t * t / 2)) if n >= 3 else 1.0, n))
    return (
        spark.createDataFrame(node_rows, "id string, label string, role string, feature string, operation string, mean double, std_dev double"),
        spark.createDataFrame(edge_rows, "source string, target string, correlation double, intensity double, p_value double, sample_count long"),
    )
