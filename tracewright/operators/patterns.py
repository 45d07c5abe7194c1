"""State patterns: what happens within an episode (intra) and across two adjacent ones (inter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import STATE, EventLog, LogError, event_states, stateful_lifecycle
from ..tables import ranked
from .episodes import _islands

KEY = ["family", "leading_object_type", "state", "to_state", "sequence", "eo", "oo"]


def instances(log: EventLog, family: str | None = None) -> DataFrame:
    """Pattern instances of the leading type (of all types, if none is set), one row each.

    ``eo`` and ``oo`` are the sets of (event label, related type) and (leading, related type in order) pairs;
    weighted edges follow from ``eo_list`` and ``oo_list``, which keep repeats.
    """
    rows = _islands(stateful_lifecycle(log, log.leading_object_type))
    if event_states(log).isEmpty():
        raise LogError("no event has a state yet; apply a state query or a detection")
    label = F.concat("event_type", F.lit(" ["), STATE, F.lit("]"))
    types = log.objects.select(F.col("object_id").alias("other"), F.col("object_type").alias("related"))
    related = log.e2o.select("event_seq", F.col("object_id").alias("other")).join(types, "other")
    events = rows.select("object_id", "object_type", "episode", "pos", "event_seq", STATE, label.alias("label"))
    met = events.join(related, "event_seq").filter("other <> object_id")
    pairs = met.groupBy("object_id", "episode").agg(
        F.array_sort(F.collect_list(F.struct(F.col("label").alias("source"), F.col("related").alias("target")))).alias("eo_list"),
        F.array_sort(F.collect_list(F.struct(F.least("object_type", "related").alias("source"), F.greatest("object_type", "related").alias("target")))).alias("oo_list"),
    )
    spans = events.groupBy("object_id", "object_type", "episode").agg(
        F.min_by(STATE, "pos").alias(STATE), F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels")
    )
    none = F.array().cast("array<struct<source:string,target:string>>")
    spans = spans.join(pairs, ["object_id", "episode"], "left").withColumn("eo_list", F.coalesce("eo_list", none)).withColumn("oo_list", F.coalesce("oo_list", none))
    one = lambda *x: F.array(F.concat(*x))
    intra = spans.select(
        F.lit("intra").alias("family"), "object_id", F.col("object_type").alias("leading_object_type"), STATE, F.lit(None).cast("string").alias("to_state"),
        F.concat(one(F.lit("START "), STATE), "labels", one(F.lit("END "), STATE)).alias("sequence"), "eo_list", "oo_list",
    )
    order = Window.partitionBy("object_id").orderBy("episode")
    ahead = {c: F.lead(c).over(order).alias(f"n_{c}") for c in (STATE, "labels", "eo_list", "oo_list")}
    inter = spans.select("*", *ahead.values()).filter(F.col(f"n_{STATE}").isNotNull()).select(
        F.lit("inter").alias("family"), "object_id", F.col("object_type").alias("leading_object_type"), STATE, F.col(f"n_{STATE}").alias("to_state"),
        F.concat(one(F.lit("START "), STATE), "labels", one(F.lit("CHANGE "), STATE, F.lit(" -> "), f"n_{STATE}"), "n_labels", one(F.lit("END "), f"n_{STATE}")).alias("sequence"),
        F.concat("eo_list", "n_eo_list").alias("eo_list"), F.concat("oo_list", "n_oo_list").alias("oo_list"),
    )
    both = {"intra": intra, "inter": inter, None: intra.unionByName(inter)}[family]
    return both.withColumn("eo", F.array_sort(F.array_distinct("eo_list"))).withColumn("oo", F.array_sort(F.array_distinct("oo_list")))


def edge_text(c: str) -> Column:
    """A set of edges as text."""
    return F.array_join(F.transform(c, lambda x: F.concat_ws(">", x["source"], x["target"])), "|")


def patterns(log: EventLog, family: str | None) -> DataFrame:
    """Patterns of a family (of both, each ranked by itself): id by rank, label, support (instances) and mass (steps of
    all instances).

    Ranked by support, mass and label; remaining ties by the texts of sequence and edge sets.
    """
    rows = instances(log, family).groupBy(*KEY).agg(F.count(F.lit(1)).alias("support"))
    rows = rows.withColumn("mass", F.col("support") * (F.size("sequence") - 1))
    label = F.concat(F.coalesce(F.concat(STATE, F.lit(" -> "), "to_state"), F.col(STATE)), F.lit(" on "), "leading_object_type")
    order = [F.desc("support"), F.desc("mass"), F.col("label"), F.array_join("sequence", "|"), edge_text("eo"), edge_text("oo")]
    rows = ranked(rows.withColumn("label", label), "family", order, "rank")
    return rows.withColumn("id", F.concat("family", F.lit("-"), "rank")).drop("rank")


def pattern_edges(log: EventLog, family: str, kind: str) -> DataFrame:
    """Weighted edges of each pattern: ``df`` (adjacent steps), ``eo`` or ``oo``."""
    rows = instances(log, family)
    step = F.transform(F.sequence(F.lit(0), F.size("sequence") - 2), lambda i: F.struct(F.get("sequence", i).alias("source"), F.get("sequence", i + 1).alias("target")))
    listed = {"df": step, "eo": F.col("eo_list"), "oo": F.col("oo_list")}[kind]
    return rows.select(*KEY, F.explode(listed).alias("e")).groupBy(*KEY, "e.source", "e.target").agg(F.count(F.lit(1)).alias("weight"))


def explorer(log: EventLog) -> DataFrame:
    """Both families by support, mass and label."""
    return patterns(log, None).orderBy(F.desc("support"), F.desc("mass"), "label")


def objects_with_pattern(log: EventLog, family: str, state: str, sequence: list[str], to_state: str | None = None, eo: list[tuple] = (), oo: list[tuple] = ()) -> DataFrame:
    """object_id of the objects that have an instance of exactly this pattern."""
    flat = lambda c: F.transform(c, lambda x: F.concat_ws("\x1f", x["source"], x["target"]))
    listed = lambda pairs: F.array(*[F.lit("\x1f".join(p)) for p in sorted(set(pairs))]).cast("array<string>")
    same = F.col(STATE) == state
    same &= F.col("to_state").eqNullSafe(F.lit(to_state)) & (F.col("sequence") == F.array(*map(F.lit, sequence)).cast("array<string>"))
    same &= (F.array_sort(flat("eo")) == F.array_sort(listed(eo))) & (F.array_sort(flat("oo")) == F.array_sort(listed([tuple(sorted(p)) for p in oo])))
    return instances(log, family).filter(same).select("object_id").distinct()
