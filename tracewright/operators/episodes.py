"""State episodes of objects: maximal runs of one state, and what can be measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import RECOVERED, duration_stats, upper_median
from ..model import STATE, EventLog, lifecycle, stateful_lifecycle
from ..tables import with_quantiles, written


def _islands(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("object_id").orderBy("pos")
    new = F.when(F.col(STATE).eqNullSafe(F.lag(STATE).over(order)) & (F.col("pos") > 0), 0).otherwise(1)
    return rows.withColumn("episode", F.sum(new).over(order))


def episodes(log: EventLog, object_type: str | None = None) -> DataFrame:
    """One row an episode: start, last, events, dwell (to the next episode, or its own last event) and the next state."""
    found = _islands(stateful_lifecycle(log, object_type)).groupBy("object_id", "object_type", "object_seq", "episode").agg(
        F.min_by(STATE, "pos").alias(STATE), F.min_by("time_ms", "pos").alias("start_ms"), F.max_by("time_ms", "pos").alias("last_ms"),
        F.count(F.lit(1)).alias("event_count"), F.min("pos").alias("first_pos"),
    )
    order = Window.partitionBy("object_id").orderBy("episode")
    found = found.select("*", F.lead(STATE).over(order).alias("next_state"), F.lead("start_ms").over(order).alias("next_ms"))
    dwell = F.greatest(F.coalesce("next_ms", "last_ms") - F.col("start_ms"), F.lit(0).cast("long"))
    return found.withColumn("dwell_ms", dwell)


def state_bands(log: EventLog, object_type: str | None = None) -> DataFrame:
    """Runs of one state in the whole lifecycle, where an event without a state ends a run."""
    rows = _islands(lifecycle(log, True, object_type)).filter(F.col(STATE).isNotNull())
    return rows.groupBy("object_id", "episode").agg(
        F.min_by(STATE, "pos").alias(STATE), F.min_by("time_ms", "pos").alias("start_ms"), F.max_by("time_ms", "pos").alias("end_ms"), F.count(F.lit(1)).alias("event_count")
    ).drop("episode")


def transition_kpis(log: EventLog, object_type: str) -> DataFrame:
    """from_state, to_state, count, object_count and times from start to start."""
    rows = episodes(log, object_type).filter("next_state IS NOT NULL")
    return rows.groupBy(F.col(STATE).alias("from_state"), F.col("next_state").alias("to_state")).agg(
        F.count(F.lit(1)).alias("count"), F.countDistinct("object_id").alias("object_count"), *duration_stats("dwell_ms")
    )


def transition_matrix(log: EventLog, object_type: str) -> DataFrame:
    """from_state, to_state, count, object_count, median_ms (null without a transition) and intensity (count by the
    largest count) for every pair of the states that objects of the type have."""
    found = written(episodes(log, object_type).select("object_id", STATE, "next_state", "dwell_ms"), "episodes")
    pairs = found.filter("next_state IS NOT NULL").groupBy(F.col(STATE).alias("from_state"), F.col("next_state").alias("to_state"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("count"), F.countDistinct("object_id").alias("object_count"), upper_median("dwell_ms").alias("median_ms"))
    states = found.groupBy(STATE).agg(F.count(F.lit(1)).alias("n"))
    # every state meets all: the table that is asked for, states squared
    listed = states.agg(F.array_sort(F.collect_set(STATE)).alias("all"))
    grid = listed.select(F.explode("all").alias("from_state"), "all").select("from_state", F.explode("all").alias("to_state"))
    dense = grid.join(pairs, ["from_state", "to_state"], "left")
    most = F.max("count").over(Window.partitionBy(F.lit(0)))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    intensity = F.coalesce(F.col("count") / most, F.lit(0.0)).alias("intensity")
    return dense.select("from_state", "to_state", zero("count"), zero("object_count"), "median_ms", intensity)


def dwell_kpis(log: EventLog, object_type: str) -> DataFrame:
    return episodes(log, object_type).groupBy(STATE).agg(
        F.count(F.lit(1)).alias("episode_count"), F.countDistinct("object_id").alias("object_count"), F.sum("dwell_ms").alias("total_ms"), *duration_stats("dwell_ms")
    )


def recovery(log: EventLog, object_type: str) -> DataFrame:
    """Transitions into a state whose name says that all is well again."""
    return transition_kpis(log, object_type).filter(F.col("to_state").rlike(RECOVERED))


def stuck(log: EventLog, object_type: str, limit: int = 15) -> DataFrame:
    """The last episodes that have lasted longest."""
    rows = episodes(log, object_type).filter("next_state IS NULL")
    rows = rows.select("object_id", STATE, F.col("start_ms").alias("entered_time_ms"), F.col("last_ms").alias("last_time_ms"), F.col("dwell_ms").alias("duration_ms"), "event_count")
    return rows.orderBy(F.desc("duration_ms"), "object_id").limit(min(max(limit, 1), 100))


def resolve_object_type(log: EventLog, requested: str | None) -> str:
    """The requested type if there is one of that name, else the leading one, else the first object's."""
    if requested in log.object_type_names():
        return requested
    if log.leading_object_type:
        return log.leading_object_type
    first = log.objects.orderBy("object_seq").limit(1).collect()
    if not first:
        raise ValueError("the log has no objects")
    return first[0]["object_type"]


def time_buckets(log: EventLog, buckets: int = 24) -> DataFrame:
    """bucket, start_ms, end_ms, total, state, count, percentage over all stateful events; a dense grid."""
    from ..model import event_states

    buckets = min(max(buckets, 4), 96)
    spark = log.events.sparkSession
    lo, hi = log.events.agg(F.min("time_ms"), F.max("time_ms")).first()
    lo, hi = lo or 0, hi if hi is not None else lo or 0
    span = float(max(hi - lo, 1))
    rows = log.events.select("event_seq", "time_ms").join(event_states(log), "event_seq")
    at = F.least(F.floor((F.col("time_ms") - lo) / F.lit(span) * buckets), F.lit(buckets - 1)).cast("long")
    counts = rows.groupBy(at.alias("bucket"), STATE).agg(F.count(F.lit(1)).alias("count"))
    states = counts.select(STATE).distinct()
    edge = lambda i: (F.lit(lo) + F.round(F.lit(span / buckets) * i)).cast("long")
    grid = states.select(STATE, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"))
    count = F.coalesce("count", F.lit(0).cast("long"))
    dense = grid.join(counts, ["bucket", STATE], "left").withColumn("count", count)
    total = F.sum("count").over(Window.partitionBy("bucket"))
    return dense.select(
        "bucket", edge(F.col("bucket")).alias("start_ms"), F.when(F.col("bucket") == buckets - 1, F.lit(hi)).otherwise(edge(F.col("bucket") + 1)).alias("end_ms"),
        total.alias("total"), STATE, "count", F.when(total == 0, 0.0).otherwise(F.col("count") / total * 100).alias("percentage"),
    )


def most_frequent_transition(log: EventLog, object_type: str) -> tuple[str, str] | None:
    rows = episodes(log, object_type).filter("next_state IS NOT NULL").groupBy(STATE, "next_state").agg(F.count(F.lit(1)).alias("n"))
    first = rows.orderBy(F.desc("n"), STATE, "next_state").limit(1).collect()
    return (first[0][STATE], first[0]["next_state"]) if first else None


def performance_samples(log: EventLog, object_type: str, from_state: str, to_state: str, roundtrip: bool = False) -> DataFrame:
    """For each event in from_state, the first later one in to_state, and for round trips the first one back.

    Two running windows over each lifecycle, last row first, so that each row's frame goes on from the one before.
    """
    rows = stateful_lifecycle(log, object_type).select("object_id", "pos", "time_ms", STATE)
    later = Window.partitionBy("object_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    spot = lambda s, *c: F.when(F.col(STATE) == s, F.struct("pos", "time_ms", *c))
    rows = rows.withColumn("own_from", spot(from_state)).withColumn("upto", F.last("own_from", ignorenulls=True).over(later))
    order = Window.partitionBy("object_id").orderBy(F.desc("pos"))
    rows = rows.withColumn("back", F.lag("upto").over(order)).withColumn("own_to", spot(to_state, "back"))
    rows = rows.withColumn("upto", F.last("own_to", ignorenulls=True).over(later)).withColumn("mid", F.lag("upto").over(order)).filter((F.col(STATE) == from_state) & F.col("mid").isNotNull())
    end = F.col("mid.back.time_ms") if roundtrip else F.lit(None).cast("long")
    rows = rows.select("object_id", F.col("time_ms").alias("start_time_ms"), F.col("mid.time_ms").alias("middle_time_ms"), end.alias("end_time_ms"))
    if roundtrip:
        rows = rows.filter("end_time_ms IS NOT NULL")
    return rows.withColumn("duration_ms", F.coalesce("end_time_ms", "middle_time_ms") - F.col("start_time_ms")).filter("duration_ms >= 0")


def sample_quartiles(log: EventLog, object_type: str, from_state: str, to_state: str, roundtrip: bool = False) -> DataFrame:
    """The samples of a spectrum, each with its quartile, from 1 to 4, by the durations at a quarter, half and three
    quarters of their places."""
    return with_quantiles(performance_samples(log, object_type, from_state, to_state, roundtrip), "duration_ms", [0.25, 0.5, 0.75], "quartile")


def performance_spectrum(log: EventLog, object_type: str, from_state: str, to_state: str, roundtrip: bool = False) -> DataFrame:
    samples = performance_samples(log, object_type, from_state, to_state, roundtrip)
    return samples.agg(
        F.count(F.lit(1)).alias("sample_count"), F.min("duration_ms").alias("min_ms"), upper_median("duration_ms").alias("median_ms"),
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    )


def dominant_states(log: EventLog, object_type: str | None = None) -> DataFrame:
    """object_id and its most frequent state; of ties the one seen last, then the first by name."""
    rows = stateful_lifecycle(log, object_type).groupBy("object_id", STATE).agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    order = Window.partitionBy("object_id").orderBy(F.desc("n"), F.desc("last"), STATE)
    return rows.withColumn("r", F.row_number().over(order)).filter("r = 1").select("object_id", STATE)
