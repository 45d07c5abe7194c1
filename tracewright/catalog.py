"""Every query of the event-log engine over the driver's tables, with its SQL twin for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import results
from .model import EventLog, lifecycle
from .operators import detection, episodes, features, filters, graphs, layout, patterns, summary
from .plans import stateql
from .session import LogSession
from .sources.adapters import clickstream, orders

QUERY = """
STATE state FOR LEADING OBJECT TYPE user AS CASE  -- a user's standing at each event
  WHEN event.type = 'error' THEN 'Failed'
  WHEN object.last_purchase > 60 THEN 'Valued'
  WHEN event.type LIKE '%purch%' OR event.k IS NULL THEN 'Normal buyer'
  WHEN NOT (event.value > 20) THEN 'Idle'
END"""


def _stated(spark: SparkSession, sf_dir: str) -> EventLog:
    return stateql.apply_state_query(clickstream(spark, sf_dir), QUERY)


def _states(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = stateql.assignments(clickstream(spark, sf_dir), stateql.parse(query))
        return found.select("event_id", F.col("value").alias("state"))

    return run


def _filtered(chosen: filters.LogFilter):
    """Counts of a filtered log."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = filters.apply_filter(clickstream(spark, sf_dir), chosen)
        return summary.summary(log).select("events", "objects", "e2o_relationships", "objects_with_lifecycle")

    return run


def _filtered_rows(chosen: filters.LogFilter):
    """What a filtered log keeps: its events, objects and links, each by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = filters.apply_filter(clickstream(spark, sf_dir), chosen)
        named = lambda df, kind, event, obj: df.select(F.lit(kind).alias("kind"), event.cast("string").alias("event_id"), obj.cast("string").alias("object_id"))
        none, event, obj = F.lit(None), F.col("event_id"), F.col("object_id")
        return named(log.events, "event", event, none).unionByName(named(log.objects, "object", none, obj)).unionByName(named(log.e2o, "link", event, obj))

    return run


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _seq(df: DataFrame) -> DataFrame:
    """Sequences and edge sets as text."""
    return df.select("id", "label", "leading_object_type", "state", "to_state", F.array_join("sequence", "|").alias("sequence"), patterns.edge_text("eo").alias("eo"), patterns.edge_text("oo").alias("oo"), "support", "mass")


def _batch(spark: SparkSession, sf_dir: str) -> detection.Detection:
    return detection.detect(clickstream(spark, sf_dir), "user", width=3, height=3, training="batch")


def _drawn(log: EventLog) -> layout.Layout:
    return layout.layout(graphs.oc_dfg(log), layout.colours(log))


def _answer(endpoint: str, request: dict | None = None):
    """An endpoint's document over the log with states."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return LogSession(_stated(spark, sf_dir)).answer(endpoint, request)

    return run


NODES = [
    features.CausalNode("clicks", "observable", "activity.click", "sqrt"), features.CausalNode("views", "observable", "activity.view", "log_e"),
    features.CausalNode("interest", "latent"), features.CausalNode("sales", "outcome", "activity.purchase"),
]
EDGES = [("clicks", "interest"), ("views", "interest"), ("interest", "sales")]
T0, T1 = 1_704_100_000_000, 1_704_500_000_000


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _stated(spark, sf_dir)
    chosen = filters.LogFilter(patterns=[{"family": "intra", "state": "Failed", "sequence": ["START Failed", "error [Failed]", "END Failed"], "eo": [("error [Failed]", "key")], "oo": [("user", "key")]}])
    return filters.matching_objects(log, chosen)


QUERIES = {
    "summary": lambda s, d: summary.summary(orders(s, d)),
    "text_attribute_options": lambda s, d: summary.text_attribute_options(orders(s, d)),
    "time_histogram": lambda s, d: summary.time_histogram(clickstream(s, d)),
    "object_search": lambda s, d: summary.object_search(clickstream(s, d), "1", "user", 40),
    "lifecycle_order": lambda s, d: lifecycle(orders(s, d), object_type="order").select("object_id", "pos", "event_id", "event_type", "time_ms"),
    "lifecycle_related": lambda s, d: summary.related_objects(clickstream(s, d), "u1"),
    "state_bands": lambda s, d: episodes.state_bands(_stated(s, d), "user"),
    "filter_event_types": _filtered(filters.LogFilter(event_types=["purchase", "signup"])),
    "filter_object_types": _filtered(filters.LogFilter(object_types=["key"])),
    "filter_time_range": _filtered(filters.LogFilter(start_ms=T0, end_ms=T1)),
    "filter_df_node": _filtered(filters.LogFilter(object_types=["user"], df_nodes=["signup", "error"])),
    "filter_df_edge": _filtered(filters.LogFilter(df_edges=[("purchase", "purchase"), ("signup", "error")])),
    "filter_text_attribute": _filtered(filters.LogFilter(text_attributes=[{"scope": "event", "name": "k", "values": ["7", "12"]}])),
    "filter_combined": _filtered(filters.LogFilter(event_types=["click", "view", "error"], object_types=["user"], end_ms=T1, df_nodes=["signup"])),
    "filter_combined_rows": _filtered_rows(filters.LogFilter(event_types=["click", "view", "error"], object_types=["user"], end_ms=T1, df_nodes=["signup"])),
    "filter_df_edge_rows": _filtered_rows(filters.LogFilter(df_edges=[("purchase", "purchase"), ("signup", "error")])),
    "filter_text_attribute_rows": _filtered_rows(filters.LogFilter(text_attributes=[{"scope": "event", "name": "k", "values": ["7", "12"]}])),
    "filter_pattern": _pattern,
    "dfg_user": lambda s, d: graphs.dfg(clickstream(s, d), "user").edges,
    "oc_dfg_nodes": lambda s, d: _six(graphs.oc_dfg(clickstream(s, d)).nodes, "avg_order"),
    "oc_dfg_edges": lambda s, d: graphs.oc_dfg(clickstream(s, d)).edges,
    "oc_dfg_orders": lambda s, d: graphs.oc_dfg(orders(s, d)).edges,
    "oc_dfg_layout": lambda s, d: _drawn(clickstream(s, d)).nodes.withColumn("lines", F.array_join("lines", "|")),
    "oc_dfg_routes": lambda s, d: _drawn(clickstream(s, d)).edges.select("id", "source", "target", "weight", "object_type", "color", "path", "label_x", "label_y"),
    "df_edge_options": lambda s, d: graphs.edge_options(graphs.oc_dfg(clickstream(s, d))),
    "oc_dfg_filtered": lambda s, d: graphs.oc_dfg(clickstream(s, d), ["user", "key"], 1, 100).edges,
    "state_query_event": _states("STATE state FOR LEADING OBJECT TYPE 'user' AS CASE WHEN event.value >= 50 AND event.type != 'view' THEN event.type WHEN event.k < 10 THEN 'low' ELSE 'rest' END"),
    "state_query_asof_object": _states(QUERY),
    "state_query_not_null_logic": _states("STATE state FOR LEADING OBJECT TYPE user AS CASE WHEN NOT (object.last_purchase > 30) THEN 'small or none' WHEN object.last_purchase IS NOT NULL THEN object.last_purchase END"),
    "state_query_like": _states("STATE state FOR LEADING OBJECT TYPE user AS CASE WHEN event.activity LIKE '%I%w' THEN 'seen' WHEN event.type LIKE 'C%' OR event.type LIKE 'error' THEN TRUE ELSE 1.5 END"),
    "state_aware_dfg_edges": lambda s, d: graphs.state_aware_oc_dfg(_stated(s, d), ["user"]).edges,
    "state_aware_dfg_nodes": lambda s, d: _six(graphs.state_aware_oc_dfg(_stated(s, d), ["user"]).nodes, "avg_order"),
    "episodes": lambda s, d: episodes.episodes(_stated(s, d), "user").select("object_id", "episode", "state", "start_ms", "last_ms", "event_count", "dwell_ms", "next_state"),
    "transition_kpis": lambda s, d: episodes.transition_kpis(_stated(s, d), "user"),
    "transition_matrix": lambda s, d: _six(episodes.transition_matrix(_stated(s, d), "user"), "intensity"),
    "performance_quartiles": lambda s, d: episodes.sample_quartiles(_stated(s, d), "user", "Failed", "Valued"),
    "dwell_kpis": lambda s, d: episodes.dwell_kpis(_stated(s, d), "user"),
    "recovery": lambda s, d: episodes.recovery(_stated(s, d), "user"),
    "stuck_states": lambda s, d: episodes.stuck(_stated(s, d), "user", 25),
    "time_buckets": lambda s, d: _six(episodes.time_buckets(_stated(s, d), 32), "percentage"),
    "performance_spectrum": lambda s, d: _six(episodes.performance_spectrum(_stated(s, d), "user", "Failed", "Valued"), "avg_ms"),
    "performance_roundtrip": lambda s, d: episodes.performance_samples(_stated(s, d), "user", "Failed", "Idle", True),
    "dominant_state": lambda s, d: episodes.dominant_states(_stated(s, d), "user"),
    "patterns_intra": lambda s, d: _seq(patterns.patterns(_stated(s, d), "intra")),
    "patterns_inter": lambda s, d: _seq(patterns.patterns(_stated(s, d), "inter")),
    "patterns_document": _answer("state_patterns"),
    "lifecycle_document": _answer("object_lifecycle_detail", {"object_id": "u1"}),
    "time_document": _answer("time_perspective", {"object_type": "user", "from_state": "Failed", "to_state": "Valued", "buckets": 32}),
    "kpi_document": _answer("state_transition_kpis", {"object_type": "user", "stuck_limit": 25}),
    "correlation_document": _answer("state_correlations"),
    "detection_document": lambda s, d: results.state_detection(_batch(s, d), 4),
    "cell_document": lambda s, d: results.detection_cell(_batch(s, d), 1, 1),
    "causal_document": _answer("fit_causal_model", {"object_type": "user", "nodes": [{"id": n.id, "label": n.id, "role": n.role, "feature": n.feature, "operation": n.operation} for n in NODES], "edges": [{"source": a, "target": b} for a, b in EDGES]}),
    "feature_table": lambda s, d: features.object_features(orders(s, d), "order"),
    "feature_table_wide": lambda s, d: features.feature_table(clickstream(s, d), "user").toDF("object_id", "click", "error", "purchase", "signup", "view", "keys", "last_purchase"),
    "state_correlation": lambda s, d: features.state_correlations(_stated(s, d), "user"),
    "causal_fit_nodes": lambda s, d: features.fit_causal_model(clickstream(s, d), "user", NODES, EDGES)[0],
    "causal_fit_edges": lambda s, d: features.fit_causal_model(clickstream(s, d), "user", NODES, EDGES)[1],
    "lifecycle_windows": lambda s, d: detection.windows(clickstream(s, d), "user", 4).groupBy("object_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("start").alias("starts"), F.sum("end_ms").alias("ends")),
    "window_features": lambda s, d: detection.window_features(clickstream(s, d), "user", 4),
    "pca_projection": lambda s, d: _six(detection.project(clickstream(s, d), "user").points, "pc1", "pc2").select("object_id", "start", (F.col("pc1") + F.lit(0.0)).alias("pc1"), (F.col("pc2") + F.lit(0.0)).alias("pc2")),
    "som_cells": lambda s, d: detection.cells(detection.detect(clickstream(s, d), "user", width=3, height=3)),
    "som_transitions": lambda s, d: detection.transitions(detection.detect(clickstream(s, d), "user", width=3, height=3)),
    "cell_boundary_windows": lambda s, d: detection.boundary_windows(detection.detect(clickstream(s, d), "user", width=3, height=3), 1, 1),
    "som_batch_cells": lambda s, d: _six(detection.cells(_batch(s, d)), "avg_pc1", "avg_pc2").withColumns({n: F.col(n) + F.lit(0.0) for n in ("avg_pc1", "avg_pc2")}),
    "som_batch_transitions": lambda s, d: detection.transitions(_batch(s, d)),
    "som_batch_boundary": lambda s, d: detection.boundary_windows(_batch(s, d), 1, 1),
    "apply_batch_detection": lambda s, d: detection.event_labels(_batch(s, d)),
    "apply_detection": lambda s, d: detection.event_labels(detection.detect(clickstream(s, d), "user", width=3, height=3)),
}

LOG = """
ev AS (
  SELECT event_id AS seq, event_id::VARCHAR AS event_id, event_type, epoch_us(ts) // 1000 AS t, user_id, value,
    try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
rel AS (
  SELECT seq, 0 AS rel_seq, 'u' || user_id AS object_id, 'user' AS object_type FROM ev
  UNION ALL SELECT seq, 1, 'k' || k, 'key' FROM ev WHERE k IS NOT NULL),
life AS (
  SELECT r.object_id, r.object_type, e.event_id, e.seq, r.rel_seq, e.event_type, e.t,
    row_number() OVER (PARTITION BY r.object_id ORDER BY e.t, e.seq, r.rel_seq) - 1 AS pos FROM rel r JOIN ev e USING (seq))"""
ASOF = LOG + """,
bought AS (SELECT user_id, t, arg_max(value, seq) AS last_purchase FROM ev WHERE event_type = 'purchase' GROUP BY user_id, t),
seen AS (SELECT e.*, p.last_purchase FROM ev e ASOF LEFT JOIN bought p ON e.user_id = p.user_id AND e.t >= p.t)"""
STATED = ASOF + """,
st AS (
  SELECT seq, event_id, CASE WHEN event_type = 'error' THEN 'Failed' WHEN coalesce(last_purchase > 60, false) THEN 'Valued'
    WHEN event_type LIKE '%purch%' OR k IS NULL THEN 'Normal buyer' WHEN NOT coalesce(value > 20, false) THEN 'Idle' END AS state FROM seen),
slife AS (
  SELECT l.* EXCLUDE (pos), st.state, row_number() OVER (PARTITION BY l.object_id ORDER BY l.pos) - 1 AS pos
  FROM life l JOIN st USING (seq) WHERE st.state IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR pos = 0 THEN 1 ELSE 0 END AS new FROM slife
  WINDOW w AS (PARTITION BY object_id ORDER BY pos)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY pos)::BIGINT AS episode FROM marked),
ep0 AS (
  SELECT object_id, object_type, episode, any_value(state) AS state, arg_min(t, pos) AS start_ms, arg_max(t, pos) AS last_ms, count(*) AS event_count
  FROM runs GROUP BY object_id, object_type, episode),
ep AS (
  SELECT *, lead(state) OVER w AS next_state, greatest(coalesce(lead(start_ms) OVER w, last_ms) - start_ms, 0) AS dwell_ms FROM ep0
  WINDOW w AS (PARTITION BY object_id ORDER BY episode)),
uep AS (SELECT * FROM ep WHERE object_type = 'user')"""
STATS = """min({0}) AS min_ms, list_sort(list({0}))[count(*) // 2 + 1] AS median_ms, round(avg({0}), 6) AS avg_ms, max({0}) AS max_ms"""
EDGE = """
SELECT source, target, object_type, count(*) AS weight FROM (
  SELECT object_type, event_type AS source, coalesce(lead(event_type) OVER (PARTITION BY object_id ORDER BY pos), 'END' || chr(10) || object_type) AS target FROM {0}
  UNION ALL SELECT object_type, 'START' || chr(10) || object_type, event_type FROM {0} WHERE pos = 0) GROUP BY ALL"""
SPOTS = """
SELECT label, kind, count(*) AS count, round(avg(o), 6) AS avg_order FROM (
  SELECT event_type AS label, 'activity' AS kind, pos + 1 AS o FROM life
  UNION ALL SELECT 'START' || chr(10) || object_type, 'start', 0 FROM life WHERE pos = 0
  UNION ALL SELECT 'END' || chr(10) || object_type, 'end', max(pos) + 2 FROM life GROUP BY object_id, object_type) GROUP BY label, kind"""
#: The labels of this log fit a line, but for the breaks that they have.
_DRAWN = f"""
types AS (
  SELECT object_type, printf('hsl(%d 68%% 38%%)', (214 + 137 * (row_number() OVER (ORDER BY first) - 1)) % 360) AS color
  FROM (SELECT object_type, CASE object_type WHEN 'user' THEN 0 ELSE 1 END AS first FROM rel GROUP BY ALL)),
spots AS ({SPOTS}),
layers AS (SELECT *, floor(avg_order * 2 + 0.5) AS layer FROM spots),
rws AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY count DESC, label) - 1 AS i, count(*) OVER (PARTITION BY layer) AS n, dense_rank() OVER (ORDER BY layer) - 1 AS lx FROM layers),
places AS (
  SELECT 'n' || row_number() OVER (ORDER BY lx, i) AS id, label, kind, CASE kind WHEN 'activity' THEN 'rect' ELSE 'ellipse' END AS shape, coalesce(t.color, '#42635c') AS color, t.object_type, count,
    76.0::DOUBLE + lx * 340 AS x, 76.0::DOUBLE + (max(n) OVER () - n) * 158.0::DOUBLE / 2 + CASE WHEN lx % 2 = 1 AND n > 1 THEN 158 * 0.12::DOUBLE ELSE 0 END + i * 158 AS y,
    CASE kind WHEN 'activity' THEN 215.0 ELSE 168.0 END::DOUBLE AS width, CASE kind WHEN 'activity' THEN 72.0 ELSE 76.0 END::DOUBLE AS height, replace(label, chr(10), '|') AS lines
  FROM rws LEFT JOIN types t ON kind <> 'activity' AND label LIKE '%' || chr(10) || t.object_type)"""
STEPS = """
sx AS (
  SELECT *, event_type || ' [' || state || ']' AS label, lead(event_type || ' [' || state || ']') OVER w AS nl, lead(state) OVER w AS ns
  FROM slife WHERE object_type = 'user' WINDOW w AS (PARTITION BY object_id ORDER BY pos)),
sc AS (SELECT *, CASE WHEN ns <> state THEN 'CHANGE ' || state || ' -> ' || ns END AS ch FROM sx)"""

_SPANS = """
u AS (SELECT *, count(*) OVER (PARTITION BY object_id) AS n FROM life WHERE object_type = 'user'),
w AS (SELECT a.object_id, a.pos AS start, b.pos AS last, b.t AS e FROM u a JOIN u b ON a.object_id = b.object_id AND b.pos = least(a.pos + 3, a.n - 1) WHERE a.pos <= greatest(a.n - 4, 0)),
we AS (SELECT w.object_id, w.start, u.seq, u.event_type FROM w JOIN u ON u.object_id = w.object_id AND u.pos BETWEEN w.start AND w.last)"""
_VALUES = """
SELECT object_id, start, 'activity.' || event_type AS feature, count(*)::DOUBLE AS value FROM we GROUP BY object_id, start, event_type
UNION ALL SELECT we.object_id, start, 'related_objects.' || r.object_type, count(DISTINCT r.object_id)::DOUBLE FROM we JOIN rel r ON r.seq = we.seq AND r.object_id <> we.object_id GROUP BY we.object_id, start, r.object_type
UNION ALL SELECT w.object_id, start, 'attribute.last_purchase', b.last_purchase FROM w ASOF JOIN (SELECT 'u' || user_id AS o, t, last_purchase FROM bought) b ON b.o = w.object_id AND w.e >= b.t"""

#: Points of all windows: the power iteration, 80 steps from the same vector, and once more without the first component.
_PCA = f"""wf AS ({_VALUES}),
nm AS (SELECT feature, row_number() OVER (ORDER BY CASE split_part(feature, '.', 1) WHEN 'activity' THEN 0 WHEN 'related_objects' THEN 1 ELSE 2 END, feature) AS i FROM (SELECT DISTINCT feature FROM wf)),
nn AS (SELECT count(*)::DOUBLE AS n FROM w), x AS (SELECT object_id, start, i, value FROM wf JOIN nm USING (feature)),
mn AS (SELECT i, sum(value) / any_value(n) AS mean FROM x, nn GROUP BY i),
gr AS (SELECT a.i, b.i AS j, sum(a.value * b.value) AS s FROM x a JOIN x b ON a.object_id = b.object_id AND a.start = b.start GROUP BY ALL),
cv AS (SELECT a.i, b.i AS j, coalesce(s, 0) / n - a.mean * b.mean AS c FROM mn a CROSS JOIN mn b CROSS JOIN nn LEFT JOIN gr ON gr.i = a.i AND gr.j = b.i),
sd AS (SELECT i, CASE WHEN sqrt(greatest(c, 0)) <= 2.220446049250313e-16 THEN 1 ELSE sqrt(greatest(c, 0)) END AS sd FROM cv WHERE i = j),
rw AS (SELECT cv.i, list(c / (a.sd * b.sd) * n / greatest(1, n - 1) ORDER BY j) AS r FROM cv JOIN sd a ON a.i = cv.i JOIN sd b ON b.i = cv.j, nn GROUP BY cv.i),
mx AS (SELECT list(r ORDER BY i) AS m, list_transform(range(1, count(*) + 1), lambda y: y / count(*)) AS v0 FROM rw),
p1 AS (
  SELECT 0 AS k, list_transform(v0, lambda y: y / sqrt(list_dot_product(v0, v0))) AS v FROM mx
  UNION ALL SELECT k + 1, list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM p1, mx WHERE k < 80)),
c1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM p1, mx WHERE k = 80),
m2 AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda y, j: y - l * v[i] * v[j])) AS m, v0 FROM mx, c1),
p2 AS (
  SELECT 0 AS k, list_transform(v0, lambda y: y / sqrt(list_dot_product(v0, v0))) AS v FROM m2
  UNION ALL SELECT k + 1, list_transform(u, lambda y: y / sqrt(list_dot_product(u, u))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS u FROM p2, m2 WHERE k < 80)),
wt AS (SELECT sd.i, c1.v[sd.i] / sd AS a, q.v[sd.i] / sd AS b, mean FROM sd JOIN mn USING (i), c1, (SELECT v FROM p2 WHERE k = 80) q),
sm AS (SELECT object_id, start, sum(value * a) AS a, sum(value * b) AS b FROM x JOIN wt USING (i) GROUP BY ALL),
sh AS (SELECT sum(mean * a) AS a, sum(mean * b) AS b FROM wt),
pt AS MATERIALIZED (
  SELECT w.object_id, w.start, coalesce(sm.a, 0) - sh.a AS a, coalesce(sm.b, 0) - sh.b AS b
  FROM w LEFT JOIN sm ON sm.object_id = w.object_id AND sm.start = w.start, sh)"""
#: The batch map of 3 x 3 cells, 20 epochs, and the cell of each window.
_BATCH = """
g AS (SELECT c::INTEGER AS c, (c % 3)::INTEGER AS x, (c // 3)::INTEGER AS y FROM range(9) t(c)),
som AS (
  SELECT 0 AS k, c, la + (ha - la) * x / 2.0 AS wa, lb + (hb - lb) * y / 2.0 AS wb FROM g, (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM pt)
  UNION ALL
  SELECT k + 1, g.c, sum(h * sa) / sum(h * n), sum(h * sb) / sum(h * n) FROM (
    SELECT k, g.c, sa, sb, n, exp(-((g.x - z.c % 3) ** 2 + (g.y - z.c // 3) ** 2) / (2 * (1.5 * (1 - k / 19.0::DOUBLE) + 0.75 * k / 19.0::DOUBLE) ** 2)) AS h
    FROM g, (SELECT k, c, sum(a) AS sa, sum(b) AS sb, count(*) AS n FROM (
      SELECT object_id, start, any_value(k) AS k, any_value(a) AS a, any_value(b) AS b, arg_min(c, ((a - wa) * (a - wa) + (b - wb) * (b - wb), c)) AS c FROM pt, som WHERE k < 20 GROUP BY object_id, start) GROUP BY k, c) z) g
  GROUP BY k, g.c),
fin AS (SELECT c, wa, wb FROM som WHERE k = 20),
cell AS MATERIALIZED (
  SELECT object_id, start, any_value(a) AS a, any_value(b) AS b, arg_min(c, ((a - wa) * (a - wa) + (b - wb) * (b - wb), c)) AS c FROM pt, fin GROUP BY object_id, start),
lagged AS (
  SELECT object_id, start, (c % 3)::INTEGER AS x, (c // 3)::INTEGER AS y, lag((c % 3)::INTEGER) OVER o AS px, lag((c // 3)::INTEGER) OVER o AS py, lag(start) OVER o AS ps
  FROM cell WINDOW o AS (PARTITION BY object_id ORDER BY start)),
mv AS (SELECT * FROM lagged WHERE px IS NOT NULL AND (px <> x OR py <> y))"""

_FOUND = """
s AS (SELECT a.object_id, a.pos, a.t, min(b.pos) AS m FROM u a JOIN u b ON a.object_id = b.object_id AND b.pos > a.pos AND b.state = 'Valued' WHERE a.state = 'Failed' GROUP BY ALL),
d AS (SELECT s.object_id, s.t, u.t AS m, u.t - s.t AS d FROM s JOIN u ON u.object_id = s.object_id AND u.pos = s.m)"""


def _kept(kept_events: str, chosen: str) -> str:
    """SQL of a filtered log's events and links: conditions on ``ev`` rows and on objects (object_id, object_type)."""
    return f"""WITH {LOG},
o AS (SELECT DISTINCT object_id, object_type FROM rel), chosen AS (SELECT object_id FROM o WHERE {chosen}),
kept AS (SELECT * FROM ev WHERE {kept_events}),
r AS (SELECT rel.* FROM rel JOIN kept USING (seq) WHERE object_id IN (FROM chosen))"""


def _counts(kept_events: str, chosen: str, drop_bare: bool) -> str:
    """SQL of a filtered log's counts."""
    return f"""{_kept(kept_events, chosen)}
SELECT (SELECT count(*) FROM kept WHERE {'seq IN (SELECT seq FROM r)' if drop_bare else 'true'}) AS events, (SELECT count(DISTINCT object_id) FROM r) AS objects,
  (SELECT count(*) FROM r) AS e2o_relationships, (SELECT count(DISTINCT object_id) FROM r) AS objects_with_lifecycle"""


def _rows(kept_events: str, chosen: str) -> str:
    """SQL of what a filtered log keeps, where events without an object go."""
    return f"""{_kept(kept_events, chosen)}
SELECT 'event' AS kind, event_id, NULL::VARCHAR AS object_id FROM kept WHERE seq IN (SELECT seq FROM r)
UNION ALL SELECT DISTINCT 'object', NULL, object_id FROM r UNION ALL SELECT 'link', event_id, object_id FROM r JOIN ev USING (seq)"""


_NEXT = "(SELECT object_id, event_type AS a, lead(event_type) OVER (PARTITION BY object_id ORDER BY pos) AS b FROM life)"
_WORDS = """
lab AS (SELECT object_id, object_type, episode, list(event_type || ' [' || state || ']' ORDER BY pos) AS labels, any_value(state) AS state FROM runs WHERE object_type = 'user' GROUP BY ALL),
met AS (
  SELECT r.object_id, r.episode, r.event_type || ' [' || r.state || ']' AS label, o.object_type AS related FROM runs r JOIN rel o ON o.seq = r.seq AND o.object_id <> r.object_id WHERE r.object_type = 'user'),
prs AS (SELECT object_id, episode, list_distinct(list(label || '>' || related)) AS eo, list_distinct(list(least('user', related) || '>' || greatest('user', related))) AS oo FROM met GROUP BY ALL),
sp AS (SELECT lab.*, coalesce(eo, []) AS eo, coalesce(oo, []) AS oo FROM lab LEFT JOIN prs USING (object_id, episode))"""
_JOIN = "array_to_string(list_sort(list_distinct({})), '|')"
_ORDERS = """
placed AS (SELECT o_orderkey AS k, 'place-' || o_orderkey AS event_id, 'Place Order' AS event_type, epoch_us(o_orderdate) // 1000 AS t, o_orderkey::BIGINT * 1048576 AS seq, 'o' || o_orderkey AS o, 'c' || o_custkey AS c FROM orders),
lines AS (SELECT DISTINCT l_orderkey AS k, epoch_us(l_shipdate) // 1000 AS t, l_partkey AS p, l_suppkey AS s FROM lineitem),
ship AS (SELECT *, 'ship-' || k || '-' || (t // 86400000) AS event_id, k::BIGINT * 1048576 + 1 + t // 86400000 AS seq FROM lines),
oev AS (SELECT event_id, event_type, t, seq FROM placed UNION ALL SELECT DISTINCT event_id, 'Ship', t, seq FROM ship),
orel AS (
  SELECT seq, o AS object_id, 'order' AS object_type, 0 AS rel_seq FROM placed UNION ALL SELECT seq, c, 'customer', 1 FROM placed
  UNION ALL SELECT DISTINCT seq, 'o' || k, 'order', 0 FROM ship UNION ALL SELECT DISTINCT seq, 'p' || p, 'part', p + (1 << 30) FROM ship
  UNION ALL SELECT DISTINCT seq, 's' || s, 'supplier', s + (1::BIGINT << 31) FROM ship),
olife AS (
  SELECT object_id, object_type, event_id, event_type, t, row_number() OVER (PARTITION BY object_id ORDER BY t, oev.seq, rel_seq) - 1 AS pos FROM orel JOIN oev USING (seq))"""
_USERS = """
acts AS (SELECT 'u' || user_id AS object_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
  count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view, count(DISTINCT k) AS keys,
  coalesce(arg_max(value, (t, seq)) FILTER (event_type = 'purchase'), 0) AS last_purchase FROM ev GROUP BY user_id)"""
_FIT = """
vals AS (SELECT sqrt(click) AS clicks, CASE WHEN view > 0 THEN ln(view) ELSE 0 END AS views, purchase::DOUBLE AS sales FROM acts),
full_ AS (SELECT *, ((clicks - (SELECT avg(clicks) FROM vals)) / (SELECT stddev_pop(clicks) FROM vals) + (views - (SELECT avg(views) FROM vals)) / (SELECT stddev_pop(views) FROM vals)) / 2 AS interest FROM vals)"""

ORACLES = {
    "summary": f"""WITH {_ORDERS}
SELECT 2::BIGINT AS event_types, 4::BIGINT AS object_types, (SELECT count(*) FROM oev) AS events,
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(DISTINCT p) FROM lines) + (SELECT count(DISTINCT s) FROM lines) AS objects,
  (SELECT count(*) FROM orel) AS e2o_relationships, (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT k, p FROM lines)) AS o2o_relationships,
  (SELECT count(DISTINCT object_id) FROM orel) AS objects_with_lifecycle, 0::BIGINT AS stateful_events""",
    "text_attribute_options": "SELECT DISTINCT 'object' AS scope, 'priority' AS name, o_orderpriority AS value FROM orders UNION SELECT 'object', 'segment', c_mktsegment FROM customer",
    "time_histogram": f"""WITH {LOG},
b AS (SELECT min(t) AS lo, max(t) AS hi, greatest(max(t) - min(t), 1)::DOUBLE AS span FROM ev),
c AS (SELECT least(floor((t - lo) / span * 32), 31)::BIGINT AS bucket, count(*) AS n FROM ev, b GROUP BY 1)
SELECT i AS bucket, lo + round(span / 32 * i)::BIGINT AS start_ms, CASE WHEN i = 31 THEN hi ELSE lo + round(span / 32 * (i + 1))::BIGINT END AS end_ms, coalesce(n, 0)::BIGINT AS count
FROM range(32) g(i) CROSS JOIN b LEFT JOIN c ON bucket = i""",
    "object_search": f"WITH {LOG} SELECT object_id, 'user' AS object_type, count(*) AS event_count FROM rel WHERE object_type = 'user' AND contains(object_id, '1') GROUP BY object_id ORDER BY substr(object_id, 2)::BIGINT LIMIT 40",
    "lifecycle_order": f"WITH {_ORDERS} SELECT object_id, pos, event_id, event_type, t AS time_ms FROM olife WHERE object_type = 'order'",
    "lifecycle_related": f"WITH {LOG} SELECT object_id, object_type, 'subject' AS qualifier, count(*) AS count FROM rel WHERE seq IN (SELECT seq FROM rel WHERE object_id = 'u1') AND object_id <> 'u1' GROUP BY ALL",
    "state_bands": f"""WITH {STATED},
x AS (SELECT l.object_id, l.pos, l.t, st.state, CASE WHEN st.state IS DISTINCT FROM lag(st.state) OVER (PARTITION BY object_id ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS new FROM life l JOIN st USING (seq) WHERE object_type = 'user'),
y AS (SELECT *, sum(new) OVER (PARTITION BY object_id ORDER BY pos) AS g FROM x)
SELECT object_id, state, arg_min(t, pos) AS start_ms, arg_max(t, pos) AS end_ms, count(*) AS event_count FROM y WHERE state IS NOT NULL GROUP BY object_id, g, state""",
    "filter_event_types": _counts("event_type IN ('purchase', 'signup')", "true", False),
    "filter_object_types": _counts("true", "object_type = 'key'", True),
    "filter_time_range": _counts(f"t BETWEEN {T0} AND {T1}", "true", False),
    "filter_df_node": _counts("true", "object_type = 'user' AND object_id IN (SELECT object_id FROM life WHERE event_type = 'signup') AND object_id IN (SELECT object_id FROM life WHERE event_type = 'error')", True),
    "filter_df_edge": _counts("true", f"object_id IN (SELECT object_id FROM {_NEXT} WHERE a = 'purchase' AND b = 'purchase') AND object_id IN (SELECT object_id FROM {_NEXT} WHERE a = 'signup' AND b = 'error')", True),
    "filter_text_attribute": _counts("true", "object_id IN (SELECT object_id FROM rel JOIN ev USING (seq) WHERE k IN (7, 12))", True),
    "filter_combined": _counts(f"event_type IN ('click', 'view', 'error') AND t <= {T1}", "object_type = 'user' AND object_id IN (SELECT object_id FROM life WHERE event_type = 'signup')", True),
    "filter_combined_rows": _rows(f"event_type IN ('click', 'view', 'error') AND t <= {T1}", "object_type = 'user' AND object_id IN (SELECT object_id FROM life WHERE event_type = 'signup')"),
    "filter_df_edge_rows": _rows("true", f"object_id IN (SELECT object_id FROM {_NEXT} WHERE a = 'purchase' AND b = 'purchase') AND object_id IN (SELECT object_id FROM {_NEXT} WHERE a = 'signup' AND b = 'error')"),
    "filter_text_attribute_rows": _rows("true", "object_id IN (SELECT object_id FROM rel JOIN ev USING (seq) WHERE k IN (7, 12))"),
    "filter_pattern": f"WITH {STATED}, {_WORDS} SELECT DISTINCT object_id, 'user' AS object_type FROM sp WHERE state = 'Failed' AND labels = ['error [Failed]'] AND eo = ['error [Failed]>key'] AND oo = ['key>user']",
    "dfg_user": f"WITH {LOG}, u AS (SELECT * FROM life WHERE object_type = 'user')" + EDGE.format("u"),
    "oc_dfg_nodes": f"WITH {LOG}" + SPOTS,
    "oc_dfg_edges": f"WITH {LOG}" + EDGE.format("life"),
    "oc_dfg_orders": f"WITH {_ORDERS}" + EDGE.format("olife"),
    "oc_dfg_layout": f"WITH {LOG}, {_DRAWN} SELECT id, label, kind, shape, color, object_type, count, x, y, width, height, lines FROM places",
    "oc_dfg_routes": f"""WITH {LOG}, {_DRAWN},
e AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY object_type) - 1 AS i, count(*) OVER (PARTITION BY source, target) AS k FROM ({EDGE.format('life')})),
b AS (
  SELECT e.source, e.target, e.object_type, e.weight, s.id AS sid, t.id AS tid, s.x AS sx, s.y AS sy, s.width AS sw, s.y + s.height / 2 AS sm, t.x AS tx, t.width AS tw, t.y + t.height / 2 AS tm, (i - (k - 1) / 2) * 30 AS lane, types.color
  FROM e JOIN places s ON s.label = e.source JOIN places t ON t.label = e.target JOIN types ON types.object_type = e.object_type),
p AS (
  SELECT *, CASE WHEN sid = tid OR sx + sw <= tx THEN sx + sw ELSE sx END AS x0, CASE WHEN sid = tid THEN sx WHEN sx + sw <= tx THEN tx ELSE tx + tw END AS x3 FROM b),
q AS (
  SELECT *, CASE WHEN sid = tid THEN x0 + 44 ELSE (x0 + x3) / 2 END AS x1, CASE WHEN sid = tid THEN sx + sw / 2 ELSE (x0 + x3) / 2 END AS x2,
    CASE WHEN sid = tid THEN sm - 42 + lane ELSE sm + lane END AS y1, CASE WHEN sid = tid THEN sy - 28 + lane ELSE tm + lane END AS y2, CASE WHEN sid = tid THEN sm - 16 ELSE tm END AS y3 FROM p)
SELECT 'e' || row_number() OVER (ORDER BY weight DESC, sid, tid, object_type) AS id, sid AS source, tid AS target, weight, object_type, color,
  printf('M %.1f %.1f C %.1f %.1f %.1f %.1f %.1f %.1f', x0, sm, x1, y1, x2, y2, x3, y3) AS path, (x1 + x2) / 2 AS label_x, (y1 + y2) / 2 - 6 AS label_y FROM q""",
    "df_edge_options": f"""WITH {LOG}, n AS (SELECT object_id, event_type AS source, lead(event_type) OVER (PARTITION BY object_id ORDER BY pos) AS target FROM life)
SELECT source, target, source || ' -> ' || target AS label, count(*) AS weight FROM n WHERE target IS NOT NULL GROUP BY source, target""",
    "oc_dfg_filtered": f"WITH {LOG}" + EDGE.format("life") + " HAVING count(*) >= 100",
    "state_query_event": f"WITH {LOG} SELECT event_id, CASE WHEN value >= 50 AND event_type <> 'view' THEN event_type WHEN coalesce(k < 10, false) THEN 'low' ELSE 'rest' END AS state FROM ev",
    "state_query_asof_object": f"WITH {STATED} SELECT event_id, state FROM st WHERE state IS NOT NULL",
    "state_query_not_null_logic": f"WITH {ASOF} SELECT event_id, CASE WHEN NOT coalesce(last_purchase > 30, false) THEN 'small or none' WHEN last_purchase = floor(last_purchase) THEN last_purchase::BIGINT::VARCHAR ELSE last_purchase::VARCHAR END AS state FROM seen",
    "state_query_like": f"WITH {LOG} SELECT event_id, CASE WHEN event_type LIKE '%i%w' THEN 'seen' WHEN event_type LIKE 'c%' OR event_type = 'error' THEN 'true' ELSE '1.5' END AS state FROM ev",
    "state_aware_dfg_edges": f"""WITH {STATED}, {STEPS}
SELECT source, target, 'user' AS object_type, count(*) AS weight FROM (
  SELECT 'START' || chr(10) || 'user' AS source, label AS target FROM sc WHERE pos = 0
  UNION ALL SELECT label, coalesce(nl, 'END' || chr(10) || 'user') FROM sc WHERE ch IS NULL
  UNION ALL SELECT label, ch FROM sc WHERE ch IS NOT NULL UNION ALL SELECT ch, nl FROM sc WHERE ch IS NOT NULL) GROUP BY source, target""",
    "state_aware_dfg_nodes": f"""WITH {STATED}, {STEPS}
SELECT label, kind, count(*) AS count, round(avg(o), 6) AS avg_order FROM (
  SELECT label, 'activity' AS kind, 2 * pos + 1 AS o FROM sc UNION ALL SELECT 'START' || chr(10) || 'user', 'start', 0 FROM sc WHERE pos = 0
  UNION ALL SELECT 'END' || chr(10) || 'user', 'end', 2 * pos + 2 FROM sc WHERE nl IS NULL UNION ALL SELECT ch, 'state_change', 2 * pos + 2 FROM sc WHERE ch IS NOT NULL) GROUP BY label, kind""",
    "episodes": f"WITH {STATED} SELECT object_id, episode, state, start_ms, last_ms, event_count, dwell_ms, next_state FROM uep",
    "transition_kpis": f"WITH {STATED} SELECT state AS from_state, next_state AS to_state, count(*) AS count, count(DISTINCT object_id) AS object_count, {STATS.format('dwell_ms')} FROM uep WHERE next_state IS NOT NULL GROUP BY state, next_state",
    "transition_matrix": f"""WITH {STATED}, s AS (SELECT DISTINCT state FROM uep),
p AS (SELECT state AS a, next_state AS b, count(*) AS n, count(DISTINCT object_id) AS o, list_sort(list(dwell_ms))[count(*) // 2 + 1] AS m FROM uep WHERE next_state IS NOT NULL GROUP BY ALL)
SELECT x.state AS from_state, y.state AS to_state, coalesce(n, 0) AS count, coalesce(o, 0) AS object_count, m AS median_ms, round(coalesce(n / (SELECT max(n) FROM p), 0), 6) AS intensity
FROM s x CROSS JOIN s y LEFT JOIN p ON a = x.state AND b = y.state""",
    "performance_quartiles": f"""WITH {STATED}, u AS (SELECT * FROM slife WHERE object_type = 'user'), {_FOUND}, q AS (SELECT list_sort(list(d)) AS l FROM d WHERE d >= 0)
SELECT object_id, t AS start_time_ms, m AS middle_time_ms, NULL::BIGINT AS end_time_ms, d AS duration_ms,
  CASE WHEN d <= l[len(l) // 4 + 1] THEN 1 WHEN d <= l[len(l) // 2 + 1] THEN 2 WHEN d <= l[len(l) * 3 // 4 + 1] THEN 3 ELSE 4 END AS quartile FROM d, q WHERE d >= 0""",
    "dwell_kpis": f"WITH {STATED} SELECT state, count(*) AS episode_count, count(DISTINCT object_id) AS object_count, sum(dwell_ms)::BIGINT AS total_ms, {STATS.format('dwell_ms')} FROM uep GROUP BY state",
    "recovery": f"WITH {STATED} SELECT state AS from_state, next_state AS to_state, count(*) AS count, count(DISTINCT object_id) AS object_count, {STATS.format('dwell_ms')} FROM uep WHERE regexp_matches(lower(next_state), 'normal|available|standard') GROUP BY state, next_state",
    "stuck_states": f"WITH {STATED} SELECT object_id, state, start_ms AS entered_time_ms, last_ms AS last_time_ms, dwell_ms AS duration_ms, event_count FROM uep WHERE next_state IS NULL ORDER BY dwell_ms DESC, object_id LIMIT 25",
    "time_buckets": f"""WITH {STATED},
b AS (SELECT min(t) AS lo, max(t) AS hi, greatest(max(t) - min(t), 1)::DOUBLE AS span FROM ev),
c AS (SELECT least(floor((t - lo) / span * 32), 31)::BIGINT AS bucket, state, count(*) AS n FROM ev JOIN st USING (seq), b WHERE state IS NOT NULL GROUP BY 1, 2),
g AS (SELECT i AS bucket, state, coalesce(n, 0) AS n FROM range(32) r(i) CROSS JOIN (SELECT DISTINCT state FROM st WHERE state IS NOT NULL) LEFT JOIN c USING (state) WHERE c.bucket = i OR NOT EXISTS (FROM c c2 WHERE c2.bucket = i AND c2.state = c.state)),
h AS (SELECT bucket, state, max(CASE WHEN n2 IS NULL THEN 0 ELSE n2 END) AS n FROM (SELECT i AS bucket, s.state, c.n AS n2 FROM range(32) r(i) CROSS JOIN (SELECT DISTINCT state FROM st WHERE state IS NOT NULL) s LEFT JOIN c ON c.bucket = i AND c.state = s.state) GROUP BY ALL)
SELECT bucket, lo + round(span / 32 * bucket)::BIGINT AS start_ms, CASE WHEN bucket = 31 THEN hi ELSE lo + round(span / 32 * (bucket + 1))::BIGINT END AS end_ms,
  (sum(n) OVER (PARTITION BY bucket))::BIGINT AS total, state, n::BIGINT AS count, round(CASE WHEN sum(n) OVER (PARTITION BY bucket) = 0 THEN 0 ELSE n / sum(n) OVER (PARTITION BY bucket) * 100 END, 6) AS percentage FROM h, b""",
    "performance_spectrum": f"""WITH {STATED}, u AS (SELECT * FROM slife WHERE object_type = 'user'),
s AS (SELECT a.object_id, a.pos, a.t, min(b.pos) AS m FROM u a JOIN u b ON a.object_id = b.object_id AND b.pos > a.pos AND b.state = 'Valued' WHERE a.state = 'Failed' GROUP BY ALL),
d AS (SELECT u.t - s.t AS d FROM s JOIN u ON u.object_id = s.object_id AND u.pos = m)
SELECT count(*) AS sample_count, min(d) AS min_ms, list_sort(list(d))[count(*) // 2 + 1] AS median_ms, round(avg(d), 6) AS avg_ms, max(d) AS max_ms FROM d WHERE d >= 0""",
    "performance_roundtrip": f"""WITH {STATED}, u AS (SELECT * FROM slife WHERE object_type = 'user'),
s AS (SELECT a.object_id, a.pos, a.t, min(b.pos) AS m FROM u a JOIN u b ON a.object_id = b.object_id AND b.pos > a.pos AND b.state = 'Idle' WHERE a.state = 'Failed' GROUP BY ALL),
e AS (SELECT s.*, min(c.pos) AS f FROM s JOIN u c ON c.object_id = s.object_id AND c.pos > m AND c.state = 'Failed' GROUP BY ALL)
SELECT e.object_id, e.t AS start_time_ms, x.t AS middle_time_ms, y.t AS end_time_ms, y.t - e.t AS duration_ms FROM e JOIN u x ON x.object_id = e.object_id AND x.pos = m JOIN u y ON y.object_id = e.object_id AND y.pos = f WHERE y.t >= e.t""",
    "dominant_state": f"WITH {STATED} SELECT object_id, state FROM (SELECT object_id, state, row_number() OVER (PARTITION BY object_id ORDER BY count(*) DESC, max(pos) DESC, state) AS r FROM slife WHERE object_type = 'user' GROUP BY object_id, state) WHERE r = 1",
    "patterns_intra": f"""SELECT 'intra-' || row_number() OVER (ORDER BY support DESC, mass DESC, label, sequence, eo, oo) AS id, * FROM (
SELECT *, state || ' on ' || leading_object_type AS label FROM (WITH {STATED}, {_WORDS}
SELECT 'user' AS leading_object_type, state, NULL::VARCHAR AS to_state, 'START ' || state || '|' || array_to_string(labels, '|') || '|END ' || state AS sequence, {_JOIN.format('eo')} AS eo, {_JOIN.format('oo')} AS oo, count(*) AS support, count(*) * (len(any_value(labels)) + 1) AS mass
FROM sp GROUP BY ALL))""",
    "patterns_inter": f"""SELECT 'inter-' || row_number() OVER (ORDER BY support DESC, mass DESC, label, sequence, eo, oo) AS id, * FROM (
SELECT *, state || ' -> ' || to_state || ' on ' || leading_object_type AS label FROM (WITH {STATED}, {_WORDS},
n AS (SELECT *, lead(state) OVER w AS ns, lead(labels) OVER w AS nl, lead(eo) OVER w AS neo, lead(oo) OVER w AS noo FROM sp WINDOW w AS (PARTITION BY object_id ORDER BY episode))
SELECT 'user' AS leading_object_type, state, ns AS to_state, 'START ' || state || '|' || array_to_string(labels, '|') || '|CHANGE ' || state || ' -> ' || ns || '|' || array_to_string(nl, '|') || '|END ' || ns AS sequence,
  {_JOIN.format('eo || neo')} AS eo, {_JOIN.format('oo || noo')} AS oo, count(*) AS support, count(*) * (len(any_value(labels)) + len(any_value(nl)) + 2) AS mass FROM n WHERE ns IS NOT NULL GROUP BY ALL))""",
    "feature_table": f"""WITH {_ORDERS}
SELECT object_id, 'activity.' || event_type AS feature, count(*)::DOUBLE AS value FROM olife WHERE object_type = 'order' GROUP BY object_id, event_type
UNION ALL SELECT object_id, 'related_objects.' || type, count(DISTINCT other)::DOUBLE FROM (
  SELECT a.object_id, b.object_id AS other, b.object_type AS type FROM orel a JOIN orel b ON a.seq = b.seq AND a.object_id <> b.object_id WHERE a.object_type = 'order') GROUP BY object_id, type
UNION ALL SELECT 'o' || o_orderkey, 'attribute.priority=' || o_orderpriority, 1.0 FROM orders UNION ALL SELECT 'o' || o_orderkey, 'attribute.total', o_totalprice FROM orders""",
    "feature_table_wide": f"WITH {LOG}, {_USERS} SELECT object_id, click::DOUBLE AS click, error::DOUBLE AS error, purchase::DOUBLE AS purchase, signup::DOUBLE AS signup, view::DOUBLE AS view, keys::DOUBLE AS keys, last_purchase FROM acts",
    "state_correlation": f"""WITH {STATED}, {_USERS},
dom AS (SELECT object_id, state FROM (SELECT object_id, state, row_number() OVER (PARTITION BY object_id ORDER BY count(*) DESC, max(pos) DESC, state) AS r FROM slife WHERE object_type = 'user' GROUP BY object_id, state) WHERE r = 1),
long AS (
  SELECT object_id, f.name AS feature, f.v AS v FROM acts, (SELECT unnest([
    {{name: 'activity.click', v: click::DOUBLE}}, {{name: 'activity.error', v: error::DOUBLE}}, {{name: 'activity.purchase', v: purchase::DOUBLE}}, {{name: 'activity.signup', v: signup::DOUBLE}},
    {{name: 'activity.view', v: view::DOUBLE}}, {{name: 'related_objects.key', v: keys::DOUBLE}}, {{name: 'attribute.last_purchase', v: last_purchase}}]) AS f)),
tot AS (SELECT feature, count(*) AS n, sum(v) AS s, sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) ** 2, 0)) AS sd FROM long JOIN dom USING (object_id) GROUP BY feature),
grp AS (SELECT feature, state, count(*) AS c, sum(v) AS gs FROM long JOIN dom USING (object_id) GROUP BY feature, state),
cor AS (SELECT feature, state, n, c, gs / c AS i, CASE WHEN n > c THEN (s - gs) / (n - c) ELSE 0 END AS o, sd FROM grp JOIN tot USING (feature)),
r AS (SELECT *, CASE WHEN n >= 2 AND n > c AND sd > 2.220446049250313e-16 THEN least(greatest((i - o) * sqrt(c / n * (n - c) / n) / sd, -1), 1) ELSE 0 END AS r FROM cor)
SELECT feature, state, round(r, 6) + 0.0 AS correlation, round(abs(r), 6) AS strength, n AS sample_count, c AS state_count, round(i, 6) AS mean_in_state, round(o, 6) AS mean_outside_state
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(abs(r), 12) DESC, state) AS k FROM r) WHERE k = 1""",
    "causal_fit_nodes": f"""WITH {LOG}, {_USERS}, {_FIT}
SELECT 'clicks' AS id, 'clicks' AS label, 'observable' AS role, 'activity.click' AS feature, 'sqrt' AS operation, round(avg(clicks), 6) AS mean, round(stddev_pop(clicks), 6) AS std_dev FROM full_
UNION ALL SELECT 'views', 'views', 'observable', 'activity.view', 'log_e', round(avg(views), 6), round(stddev_pop(views), 6) FROM full_
UNION ALL SELECT 'interest', 'interest', 'latent', NULL, 'identity', round(avg(interest), 6) + 0.0, round(stddev_pop(interest), 6) FROM full_
UNION ALL SELECT 'sales', 'sales', 'outcome', 'activity.purchase', 'identity', round(avg(sales), 6), round(stddev_pop(sales), 6) FROM full_""",
    "causal_fit_edges": f"""WITH {LOG}, {_USERS}, {_FIT},
c AS (SELECT 'clicks' AS source, 'interest' AS target, corr(clicks, interest) AS r, count(*) AS n FROM full_ UNION ALL SELECT 'views', 'interest', corr(views, interest), count(*) FROM full_ UNION ALL SELECT 'interest', 'sales', corr(interest, sales), count(*) FROM full_)
SELECT source, target, round(r, 6) AS correlation, round(abs(r), 6) AS intensity, round(exp(0 - (r * r * (n - 2) / greatest(1 - r * r, 1e-12)) / 2), 6) AS p_value, n AS sample_count FROM c""",
    "window_features": f"WITH {ASOF}, {_SPANS} {_VALUES}",
    "pca_projection": f"WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA} SELECT object_id, start, round(a, 6) + 0.0 AS pc1, round(b, 6) + 0.0 AS pc2 FROM pt",
    "som_batch_cells": f"""WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA}, {_BATCH},
act AS (SELECT object_id, start, event_type, row_number() OVER (PARTITION BY object_id, start ORDER BY count(*) DESC, event_type) AS r FROM we GROUP BY object_id, start, event_type),
top AS (SELECT c, event_type, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, event_type) AS r FROM act JOIN cell USING (object_id, start) WHERE r = 1 GROUP BY c, event_type),
m AS (SELECT c, count(*) AS n, avg(a) AS a, avg(b) AS b FROM cell GROUP BY c)
SELECT g.x, g.y, 'S' || (g.x + 1) || '-' || (g.y + 1) AS label, coalesce(n, 0) AS count, round(coalesce(m.a, f.wa), 6) + 0.0 AS avg_pc1, round(coalesce(m.b, f.wb), 6) + 0.0 AS avg_pc2,
  top.event_type AS dominant_activity, round(coalesce(n, 0) / max(n) OVER (), 6) AS color_value, coalesce(n, 0) || ' windows' AS color_label, 'count' AS color_kind
FROM g JOIN fin f USING (c) LEFT JOIN m USING (c) LEFT JOIN top ON top.c = g.c AND top.r = 1""",
    "som_batch_transitions": f"""WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA}, {_BATCH}
SELECT px AS source_x, py AS source_y, x AS target_x, y AS target_y, count(*) AS count, abs(px - x) + abs(py - y) AS distance, abs(px - x) + abs(py - y) <= 1 AS nearby FROM mv GROUP BY px, py, x, y""",
    "som_batch_boundary": f"""WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA}, {_BATCH}
SELECT 'entering' AS direction, object_id, start, px AS other_x, py AS other_y FROM mv WHERE x = 1 AND y = 1
UNION ALL SELECT 'exiting', object_id, ps, x, y FROM mv WHERE px = 1 AND py = 1""",
    "apply_batch_detection": f"""WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA}, {_BATCH},
votes AS (SELECT seq AS event_seq, c, count(*) AS n, max((substr(object_id, 2)::BIGINT, start)) AS last FROM we JOIN cell USING (object_id, start) GROUP BY seq, c)
SELECT event_seq::VARCHAR AS event_id, event_seq, 'S' || (c % 3 + 1) || '-' || (c // 3 + 1) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_seq ORDER BY n DESC, last DESC) AS r FROM votes) WHERE r = 1""",
    "lifecycle_windows": f"""WITH {LOG}, u AS (SELECT *, count(*) OVER (PARTITION BY object_id) AS n FROM life WHERE object_type = 'user'),
w AS (SELECT a.object_id, a.pos AS start, b.t AS e FROM u a JOIN u b ON a.object_id = b.object_id AND b.pos = least(a.pos + 3, a.n - 1) WHERE a.pos <= greatest(a.n - 4, 0))
SELECT object_id, count(*) AS windows, sum(start)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM w GROUP BY object_id""",
}


def _listed(part: str, shown: str, order: str, rows: str) -> str:
    """SQL of a document's list: ``shown`` is a struct."""
    return f"SELECT '{part}' AS part, row_number() OVER (ORDER BY {order}) - 1 AS place, to_json({shown})::VARCHAR AS json FROM ({rows})"


#: DuckDB writes decimals of JSON as doubles: their text goes in as it is.
def _plain(sql: str, *numbers: str) -> str:
    for n in numbers:
        sql = f"SELECT part, place, regexp_replace(json, '\"{n}\":\"([^\"]*)\"', '\"{n}\":\\1', 'g') AS json FROM ({sql})"
    return sql


def _text(c: str) -> str:
    return f"{c}::DECIMAL(38,6)::VARCHAR"


_STATS = "min_duration_ms: min_ms, median_duration_ms: median_ms, max_duration_ms: max_ms, avg_duration_ms: " + _text("avg_ms")
_HEAD = "(SELECT count(DISTINCT object_id) FROM rel WHERE object_type = 'user')"
ORACLES["kpi_document"] = _plain(
    " UNION ALL ".join([
        f"SELECT '' AS part, 0 AS place, to_json({{object_type: 'user', object_count: o, stateful_object_count: n, state_count: len(s), states: s}})::VARCHAR AS json FROM (WITH {STATED} SELECT {_HEAD} AS o, count(DISTINCT object_id) AS n, list_sort(list(DISTINCT state)) AS s FROM uep)",
        _listed("transitions", f"{{from_state: from_state, to_state: to_state, count: count, object_count: object_count, {_STATS}}}", "count DESC, from_state, to_state", ORACLES["transition_kpis"]),
        _listed("recovery_times", f"{{from_state: from_state, to_state: to_state, count: count, object_count: object_count, {_STATS}}}", "count DESC, from_state, to_state", ORACLES["recovery"]),
        _listed("dwell_times", f"{{state: state, episode_count: episode_count, object_count: object_count, total_duration_ms: total_ms, {_STATS}}}", "total_ms DESC, state", ORACLES["dwell_kpis"]),
        _listed("stuck_objects", "{object_id: object_id, state: state, entered_time_ms: entered_time_ms, last_time_ms: last_time_ms, duration_ms: duration_ms, event_count: event_count}", "duration_ms DESC, object_id", ORACLES["stuck_states"]),
    ]), "avg_duration_ms",
)
ORACLES["correlation_document"] = _plain(
    " UNION ALL ".join([
        f"SELECT '' AS part, 0 AS place, to_json({{object_type: 'user', object_count: o, stateful_object_count: n, state_count: s, feature_count: f}})::VARCHAR AS json FROM (WITH {STATED} SELECT {_HEAD} AS o), (SELECT count(*) AS n, count(DISTINCT state) AS s FROM ({ORACLES['dominant_state']})), (SELECT count(*) AS f FROM ({ORACLES['state_correlation']}))",
        _listed("state_distribution", "{state: state, count: n}", "state", f"SELECT state, count(*) AS n FROM ({ORACLES['dominant_state']}) GROUP BY state"),
        _listed("rows", f"{{feature: feature, state: state, correlation: {_text('correlation')}, strength: {_text('strength')}, sample_count: sample_count, state_count: state_count, mean_in_state: {_text('mean_in_state')}, mean_outside_state: {_text('mean_outside_state')}}}", "strength DESC, feature", ORACLES["state_correlation"]),
    ]), "correlation", "strength", "mean_in_state", "mean_outside_state",
)
ORACLES["time_document"] = _plain(
    " UNION ALL ".join([
        f"""SELECT '' AS part, 0 AS place, to_json({{object_type: 'user', event_min_ms: lo, event_max_ms: hi, states: s, performance: {{object_type: 'user', from_state: 'Failed', to_state: 'Valued', roundtrip: false,
          sample_count: sample_count, min_duration_ms: min_ms, median_duration_ms: median_ms, avg_duration_ms: avg, max_duration_ms: max_ms}}}})::VARCHAR AS json
        FROM (WITH {LOG} SELECT min(t) AS lo, max(t) AS hi FROM ev), (WITH {STATED} SELECT list_sort(list(DISTINCT state)) AS s FROM st WHERE state IS NOT NULL), ({ORACLES['performance_spectrum']}),
          (SELECT avg(duration_ms) AS avg FROM ({ORACLES['performance_quartiles']}))""",
        _listed("buckets", "{start_ms: start_ms, end_ms: end_ms, total: total, percentages: p}", "start_ms, end_ms", f"SELECT start_ms, end_ms, total, list({{state: state, percentage: {_text('percentage')}, count: count}} ORDER BY state) AS p FROM ({ORACLES['time_buckets']}) GROUP BY bucket, start_ms, end_ms, total"),
        _listed("samples", "{object_id: object_id, start_time_ms: start_time_ms, middle_time_ms: middle_time_ms, end_time_ms: end_time_ms, duration_ms: duration_ms}", "start_time_ms, duration_ms, object_id, middle_time_ms", ORACLES["performance_quartiles"]),
    ]), "percentage",
)
_OWN = "own AS (SELECT l.pos, l.seq, l.event_id, l.event_type, l.t, st.state, e.value, e.k FROM life l JOIN ev e USING (seq) JOIN st USING (seq) WHERE l.object_id = 'u1')"
_VALUE = "CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END"
ORACLES["lifecycle_document"] = " UNION ALL ".join([
    f"SELECT '' AS part, 0 AS place, to_json({{object_id: 'u1', object_type: 'user', event_count: n, event_min_ms: lo, event_max_ms: hi}})::VARCHAR AS json FROM (WITH {STATED}, {_OWN} SELECT count(*) AS n, min(t) AS lo, max(t) AS hi FROM own)",
    _listed("events", "{event_id: event_id, event_type: event_type, time_ms: t, state: state, attributes: a, related_objects: r}", "pos", f"""WITH {STATED}, {_OWN} SELECT *,
      list_concat([{{name: 'value', value: {_VALUE}}}, {{name: 'k', value: k::VARCHAR}}], CASE WHEN state IS NULL THEN [] ELSE [{{name: 'state', value: state}}] END) AS a,
      CASE WHEN k IS NULL THEN [] ELSE [{{object_id: 'k' || k, object_type: 'key', qualifier: 'subject'}}] END AS r FROM own"""),
    _listed("state_bands", "{state: state, start_ms: start_ms, end_ms: end_ms, event_count: event_count}", "start_ms, end_ms, state", f"SELECT * FROM ({ORACLES['state_bands']}) WHERE object_id = 'u1'"),
    _listed("related_objects", "{object_id: object_id, object_type: object_type, qualifier: qualifier, event_count: count}", "object_id, qualifier", ORACLES["lifecycle_related"]),
])


def _decimals(sql: str) -> str:
    """``_plain`` for all texts of numbers with six decimals."""
    return f"SELECT part, place, regexp_replace(json, '\"(-?[0-9]+[.][0-9]{{6}})\"', '\\1', 'g') AS json FROM ({sql})"


ORACLES["causal_document"] = _decimals(" UNION ALL ".join([
    _listed("nodes", f"{{id: id, label: label, role: role, feature: feature, operation: operation, mean: {_text('mean')}, std_dev: {_text('std_dev')}}}", "list_position(['clicks', 'views', 'interest', 'sales'], id)", ORACLES["causal_fit_nodes"]),
    _listed("edges", f"{{source: source, target: target, correlation: {_text('correlation')}, intensity: {_text('intensity')}, p_value: {_text('p_value')}, sample_count: sample_count}}", "source, target", ORACLES["causal_fit_edges"]),
]))
_MAPPED = f"WITH RECURSIVE {ASOF}, {_SPANS}, {_PCA}, {_BATCH}"
_CELL = f"{{x: x, y: y, label: label, count: count, avg_pc1: {_text('avg_pc1')}, avg_pc2: {_text('avg_pc2')}, dominant_activity: dominant_activity, color_value: {_text('color_value')}, color_label: color_label, color_kind: color_kind}}"
_ENDS = "(SELECT object_id, start, min(seq)::VARCHAR AS se, max(seq)::VARCHAR AS ee, list(event_type ORDER BY seq) AS acts FROM we GROUP BY object_id, start)"
ORACLES["detection_document"] = _decimals(" UNION ALL ".join([
    f"""SELECT '' AS part, 0 AS place, to_json({{object_type: 'user', window_size: 4, som_width: 3, som_height: 3, color_attribute: NULL, object_count: o, feature_count: len(f), window_count: n, feature_columns: f, table_columns: f,
      pca: {{pc1_variance: round(l1, 6), pc2_variance: round(l2, 6), pc1_explained_ratio: round(l1 / tr, 6), pc2_explained_ratio: round(l2 / tr, 6)}}}})::VARCHAR AS json FROM ({_MAPPED}
      SELECT (SELECT count(DISTINCT object_id) FROM pt) AS o, (SELECT count(*) FROM pt) AS n, (SELECT list(feature ORDER BY i) FROM nm) AS f, c1.l AS l1, list_sum(list_transform(mx.m, lambda r, i: r[i])) AS tr,
        (SELECT list_dot_product(v, list_transform(mx.m, lambda r: list_dot_product(r, v))) FROM p2, mx WHERE k = 80) AS l2 FROM c1, mx)""",
    _listed("table_preview", "{object_id: object_id, values: v}", "substr(object_id, 2)::BIGINT", f"SELECT object_id, list_transform([click, error, purchase, signup, view, keys, last_purchase], lambda y: y::DECIMAL(38,6)::VARCHAR) AS v FROM ({ORACLES['feature_table_wide']}) ORDER BY substr(object_id, 2)::BIGINT LIMIT 15"),
    _listed("color_options", "{id: id, label: label, kind: kind}", "id", "SELECT '__window_count' AS id, 'Assigned windows' AS label, 'count' AS kind UNION ALL SELECT 'attribute::last_purchase', 'last_purchase', 'numeric'"),
    _listed("cells", _CELL, "y, x", ORACLES["som_batch_cells"]),
    _listed("transitions", "{source_x: source_x, source_y: source_y, target_x: target_x, target_y: target_y, count: count, distance: distance, nearby: nearby}", "count DESC, distance, source_y, source_x, target_y, target_x", ORACLES["som_batch_transitions"]),
    _listed("windows", f"{{object_id: object_id, start_event: se, end_event: ee, pc1: {_text('a')}, pc2: {_text('b')}, cell_x: c % 3, cell_y: c // 3}}", "substr(object_id, 2)::BIGINT, start", f"{_MAPPED} SELECT * FROM cell JOIN {_ENDS} USING (object_id, start) ORDER BY substr(object_id, 2)::BIGINT, start LIMIT 500"),
]))


def _around(direction: str, own: str) -> str:
    """SQL of the windows that enter or leave the cell in the middle, and of their graph's nodes and edges."""
    chosen = f"{_MAPPED}, sel AS ({own}), gw AS (SELECT object_id || '@' || start AS o, event_type, seq FROM we SEMI JOIN sel USING (object_id, start))"
    name = "graph" if direction == "own" else f"{direction}_graph"
    start, end = "'START' || chr(10) || 'user'", "'END' || chr(10) || 'user'"
    edges = f"""{chosen} SELECT source, target, count(*) AS weight FROM (
      SELECT event_type AS source, coalesce(lead(event_type) OVER (PARTITION BY o ORDER BY seq), {end}) AS target FROM gw UNION ALL SELECT {start}, arg_min(event_type, seq) FROM gw GROUP BY o) GROUP BY ALL"""
    nodes = f"""{chosen} SELECT label, kind, count(*) AS n FROM (
      SELECT event_type AS label, 'activity' AS kind FROM gw UNION ALL SELECT {start}, 'start' FROM (SELECT DISTINCT o FROM gw) UNION ALL SELECT {end}, 'end' FROM (SELECT DISTINCT o FROM gw)) GROUP BY ALL"""
    found = [_listed(f"{name}_nodes", "{label: label, kind: kind, count: n}", "kind, label", nodes), _listed(f"{name}_edges", "{source: source, target: target, weight: weight}", "weight DESC, source, target", edges)]
    if direction != "own":
        cell = lambda x, y: f"'S' || ({x} + 1) || '-' || ({y} + 1)"
        ends = (cell("ox", "oy"), "'S2-2'") if direction == "entering" else ("'S2-2'", cell("ox", "oy"))
        shown = f"{{object_id: object_id, start_event: se, end_event: ee, source_cell: {ends[0]}, target_cell: {ends[1]}, pc1: {_text('a')}, pc2: {_text('b')}, activities: acts}}"
        order = "substr(object_id, 2)::BIGINT, start"
        found.append(_listed(f"{direction}_windows", shown, order, f"{chosen} SELECT * FROM sel JOIN cell USING (object_id, start) JOIN {_ENDS} USING (object_id, start) ORDER BY {order} LIMIT 100"))
    return " UNION ALL ".join(found)


ORACLES["cell_document"] = _decimals(" UNION ALL ".join([
    f"SELECT '' AS part, 0 AS place, to_json({{entering_count: a, exiting_count: b}})::VARCHAR AS json FROM (SELECT count(*) FILTER (direction = 'entering') AS a, count(*) FILTER (direction = 'exiting') AS b FROM ({ORACLES['som_batch_boundary']}))",
    _listed("cell", _CELL, "x", f"SELECT * FROM ({ORACLES['som_batch_cells']}) WHERE x = 1 AND y = 1"),
    _around("own", "SELECT object_id, start FROM cell WHERE c = 4"),
    _around("entering", "SELECT object_id, start, px AS ox, py AS oy FROM mv WHERE x = 1 AND y = 1"),
    _around("exiting", "SELECT object_id, ps AS start, x AS ox, y AS oy FROM mv WHERE px = 1 AND py = 1"),
]))
