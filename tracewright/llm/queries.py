"""One query for each operator of this subpackage, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fim, hardneg, linedups, minhash, mixing, ngram, quality, sharding, suffixes, tokens, toxicity
from .shared import read_table, shared_dir


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # the checksum and the size are all that shards need: texts don't travel
    out = sharding.shard_contiguous(docs.select("doc_id", "text"), 16, keep=["doc_id"])
    return out.select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_linedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers as text, for the comparison of results by value
    out = linedups.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(read_table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tracewright/{spark.sparkContext.applicationId}/blocks-{uuid.uuid4().hex}"
    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text()
    tokens.write_blocks(read_table(spark, sf_dir, "documents"), path, tokenizer, 2)
    return tokens.read_blocks(spark, path)


def op5_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = ngram.train(docs.filter(~held_out), order=3)
    return ngram.score(docs.withColumn("held_out", held_out), model)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.ranked(mixing.place(read_table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "source", "size", "block", "release", "due", "slot", "position")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80).drop("th")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), near=10).drop("th")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = read_table(spark, sf_dir, "labels").filter(~held_out)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_linedups": op2_linedups,
    "op3_quality": op3_quality,
    "op4_tokens": op4_tokens,
    "op5_ngram": op5_ngram,
    "op6_mixing": op6_mixing,
    "op7_minhash": op7_minhash,
    "op8_decontam": op8_decontam,
    "op9_chat": op9_chat,
    "op10_toxicity": op10_toxicity,
    "op11_fim": op11_fim,
    "op12_hardneg": op12_hardneg,
    "op13_suffixes": op13_suffixes,
}

_ESC = "replace({}, chr(92), chr(92) || chr(92))"
for _c in chat.CONTROL:
    _ESC = f"replace({_ESC}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"
_OPEN = {r: len(a) for r, a, _ in chat.MARKS}
_BOTH = {r: len(a) + len(b) for r, a, b in chat.MARKS}

_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"

ORACLES: dict[str, str] = {
    "op2_linedups": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM d),
sets AS (
  SELECT doc_id, i, list_sort(list_distinct(list_filter(regexp_split_to_array(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> ''))) AS s FROM lines),
places AS (SELECT * FROM sets WHERE len(s) > 0),
classes AS (SELECT s, min((doc_id, i)) AS f, row_number() OVER () AS c, len(s) AS n FROM places GROUP BY s),
words AS (SELECT c, f, n, unnest(s) AS w FROM classes),
freq AS (SELECT w, count(*) AS k FROM words GROUP BY w),
ranked AS (SELECT c, f, n, w, row_number() OVER (PARTITION BY c ORDER BY k, w) AS p FROM words JOIN freq USING (w)),
pre AS (SELECT * FROM ranked WHERE p <= n - ceil(n * 80 / 100) + 1),
cand AS (SELECT DISTINCT a.c AS x, b.c AS y FROM pre a JOIN pre b USING (w) WHERE a.f < b.f AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
gone AS (
  SELECT DISTINCT y AS c FROM cand JOIN classes a ON a.c = x JOIN classes b ON b.c = y
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
out AS (SELECT p.doc_id, p.i, (p.doc_id, p.i) <> k.f OR k.c IN (FROM gone) AS gone FROM places p JOIN classes k USING (s))
SELECT d.doc_id, count(out.i)::BIGINT AS n_lines, coalesce(sum(gone::INT), 0)::BIGINT AS n_removed,
  coalesce(string_agg(out.i::VARCHAR, ',' ORDER BY out.i) FILTER (gone), '') AS removed
FROM d LEFT JOIN out USING (doc_id) GROUP BY d.doc_id""",
    "op3_quality": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w FROM d),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (
  SELECT r, i, string_agg(word, ' ') OVER v AS g, count(*) OVER v AS n FROM words
  WINDOW v AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE n = 8) WHERE c > 1),
rep AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY r),
lines AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT *, trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')) AS norm FROM lines WHERE regexp_replace(line, '{_SPACE}', '', 'g') <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM full_lines GROUP BY r),
frequent AS (SELECT host, norm FROM full_lines GROUP BY host, norm HAVING count(DISTINCT text) > 20),
gone AS (SELECT r, sum(len(string_split(norm, ' '))) AS removed_words FROM full_lines SEMI JOIN frequent USING (host, norm) GROUP BY r),
base AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept
FROM base""",
    "op7_minhash": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM sets JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)""",
    "op8_decontam": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_TERMS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, sizes WHERE len(w) >= k),
hits AS (SELECT r, s, places.k, item_id FROM places JOIN win ON places.k = win.k AND array_to_string(w[s:s + places.k - 1], ' ') = g),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + k - 1)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS i FROM hits GROUP BY r),
held AS (SELECT DISTINCT item_id, w AS x, unnest(w) AS t FROM b),
post AS (SELECT * FROM (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d) SEMI JOIN held USING (t)),
rarity AS (
  SELECT item_id, x, t, row_number() OVER (PARTITION BY item_id, x ORDER BY coalesce(n, 0), t) AS k
  FROM held LEFT JOIN (SELECT t, count(*) AS n FROM post GROUP BY t) USING (t)),
near AS (
  SELECT u.r, count(DISTINCT y.item_id) AS n_near FROM rarity y JOIN rarity z ON z.item_id = y.item_id AND z.x = y.x AND y.k = 1 AND z.k = 2
  JOIN post u ON u.t = y.t JOIN post v ON v.t = z.t AND v.r = u.r AND abs(u.p - v.p) <= 10 GROUP BY u.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(i), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)""",
    "op9_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length({_ESC.format('text')}) AS body,
    CASE role WHEN 'system' THEN {_BOTH['system']} WHEN 'user' THEN {_BOTH['user']} WHEN 'assistant' THEN {_BOTH['assistant']}
      ELSE {sum(map(len, chat.OTHER))} + length({_ESC.format('role')}) END AS marks FROM rows),
placed AS (
  SELECT *, coalesce(sum((body + 3) // 4 + 4) OVER w, 0) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, before // 512 AS k, n = 1 AND role = 'system' AS sys, (before // 512 + 1) * 512 - before <= 128 AS again FROM placed),
own AS (SELECT DISTINCT conv_id, k FROM cut),
chars AS (
  SELECT conv_id, sum(c) AS c FROM (
    SELECT conv_id, body + marks AS c FROM cut
    UNION ALL SELECT c.conv_id, body + marks FROM cut c JOIN own o ON o.conv_id = c.conv_id AND o.k = c.k + 1 WHERE again AND NOT sys
    UNION ALL SELECT c.conv_id, body + marks FROM cut c JOIN own o ON o.conv_id = c.conv_id AND o.k > 0 WHERE sys) GROUP BY conv_id)
SELECT p.conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(chars.c)::BIGINT AS formatted_chars
FROM placed p JOIN chars USING (conv_id) GROUP BY p.conv_id""",
    "op11_fim": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    ('0x' || h[17:24])::BIGINT % 100 AS r, ('0x' || h[25:32])::BIGINT % 100 AS q FROM d),
y AS (
  SELECT doc_id, t, n, length(coalesce(array_to_string(u[1:least(a, b)], ''), '')) AS p, length(coalesce(array_to_string(u[1:greatest(a, b)], ''), '')) AS e,
    CASE WHEN n = 0 OR r >= 90 OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM x)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN e - p END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, p) || '<S>' || substr(t, e + 1) || '<M>' || substr(t, p + 1, e - p)
    ELSE '<S>' || substr(t, e + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, e - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM y""",
    "op12_hardneg": """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, anchor_id, br AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id) <= 5""",
    # texts as hexadecimal digits, two for a byte
    "op13_suffixes": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 100)) AS p FROM d)),
late AS (SELECT r, p FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY r, p) > 1),
fresh AS (SELECT r, p, coalesce(p > 100 + lag(p) OVER (PARTITION BY r ORDER BY p), true) AS f FROM late),
runs AS (SELECT r, min(p) AS a, max(p) + 100 AS b FROM (SELECT r, p, sum(f::INT) OVER (PARTITION BY r ORDER BY p) AS k FROM fresh) GROUP BY r, k),
cuts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x FROM runs),
kept AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * x + 1, 2 * (a - x)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cuts JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
}
