"""Directly-follows pairs over a stream: events that come late still find their place."""

import datetime as dt

from pyspark.sql import functions as F

from tracewright.streaming.follows import follow_counts, follow_stream


def test_pairs_follow_event_time(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[("a", "open", t(0), 1), ("a", "pay", t(30), 3), ("b", "open", t(5), 4)], [("a", "add", t(20), 2), ("b", "pay", t(40), 5)], [("z", "tick", t(600), 6)], [("z", "tick", t(1200), 7)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "object_id string, event_type string, ts timestamp, event_seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = follow_stream(events, "1 hour").writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(150)
    got = {tuple(r) for r in spark.table("pairs").select("object_id", "source", "target").filter("object_id <> 'z'").collect()}
    assert got == {("a", "START", "open"), ("a", "open", "add"), ("a", "add", "pay"), ("b", "START", "open"), ("b", "open", "pay")}
    counts = follow_counts(spark.table("pairs")).filter(F.col("target") == "open").collect()
    assert [r["weight"] for r in counts] == [2]


def run(spark, folder, name, **how):
    schema = "object_id string, event_type string, ts timestamp, event_seq long"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = follow_stream(events, "1 hour", **how).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-check").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return [tuple(r) for r in spark.read.schema("object_id string, source string, target string, ts timestamp").parquet(f"{folder}/{name}").orderBy("object_id", "ts", "source").select("object_id", "source", "target").collect()]


def put(spark, folder, i, rows):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(o, e, t(m), s) for o, e, m, s in rows], "object_id string, event_type string, ts timestamp, event_seq long").coalesce(1).write.parquet(f"{folder}/in/{i}")


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", "one", 0, 1), ("a", "two", 10, 2)])
    put(spark, tmp_path, 1, [("z", "tick", 600, 3)])
    put(spark, tmp_path, 2, [("a", "too late", 5, 4), ("a", "five", 650, 7), ("a", "four", 650, 6), ("a", "three", 650, 5)])  # one time, in the order of numbers
    first = [r for r in run(spark, tmp_path, "out") if r[0] == "a"]
    assert first == [("a", "START", "one"), ("a", "one", "two")]
    put(spark, tmp_path, 3, [("z", "tick", 1200, 8)])
    put(spark, tmp_path, 4, [("z", "tick", 1800, 9)])
    assert sorted(r for r in run(spark, tmp_path, "out") if r[0] == "a") == sorted([*first, ("a", "two", "three"), ("a", "three", "four"), ("a", "four", "five")])


def test_an_idle_object_starts_anew(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", "one", 0, 1), ("b", "one", 0, 2), ("b", "two", 100, 3)])
    put(spark, tmp_path, 1, [("z", "tick", 600, 4)])
    put(spark, tmp_path, 2, [("z", "tick", 900, 5), ("a", "two", 880, 6)])
    put(spark, tmp_path, 3, [("z", "tick", 1500, 7)])
    got = [r for r in run(spark, tmp_path, "idle", idle_ms=2 * 3_600_000) if r[0] != "z"]
    assert sorted(got) == [("a", "START", "one"), ("a", "START", "two"), ("b", "START", "one"), ("b", "one", "two")]
