"""Rejections and sessions on streams, with state per key."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flagframe.operators.state import job_rejections
from flagframe.plans import tables
from flagframe.operators.ordered import chunked
from flagframe.streaming.keyed import STORE, start_keyed_rejections
from flagframe.streaming.registers import stream_union_flags
from flagframe.streaming.sessions import kept_registers, late_rows, session_buckets, session_flags, start_kept_registers


@pytest.fixture(scope="module")
def events(spark):
    found = tables.job_events(spark, "/root/testdata/sf0.001").select("user_id", "ts", "event_id", "op")
    return found.withColumn("ts", F.col("ts").cast("timestamp")).cache()


def written(events, path, files, shuffled):
    """Event files in arrival order: by time, or dealt at random."""
    order = F.xxhash64("event_id") if shuffled else F.col("ts")
    parts = events.select("*", F.ntile(files).over(Window.orderBy(order, "event_id")).alias("n")).cache()
    for i in range(1, files + 1):
        parts.where(F.col("n") == i).drop("n").coalesce(1).write.mode("append").parquet(path)
    parts.unpersist()


def stream_of(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive
    return query.recentProgress


def rows_of(df):
    return sorted((r.user_id, r.event_id, r.op) for r in df.collect())


def test_keyed_rejections_equal_batch_and_survive_restart(spark, events, tmp_path):
    written(events, str(tmp_path / "all"), 6, shuffled=False)
    parts = sorted((tmp_path / "all").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    (tmp_path / "in").mkdir()
    progress = []
    for some in (parts[:2], parts[2:]):
        for part in some:
            shutil.copy2(part, tmp_path / "in")
        source = stream_of(spark, events, str(tmp_path / "in"))
        progress += finish(start_keyed_rejections(source, ["user_id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], once=True))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(job_rejections(events, ["user_id"], ["ts", "event_id"]))
    # what is written to the store is the keys of the batch at most
    for step in progress:
        if step.numInputRows:
            assert sum(s.numRowsUpdated for s in step.stateOperators) <= step.numInputRows
    assert max(s.numRowsTotal for step in progress for s in step.stateOperators) >= events.select("user_id").distinct().count()
    assert "RocksDB" not in spark.conf.get(STORE)


def test_shuffled_stream_equals_batch(spark, events, tmp_path):
    written(events, str(tmp_path / "in"), 5, shuffled=True)
    # a last event far ahead moves the watermark past all others
    far = events.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit("2090-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("cancel").alias("op"))
    far.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream_of(spark, events, str(tmp_path / "in"))
    finish(start_keyed_rejections(source, ["user_id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], watermark="400 days", once=True))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(job_rejections(events, ["user_id"], ["ts", "event_id"]))


def test_buffered_events_wait_for_the_watermark(spark, tmp_path):
    def add(rows):
        df = spark.createDataFrame(rows, "user_id long, s long, event_id long, op string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "op")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return df

    def run(df):
        source = stream_of(spark, df, str(tmp_path / "in"))
        finish(start_keyed_rejections(source, ["user_id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], watermark="10 seconds", once=True))
        return rows_of(spark.read.parquet(str(tmp_path / "out"))) if list(Path(tmp_path / "out").glob("*/*.parquet")) else []

    df = add([(1, 105, 3, "start"), (1, 101, 1, "start"), (2, 103, 2, None)])
    assert run(df) == []
    add([(1, 103, 2, "complete"), (1, 112, 4, "retry")])
    assert run(df) == []
    add([(3, 130, 5, "start")])
    assert run(df) == [(1, 3, "start"), (1, 4, "retry")]


# --- sessions and late rows ------------------------------------------------------------------


def test_sessions_of_one_user_are_many_tasks_work(spark):
    rng = random.Random(7)
    rows = [(1, rng.randrange(400_000), 1 << rng.randrange(6)) for _ in range(3000)] + [(2, 5, 1), (2, 64, 2), (2, 125, 4), (None, 9, 8), (2, 185, 1), (2, 185, 2)]
    base = spark.createDataFrame(rows, "k int, s bigint, flags int").select("k", F.timestamp_seconds("s").alias("ts"), "flags")
    found = session_flags(base, ["k"], "flags", "ts", "1 minute")
    expected = stream_union_flags(base, ["k"], "flags", "ts", "1 minute", "1 minute", session=True)
    columns = ["k", "window_start", "window_end", "flags"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, expected.select(columns).collect()), key=repr)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        buckets = session_buckets(base, ["k"], "flags", "ts", "1 minute")
        assert chunked(buckets, ["k"], ["first"]).where("k = 1").select("_chunk").distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    schema = "s bigint, k int, flags int"
    for rows in ([(10, 1, 1), (70, 1, 2)], [(10_000, 1, 1)], [(20, 1, 4), (9_990, 1, 8), (None, 1, 16)]):
        df = spark.createDataFrame(rows, schema).select(F.timestamp_seconds("s").alias("ts"), "k", "flags")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = stream_of(spark, df, str(tmp_path / "in"))
        finish(start_kept_registers(stream, ["k"], "flags", "ts", "1 minute", "1 minute", str(tmp_path / "out"), str(tmp_path / "cp"), once=True))

    run()
    out = str(tmp_path / "out")
    assert sorted((r.flags, r.batch_id) for r in late_rows(spark, out).collect()) == [(4, 2), (16, 2)]
    assert sorted((r.window_start.timestamp() % 86400 // 60, r.flags) for r in kept_registers(spark, out, ["k"]).collect()) == [(0, 1), (1, 2), (166, 9)]
    progress = {r.batch_id: (r.on_time, r.late) for r in spark.read.parquet(f"{out}/progress").collect()}
    assert progress == {0: (2, 0), 1: (1, 0), 2: (1, 2)}
    df.limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted((r.flags, r.batch_id) for r in late_rows(spark, out).collect()) == [(4, 2), (4, 3), (16, 2)]


def test_waiting_events_lie_in_an_aggregation_and_copies_count(spark, tmp_path):
    rows = [(1, 5, 1, "start")] * 3 + [(1, 7, 2, "complete"), (None, 6, 3, "start"), (None, 6, 3, "start"), (2, 6, 4, None), (-1, 10_000, 9, "cancel")]
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long, op string").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "op")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream_of(spark, df, str(tmp_path / "in"))
    progress = finish(start_keyed_rejections(source, ["user_id"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], watermark="10 seconds", once=True))
    got = [(r.user_id, r.event_id, r.op) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=repr) == [(1, 1, "start"), (1, 1, "start"), (None, 3, "start")]
    # events wait without a call to Python, which meets a key as its events are judged
    assert {s.operatorName for step in progress for s in step.stateOperators} >= {"stateStoreSave"}


def test_keys_share_rows_of_the_store_and_are_told_apart(spark, tmp_path):
    rng = random.Random(11)
    keys = [(None, None), (float("nan"), b"a"), (0.5, b"a"), (0.5, b"b"), *[(float(i), bytes([i])) for i in range(40)]]
    rows = [(*rng.choice(keys), rng.randrange(200), i, rng.choice(["start", "retry", "complete", "cancel", None])) for i in range(900)]
    schema = "a double, b binary, s long, event_id long, op string"
    events = spark.createDataFrame(rows, schema).select("a", "b", F.timestamp_seconds("s").alias("ts"), "event_id", "op").cache()
    progress = []
    for part in ("s < 60", "s BETWEEN 60 AND 119", "s >= 120"):
        events.where(part.replace("s ", "unix_seconds(ts) ", 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream_of(spark, events, str(tmp_path / "in"))
        progress += finish(start_keyed_rejections(source, ["a", "b"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], once=True, buckets=4))

    def named(df):
        return sorted(((r.a, bytes(r.b) if r.b is not None else None, r.event_id, r.op) for r in df.collect()), key=repr)

    assert repr(named(spark.read.parquet(str(tmp_path / "out")))) == repr(named(job_rejections(events, ["a", "b"], ["ts", "event_id"])))
    # the store is called per bucket, however many keys there are
    assert all(s.numRowsTotal <= 4 and s.numRowsUpdated <= 4 for step in progress for s in step.stateOperators)
    events.unpersist()


def test_instants_are_keys_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(3600 * i // 2, i, "start") for i in range(4)], "k long, event_id long, op string")
    df = df.select(F.timestamp_seconds(F.col("k") + 1_792_888_200).alias("k"), F.timestamp_seconds("event_id").alias("ts"), "event_id", "op")
    df = df.union(df.withColumn("event_id", F.col("event_id") + 10))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    finish(start_keyed_rejections(stream_of(spark, df, str(tmp_path / "in")), ["k"], "ts", str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"], once=True, buckets=2))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.k, r.event_id) for r in got.collect()) == sorted((r.k, r.event_id) for r in df.where("event_id >= 10").collect())
