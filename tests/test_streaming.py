"""Replays of sorted micro-batches against the batch operators."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flagframe.operators.state import job_rejections, job_state
from flagframe.plans import tables
from flagframe.streaming.registers import stream_union_flags
from flagframe.streaming.state import start_job_rejections, stream_job_state
from flagframe.streaming.watch import watch_folder

KEY, ORDER = ["user_id", "day"], ["ts", "event_id"]


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Job events in eight files, by event id and so by time."""
    root = tmp_path_factory.mktemp("replay")
    events = tables.job_events(spark, "/root/testdata/sf0.001").select("user_id", "day", "ts", "event_id", "op")
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).cache()
    bounds = events.approxQuantile("event_id", [i / 8 for i in range(9)], 0)
    for i in range(8):
        high = F.col("event_id") <= bounds[i + 1]
        low = F.lit(True) if i == 0 else F.col("event_id") > bounds[i]
        events.where(low & high).coalesce(1).write.mode("append").parquet(str(root / "in"))
    return events, str(root / "in")


def stream_of(spark, events, path):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query):
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


def test_state_stream_equals_batch_and_survives_restart(spark, replay, tmp_path):
    events, path = replay
    seen = {}

    def keep(batch, _id):
        seen.update({(r.user_id, r.day): r["mask"] for r in batch.collect()})

    def run():
        out = stream_job_state(stream_of(spark, events, path), KEY, ORDER)
        return (
            out.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "cp"))
        )

    first = run().trigger(processingTime="0 seconds").start()
    while first.lastProgress is None or first.lastProgress["batchId"] < 1:
        first.awaitTermination(1)
    first.stop()
    finish(run().trigger(availableNow=True).start())
    expected = {(r.user_id, r.day): r["mask"] for r in job_state(events, KEY, ORDER).collect()}
    assert seen == expected


def test_state_stream_ignores_arrival_order(spark, replay, tmp_path):
    events, _ = replay
    shuffled = events.orderBy(F.rand(3)).repartition(4)
    shuffled.write.parquet(str(tmp_path / "in"))
    seen = {}
    out = stream_job_state(stream_of(spark, events, str(tmp_path / "in")), KEY, ORDER)
    query = out.writeStream.outputMode("update").foreachBatch(
        lambda batch, _id: seen.update({(r.user_id, r.day): r["mask"] for r in batch.collect()})
    )
    finish(query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert seen == {(r.user_id, r.day): r["mask"] for r in job_state(events, KEY, ORDER).collect()}


def test_rejections_stream_equals_batch_and_survives_restart(spark, replay, tmp_path):
    events, path = replay
    out = str(tmp_path / "out")
    parts = sorted(Path(path).glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    (tmp_path / "in").mkdir()

    def run(files):
        """A run over what has arrived by then, taken up from the checkpoint."""
        for part in files:
            shutil.copy2(part, tmp_path / "in")
        finish(
            start_job_rejections(
                stream_of(spark, events, str(tmp_path / "in")), ["user_id"], ["event_id"], out, str(tmp_path / "cp"),
                snapshot_every=3, once=True,
            )
        )

    run(parts[:3])
    run(parts[3:])
    got = spark.read.parquet(f"{out}/rows").collect()
    expected = job_rejections(events, ["user_id"], ["event_id"]).collect()
    assert sorted((r.user_id, r.event_id, r.op) for r in got) == sorted((r.user_id, r.event_id, r.op) for r in expected)
    assert {r.batch_id for r in spark.read.parquet(f"{out}/history").collect()} == set(range(8))


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_register_stream_equals_batch(spark, tmp_path, kind):
    options = {
        "tumbling": {"window": "10 minutes"},
        "sliding": {"window": "10 minutes", "slide": "5 minutes"},
        "session": {"window": "3 minutes", "session": True},
    }[kind]
    rng = random.Random(9)
    rows = sorted((rng.randrange(7200), rng.randrange(5), 1 << rng.randrange(6)) for _ in range(300))
    base = spark.createDataFrame(rows, "s bigint, k int, flags int").select(F.timestamp_seconds("s").alias("ts"), "k", "flags")
    for i in range(4):
        part = base.where((F.unix_seconds("ts") >= i * 1800) & (F.unix_seconds("ts") < (i + 1) * 1800))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # A last event far ahead moves the watermark past every window.
    spark.createDataFrame([(100000, 0, 0)], "s bigint, k int, flags int").select(
        F.timestamp_seconds("s").alias("ts"), "k", "flags"
    ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    stream = stream_union_flags(stream_of(spark, base, str(tmp_path / "in")), ["k"], "flags", "ts", "30 minutes", **options)
    query = stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, _id: got.update({(r.window_start, r.window_end, r.k): r.flags for r in batch.collect()})
    )
    finish(query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    batch = stream_union_flags(base, ["k"], "flags", "ts", "30 minutes", **options)
    assert got == {(r.window_start, r.window_end, r.k): r.flags for r in batch.collect()}


def test_late_events_are_dropped(spark, tmp_path):
    # A batch is judged by the watermark of the batch before it, hence the extra event.
    for s in (10, 10000, 10001, 20):
        spark.createDataFrame([(s, 1, 1 if s < 15 else 2)], "s bigint, k int, flags int").select(
            F.timestamp_seconds("s").alias("ts"), "k", "flags"
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in"))
    got = {}
    stream = stream_union_flags(stream_of(spark, schema, str(tmp_path / "in")), ["k"], "flags", "ts", "1 minute", "1 minute")
    query = stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, _id: got.update({r.window_start.minute: r.flags for r in batch.collect()})
    )
    finish(query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert got == {0: 1}


def test_session_with_slide_is_refused(spark):
    df = spark.createDataFrame([(1,)], "flags int").withColumn("ts", F.current_timestamp())
    with pytest.raises(ValueError):
        stream_union_flags(df, [], "flags", "ts", "1 minute", "1 minute", "30 seconds", session=True)


def test_watch_folder(spark, tmp_path):
    def parse(content):
        return None if content.startswith(b"package ") else "no package clause"

    source, alerts = tmp_path / "src", str(tmp_path / "alerts")
    (source / "sub").mkdir(parents=True)
    (source / "a.go").write_text("package a")
    (source / "sub/bad.go").write_text("broken")
    (source / "note.txt").write_text("broken")

    def run():
        finish(watch_folder(spark, str(source), ".go", parse, alerts, str(tmp_path / "cp"), once=True))
        return {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(alerts).collect()}

    assert run() == {"bad.go"}
    (source / "worse.go").write_text("still broken")
    assert run() == {"bad.go", "worse.go"}
    assert spark.read.parquet(alerts).count() == 2
