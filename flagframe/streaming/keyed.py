"""Refused job events on streams with the history of each key in the state store.

What decides on the next event of a key is whether it has ended and its last start or retry. Both lie in a
RocksDB state store, nothing is snapshotted by hand, and a restart goes on from the checkpoint. A call of the store
from Python costs far more than judging an event, so keys share a row of the store with those of their hash: a
micro-batch reads and writes the rows of the keys it has and no others, each once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flagframe.operators.state import TERMINAL_BITS
from flagframe.streaming.sinks import start_batches

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = ("start", "retry")
AT, COPIES, BUCKET = "_at", "_copies", "_bucket"
BUCKETS = 1 << 14
# what is known of a key, written as the number of its pair
HISTORIES = [(ended, moved) for ended in (False, True) for moved in (None, *MOVES)]


def refuses(op: str, ended: bool, moved: str | None) -> bool:
    """Whether the guarded machine refuses ``op`` of a key with this history."""
    return (ended and (op in MOVES or op in TERMINAL_BITS)) or (op == "start" and moved == "start")


def _same(value):
    """A hashable form of a key's value, equal where Spark takes values for the same."""
    if isinstance(value, float):
        return "NaN" if value != value else value
    if isinstance(value, (list, tuple)):
        return tuple(map(_same, value))
    return bytes(value) if isinstance(value, bytearray) else value


class _Judge(StatefulProcessor):
    """Sorts the events that a batch brings of the keys of a bucket by time and order and yields those refused."""

    def __init__(self, key: Sequence[T.StructField], order: Sequence[str], op: str):
        self.names = [*[f.name for f in key], AT, *order, op]
        self.columns, self.width = [*self.names, COPIES], len(key)
        lists = [T.StructField(f"key{i}", T.ArrayType(f.dataType)) for i, f in enumerate(key)]
        self.state = T.StructType([*lists, T.StructField("histories", T.StringType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived, places = {}, None  # by key: events as (at, *order, op, copies)
        for row in rows:
            places = places or [row.__fields__.index(c) for c in self.columns]
            values = tuple(row)
            values = tuple([values[i] for i in places])
            if values[-2] is not None:
                arrived.setdefault(_same(values[: self.width]), (values[: self.width], []))[1].append(values[self.width :])
        if not arrived:
            return
        stored = self.history.get()
        known = {}
        if stored:
            *lists, histories = stored
            known = {_same(one): (one, int(n)) for *one, n in zip(*lists, histories)}
        refused, changed = Row(*self.names), False
        for same, (one, events) in arrived.items():
            before = known.get(same)
            ended, moved = HISTORIES[before[1]] if before else HISTORIES[0]
            for event in sorted(events, key=lambda e: [(v is not None, v) for v in e[:-2]]):
                *_, op, copies = event
                for _ in range(copies):
                    if refuses(op, ended, moved):
                        yield refused(*one, *event[:-1])
                    if op in MOVES:
                        moved = op
                    ended = ended or op in TERMINAL_BITS
            now = HISTORIES.index((ended, moved))
            if before is None or before[1] != now:
                known[same], changed = (one, now), True
        if changed:
            lists = [list(column) for column in zip(*[one for one, _ in known.values()])]
            self.history.update((*lists, "".join(str(n) for _, n in known.values())))


def stream_rejections(
    stream: DataFrame,
    key: Sequence[str],
    time: str,
    order: Sequence[str] = (),
    op: str = "op",
    watermark: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The refused events of a stream: key, ``time``, ``order`` columns and ``op``; an append-mode stream.

    Without ``watermark`` events are judged as they arrive, sorted by ``time`` and ``order`` within
    their micro-batch. With it they wait in the state of an aggregation, each with its number of copies, until the
    watermark has reached their time and are then judged in order, so that any order of arrival within the delay gives
    the batch result of ``job_rejections``; later ones are dropped by Spark. Start the
    query with ``with_rocksdb``. A null time is dropped, as it has no place in the order. Keys lie in ``buckets`` rows of
    the store by their hash: a batch reads each row it has keys of once, and writes it where something changed. Take more
    where small batches meet very many keys; a checkpoint keeps its number.
    """
    key, order = list(key), list(order)
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    if watermark is not None:
        timed = timed.withWatermark(time, watermark)
        timed = timed.groupBy(*dict.fromkeys([*key, time, *order, op])).agg(F.count(F.lit(1)).alias(COPIES))
    else:
        timed = timed.withColumn(COPIES, F.lit(1).cast("bigint"))
    rows = timed.select(F.unix_micros(time).alias(AT), *dict.fromkeys([*key, *order, op]), COPIES)
    rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)))
    # instants as numbers: Python's local time gives two of them one name when clocks are set back
    instants = [c for c in key if isinstance(rows.schema[c].dataType, T.TimestampType)]
    for c in instants:
        rows = rows.withColumn(c, F.unix_micros(c))
    result = T.StructType([*[rows.schema[c] for c in key], T.StructField(AT, T.LongType()), *[rows.schema[c] for c in (*order, op)]])
    judge = _Judge([rows.schema[c] for c in key], order, op)
    refused = rows.groupBy(BUCKET).transformWithState(judge, result, "append", "None")
    named = [F.timestamp_micros(c).alias(c) if c in instants else F.col(c) for c in key]
    return refused.select(*named, F.timestamp_micros(AT).alias(time), *order, op)


def with_rocksdb(stream: DataFrame, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state lies in RocksDB; other queries of the session keep their store."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKSDB)
    try:
        return start()  # a query takes the settings that hold when it starts
    finally:
        conf.set(STORE, before)


def start_keyed_rejections(
    stream: DataFrame,
    key: Sequence[str],
    time: str,
    path: str,
    checkpoint: str,
    order: Sequence[str] = (),
    op: str = "op",
    watermark: str | None = None,
    once: bool = False,
    interval: str = "10 seconds",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Write ``stream_rejections`` to ``path``, one partition per micro-batch; a repeated batch replaces its own."""
    refused = stream_rejections(stream, key, time, order, op, watermark, buckets)
    return with_rocksdb(stream, lambda: start_batches(refused, path, checkpoint, "append", once, interval))
