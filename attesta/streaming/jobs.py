"""Structured Streaming: idempotent ingest, and lifecycle status folded from an event stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState

from attesta.functions import columns as fn
from attesta.functions import config as cfg
from attesta.streaming.sink import BucketedSink


def stream_ingest(stream: DataFrame, sink: BucketedSink, checkpoint: str, source: str = "stream", watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Append records whose key the sink has not yet; a replayed record or batch adds nothing.

    A batch goes to the sink under the name of its ``source`` and its number, which a restart repeats with the same rows. With
    a ``watermark`` (column, delay) duplicates within the delay are dropped before.
    """
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(sink.keys)
    write = lambda batch, number: sink.write(batch, f"{source}-{number}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATUS = "key string, event_id long, event_kind string, previous string, accepted boolean"
#: An event as it waits, and the status of a key; both are held as compressed Arrow tables, one for many keys.
EVENT = pa.schema([("key", pa.string()), ("at", pa.int64()), ("place", pa.int32()), ("event_id", pa.int64()), ("event_kind", pa.string())])
REACHED = pa.schema([("key", pa.string()), ("status", pa.string())])
HELD_ROWS = 1 << 18


def _pack(table: pa.Table) -> list[tuple[bytes]]:
    """A table as values of a list state, of a bounded number of rows each."""
    out = []
    for i in range(0, table.num_rows, HELD_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(table.slice(i, HELD_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpack(state: ListState, schema: pa.Schema) -> pa.Table:
    held = list(state.get()) if state.exists() else []
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(bytes(v[0])).read_all() for v in held)])


class Lifecycle(StatefulProcessor):
    """Per bucket of keys the status that each key reached, and events that are not older than the watermark yet, which wait.

    Events that the watermark has passed are judged key by key in order of time, lifecycle place, id and kind, whatever order
    they came in. A timer at the earliest waiting event sees to it that they are judged without a further event of their bucket.
    The step from status to status is a table. State is read and written once per bucket and batch, and not once per key.
    """

    def __init__(self, graph: list[tuple]):
        self.steps = {(a, b): b for a, b in graph}  # no status yet is None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.reached = handle.getListState("reached", "held binary")
        self.waiting = handle.getListState("waiting", "held binary")

    def _judge(self, events: pa.Table, watermark: int) -> Iterator:
        import pandas as pd

        passed = pc.less_equal(events["at"], 1000 * watermark)
        due, late = events.filter(passed), events.filter(pc.invert(passed))
        if due.num_rows:
            due = due.take(pc.sort_indices(due, sort_keys=[(c, "ascending") for c in EVENT.names]))
            reached = _unpack(self.reached, REACHED)
            status = dict(zip(reached["key"].to_pylist(), reached["status"].to_pylist(), strict=True))
            keys, kinds, previous, accepted = due["key"].to_pylist(), due["event_kind"].to_pylist(), [], []
            for key, kind in zip(keys, kinds, strict=True):
                previous.append(status.get(key))
                accepted.append((previous[-1], kind) in self.steps)
                if accepted[-1]:
                    status[key] = self.steps[previous[-1], kind]
            if any(accepted):
                self.reached.put(_pack(pa.table([list(status), list(status.values())], schema=REACHED)))
            texts = {"key": keys, "event_kind": kinds, "previous": previous}
            yield pd.DataFrame({"event_id": due["event_id"].to_numpy(), "accepted": accepted} | {c: pd.Series(v, dtype=object) for c, v in texts.items()})[["key", "event_id", "event_kind", "previous", "accepted"]]
        if late.num_rows:
            self.waiting.put(_pack(late))
            self.handle.registerTimer(pc.min(late["at"]).as_py() // 1000 + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        new = [pa.Table.from_pandas(part[EVENT.names], schema=EVENT, preserve_index=False) for part in rows]
        yield from self._judge(pa.concat_tables([_unpack(self.waiting, EVENT), *new]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._judge(_unpack(self.waiting, EVENT), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_status(events: DataFrame, delay: str = "1 hour", graph: list[tuple] = cfg.GAP_GRAPH, rank: dict[str, int] = cfg.GAP_RANK, buckets: int = 256) -> DataFrame:
    """Events (key, event_id, event_kind, occurred_at) with the verdict of the lifecycle: an accepted one moves the key's
    status, others leave it, and nothing follows a terminal status.

    Events may come out of order by up to ``delay``: each is judged when the watermark has passed it, so stream and batch
    agree. A later event is judged when it comes, against the status reached by then, as a database would at its insert; Spark
    drops those that a batch before had made too late. Rows without time or id are dropped, a null key is a key. Needs the
    RocksDB state store.

    Keys are dealt to ``buckets`` by hash, each a group with one state: a call then costs little per key. A bucket's keys and
    waiting events must fit into a task, so their number should follow the stream; it is fixed for the life of a checkpoint.
    """
    place = fn.lookup("event_kind", {k: float(v) for k, v in rank.items()}, 99.0).cast("int")
    d = events.where("occurred_at is not null and event_id is not null").withWatermark("occurred_at", delay)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    return d.select(bucket, "key", "event_id", "event_kind", "occurred_at", F.unix_micros("occurred_at").alias("at"), place.alias("place")).groupBy("bucket").transformWithStateInPandas(Lifecycle(graph), STATUS, "Append", "EventTime")


def replay(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in order of file time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
