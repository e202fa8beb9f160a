"""Structured Streaming: resumable shard scan, stateful packing, event-time windows."""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from textloom.session import shared_folder


def read_shards(spark: SparkSession, path: str, schema: str | StructType, files_per_trigger: int = 1) -> DataFrame:
    """An unbounded scan of shards; its offsets make it resumable exactly."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path)


class Packer(StatefulProcessor):
    """Best-fit packing of a stripe's stream. The state holds the items that wait; rows
    leave once the buffer is full, so the placements are the first ones of the batch
    packer fed in the same order; the rest stays in state."""

    def __init__(self, capacity: int, buffer_size: int) -> None:
        self.capacity, self.buffer_size = capacity, buffer_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "id long, length int, arrival long")
        self.counters = handle.getValueState("counters", "arrived long, row long, slot int, pos int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        arrived, row, slot, pos = self.counters.get() if self.counters.exists() else (0, 0, 0, 0)
        buffer = [(int(x[1]), int(x[2]), int(x[0])) for x in self.waiting.get()]
        fresh = sorted((int(i), int(n)) for pdf in rows for i, n in zip(pdf["id"], pdf["length"]) if n > 0)
        buffer.sort()
        out = []
        for i, n in fresh:  # one placement for each arrival once the buffer is full
            insort(buffer, (n, arrived, i))
            arrived += 1
            if len(buffer) < self.buffer_size:
                continue
            left = self.capacity - pos
            k = bisect_left(buffer, (left + 1, -1, -1)) - 1
            if k >= 0:
                length, _, best = buffer.pop(bisect_left(buffer, (buffer[k][0], -1, -1)))
                out.append((key[0], row, slot, pos, best, length, 0))
                pos, slot = pos + length, slot + 1
            else:
                length, _, shortest = buffer.pop(0)
                out.append((key[0], row, slot, pos, shortest, left, length - left))
                pos = self.capacity
            if pos == self.capacity:
                row, slot, pos = row + 1, 0, 0
        self.waiting.put([(i, n, a) for n, a, i in buffer]) if buffer else self.waiting.clear()
        self.counters.update((arrived, row, slot, pos))
        yield pd.DataFrame(out, columns=["stripe", "row", "slot", "start", "id", "taken", "dropped"])

    def close(self) -> None:
        pass


def pack_stream(items: DataFrame, capacity: int, stripes: int, buffer_size: int = 1000) -> DataFrame:
    """Placements of a stream of (id, length); needs the RocksDB state store."""
    keyed = items.select(F.col("id").cast("long").alias("id"), F.col("length").cast("int").alias("length")).withColumn("stripe", F.pmod("id", F.lit(stripes)).cast("long"))
    return keyed.groupBy("stripe").transformWithStateInPandas(statefulProcessor=Packer(capacity, buffer_size), outputStructType="stripe long, row long, slot int, start int, id long, taken int, dropped int", outputMode="Append", timeMode="None")


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time with a zone, watermarked on streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums of tumbling event-time windows by type; works on streams
    and on batches alike."""
    rows = _timed(events, late)
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = _timed(events, late)
    grouped = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def run_once(df: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Drain what is there into an in-memory table (tests, small results)."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def drain(df: DataFrame, complete: bool = False) -> DataFrame:
    """Run a stream over what is there into files of the shared folder and read them:
    rows as they come, or the last result of an aggregation with `complete`."""
    folder = f"{shared_folder(df.sparkSession)}/textloom-stream-{uuid.uuid4().hex}"
    writer = df.writeStream.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True)
    if complete:
        query = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    else:
        query = writer.format("parquet").start(f"{folder}/rows")
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


__all__ = ["Packer", "drain", "event_windows", "pack_stream", "read_shards", "run_once", "sessions"]
