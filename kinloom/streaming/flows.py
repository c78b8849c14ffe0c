"""Micro-batch flows: event-triggered runs, replay-safe delivery, replay, expiring state, cursors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from kinloom.operators.upsert import latest_by


def place(path: str) -> str:
    """A pattern of one place: a plain path to a single file is refused by streams."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def read(spark: SparkSession, path: str, schema: StructType | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, or one file)."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(place(path))


def drain(stream: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """ST1: run ``put`` over every batch that is there, then stop; the checkpoint remembers what was taken."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def put_batches(path: str) -> Callable[[DataFrame, int], None]:
    """ST2: a sink whose folder is named by the batch, so that a batch delivered twice is stored once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def stored(spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str]) -> DataFrame:
    """What the batches at ``path`` come to: the last row of each key."""
    return latest_by(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path), keys, order)


def replay[T](raw: DataFrame, trace_id: str, run: Callable[[DataFrame], T]) -> T:
    """ST3: ``run`` again over the stored raw events of one trace."""
    return run(raw.where(F.col("trace_id") == trace_id))


def first_within(stream: DataFrame, keys: list[str], time: str, lifetime: str) -> DataFrame:
    """ST4: the first event of each key in each stretch of ``lifetime``; the state of a stretch that is over expires.

    Rows: keys, the start of the stretch, and the time of the first event; a later batch may bring an earlier one.
    """
    kept = stream.withWatermark(time, lifetime).groupBy(*keys, F.window(time, lifetime).alias("w"))
    return kept.agg(F.min(time).alias("first_at")).select(*keys, F.col("w.start").alias("since"), "first_at")


class _Live(StatefulProcessor):
    """For each key the time since which it is live, kept until a timer of its own ends it."""

    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([df.iloc[:, -1].to_numpy(np.int64) for df in rows]))
        live = self.since.get()[0] if self.since.exists() else None
        found, at = [], 0
        while at < len(times):
            if live is not None:
                at = max(at, int(np.searchsorted(times, live + self.lifetime)))
                if at == len(times):
                    break
            live = int(times[at])
            found.append(live)
        if found:
            self.since.update((live,))
            self.handle.registerTimer(-(-(live + self.lifetime) // 1000))
            yield pd.DataFrame({"_key": [str(key[0])] * len(found), "_us": found})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A timer of an earlier stretch may come after a later one has begun.
        if self.since.exists() and self.since.get()[0] + self.lifetime <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.since.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def states_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within, streams keep their state in RocksDB, backed up to the checkpoint."""
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_keys(stream: DataFrame, keys: list[str], time: str, lifetime: int, lateness: str) -> DataFrame:
    """ST4: (keys, first_at): the events at which a key is new, with a life of ``lifetime`` seconds for each key.

    A key that is new is live for its lifetime, which later events don't lengthen; its next event after that is new again.
    Batches are taken as they come and an event's batch in order of time: an event from before its key's present life
    isn't new. A timer of the key's own ends its state when the watermark has passed it; events more than ``lateness``
    behind are left out, so none comes that the state would still be needed for. Null times are left out; null keys are a
    key. Run it within states_on_disk(), in append mode. The times that a batch has of one key are sorted in memory, 8
    bytes each: bound a batch by its files.
    """
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, lateness)
    rows = rows.select(F.to_json(F.struct(*keys)).alias("_key"), F.col(time), F.unix_micros(time).alias("_us"))
    found = rows.groupBy("_key").transformWithStateInPandas(_Live(lifetime * 1_000_000), "_key string, _us long", "Append", "EventTime")
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return found.select(F.from_json("_key", kinds).alias("k"), F.timestamp_micros("_us").alias("first_at")).select(*[F.col(f"k.`{k}`").alias(k) for k in keys], "first_at")
