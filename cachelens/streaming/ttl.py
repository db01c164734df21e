"""Time to live as a stateful stream: one entry per key, dropped by an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

STREAM_FIELDS = "key long, event_id long, ts_us long, outcome string"


class TtlProcessor(StatefulProcessor):
    """Classifies each access as hit or miss; an entry ends ``ttl_us`` after the access that loaded it.

    Accesses of a batch are taken in event-time order. The timer only frees state: whether an entry has
    expired is decided by its age, so late timers change no result.
    """

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loaded = handle.getValueState("loaded", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts_us", "event_id"])
        at = self.loaded.get()[0] if self.loaded.exists() else None
        outcomes = []
        for ts in frame["ts_us"].tolist():
            if at is None or ts - at > self.ttl_us:
                at = ts
                outcomes.append("miss")
            else:
                outcomes.append("hit")
        self.loaded.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((at + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame({"key": [int(key[0])] * len(frame), "event_id": frame["event_id"], "ts_us": frame["ts_us"], "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.loaded.clear()
        return iter([])

    def close(self) -> None:
        pass


def ttl_stream(accesses: DataFrame, ttl_us: int, watermark: str = "1 hour") -> DataFrame:
    """The outcomes (STREAM_FIELDS) of a streaming ``accesses`` (key, event_id, ts)."""
    rows = accesses.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(TtlProcessor(ttl_us), STREAM_FIELDS, "append", "eventTime")


def drain_ttl_stream(spark: SparkSession, source: str, ttl_us: int, folder: str, files: str = "events.parquet") -> DataFrame:
    """Runs the stream over the events ``files`` (a name pattern) in ``source`` until they are read, to a parquet sink below ``folder``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(f"{source}/{files}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(source).select(F.col("user_id").alias("key"), "event_id", "ts")
    query = ttl_stream(events, ttl_us).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(STREAM_FIELDS).parquet(f"{folder}/out")
