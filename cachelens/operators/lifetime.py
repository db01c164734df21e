"""Time to live: folds over each key's accesses and rate-limited refresh picks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOLD_FIELDS = "key long, event_id long, ts_us long, outcome string"


def ttl_fold(log: DataFrame, ttl_us: int, serve_stale: bool = False) -> DataFrame:
    """(key, event_id, ts_us, outcome) of every access under removal at expiry.

    An entry's age counts from the access that loaded it; hits don't renew it. "miss" if there is none or, with
    eager removal, it is older than ``ttl_us``. With ``serve_stale`` (no worker ran yet) an old entry gives
    "stale_hit" and stays. Rows are dealt by key and folded in order with one key's state at a time.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = None, 0
        for rows in batches:
            out = []
            for k, ts in zip(rows["key"].tolist(), rows["ts_us"].tolist()):
                if k != key:
                    key, anchor = k, ts
                    out.append("miss")
                elif ttl_us and ts - anchor > ttl_us:
                    out.append("stale_hit" if serve_stale else "miss")
                    anchor = anchor if serve_stale else ts
                else:
                    out.append("hit")
            yield rows[["key", "event_id", "ts_us"]].assign(outcome=out)

    return log.select("key", "event_id", "ts_us").repartition("key").sortWithinPartitions("key", "ts_us", "event_id").mapInPandas(fold, FOLD_FIELDS)


def refresh_picks(due: DataFrame, rate: int) -> DataFrame:
    """``due`` (key, due_us, updated_us) limited to ``rate`` a second, the longest not updated first, with place."""
    second = F.floor(F.col("due_us") / 1_000_000)
    place = F.row_number().over(Window.partitionBy("second").orderBy("updated_us", "key"))
    return due.withColumn("second", second).withColumn("place", place).filter(F.col("place") <= rate)


def expired_first(entries: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` expired entries (key, expired, is_queued, updated_us) that a worker takes first: queued ones, then the oldest."""
    return entries.filter("expired").orderBy(F.desc("is_queued"), "updated_us", "key").limit(limit)


def oldest_expired(entries: DataFrame) -> DataFrame:
    """(shard, key, expired): per shard its expired entries' number and the key that was updated least recently."""
    return entries.filter("expired").groupBy("shard").agg(F.min_by("key", F.struct("updated_us", "key")).alias("key"), F.count("*").alias("expired"))
