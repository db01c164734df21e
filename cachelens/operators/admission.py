"""Admission sketches over whole access streams in closed form: doorkeeper, 4-bit counters, aging, decisions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AdmissionConfig
from ..functions.keys import mix64_words
from .ranks import running


def places(h: Column, count: int, size: int) -> Column:
    """The ``count`` positions of a hash: h, mix(h), mix(mix(h)), ... in a table of ``size``.

    Only distinct keys are mixed, in Arrow batches: as native expressions the nested steps take seconds to plan.
    """

    @F.pandas_udf("array<long>")
    def mixed(hashes: pd.Series) -> pd.Series:
        chain = [hashes.to_numpy(np.int64).view(np.uint64)]
        for _ in range(count - 1):
            chain.append(mix64_words(chain[-1]))
        return pd.Series(list(np.stack([(c & np.uint64(size - 1)).astype(np.int64) for c in chain], 1)))

    return mixed(h)


@dataclass
class Sketch:
    """What is left of a log once it is counted: bits (shard, bit), table (shard, idx, counter), adds (shard, adds)."""

    bits: DataFrame
    table: DataFrame
    adds: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Sketch:
        return Sketch(*(spark.createDataFrame([], f) for f in ("shard int, bit long", "shard int, idx long, counter int", "shard int, adds long")))


def doorkeeper(log: DataFrame, cfg: AdmissionConfig, before: Sketch | None = None) -> DataFrame:
    """``log`` (key_hash, seq) with shard and seen: whether all 3 bits had been set before.

    A bit is set from the first access on that maps to it, so an access is seen iff each of its bits has an
    earlier access, or was set in ``before``.
    """
    keys = log.select("key_hash").distinct().withColumn("bits", F.array_distinct(places(F.col("key_hash"), 3, cfg.door_len)))
    shard = F.col("key_hash").bitwiseAND(F.lit(cfg.shards - 1)).cast("int")
    firsts = log.groupBy("key_hash").agg(F.min("seq").alias("first")).join(keys, "key_hash").select(shard.alias("shard"), F.explode("bits").alias("bit"), "first")
    firsts = firsts.groupBy("shard", "bit").agg(F.min("first").alias("first"))
    own = keys.select("key_hash", shard.alias("shard"), F.explode("bits").alias("bit"))
    if before is not None:
        own = own.join(before.bits, ["shard", "bit"], "left_anti")
    known = own.join(firsts, ["shard", "bit"]).groupBy("key_hash").agg(F.max("first").alias("all_set"))
    return log.join(known, "key_hash", "left").withColumn("shard", shard).withColumn("seen", F.coalesce(F.col("all_set") < F.col("seq"), F.lit(True))).drop("all_set")


def increments(log: DataFrame, cfg: AdmissionConfig, bucket: Column | None = None, before: Sketch | None = None) -> DataFrame:
    """(shard, idx, epoch, n): counter increments of the seen accesses by aging epoch.

    ``bucket`` never falls as seq grows; with it an access's ordinal is counted within its bucket and added to those before.
    """
    seen = running(doorkeeper(log, cfg, before).filter("seen"), ["shard"], F.lit(0) if bucket is None else bucket, ["seq"], {"ordinal": F.lit(1)})
    if before is not None:  # one row a shard
        seen = seen.join(F.broadcast(before.adds), "shard", "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("adds", F.lit(0)))
    seen = seen.withColumn("epoch", F.floor(F.col("ordinal") / F.lit(cfg.reset_at)).cast("int"))
    counted = seen.groupBy("shard", "key_hash", "epoch").agg(F.count("*").alias("n"))  # before the explode
    keys = counted.select("key_hash").distinct().withColumn("idx", places(F.col("key_hash"), 4, cfg.table_len))
    return counted.join(keys, "key_hash").select("shard", F.explode("idx").alias("idx"), "epoch", "n").groupBy("shard", "idx", "epoch").agg(F.sum("n").alias("n"))


def counters(log: DataFrame, cfg: AdmissionConfig, aging: bool = True, bucket: Column | None = None, before: Sketch | None = None) -> DataFrame:
    """(shard, idx, counter) after the whole log: saturating at 15, halved between epochs.

    Without ``aging`` nothing is halved. Epochs without an increment still halve: a gap is a shift.
    """
    rows = increments(log, cfg, bucket, before)
    if not aging:
        return rows.groupBy("shard", "idx").agg(F.least(F.lit(15), F.sum("n")).cast("int").alias("counter"))
    last = rows.groupBy("shard").agg(F.max("epoch").alias("last"))
    steps = rows.groupBy("shard", "idx").agg(F.array_sort(F.collect_list(F.struct("epoch", "n"))).alias("steps"))
    if before is not None:
        steps = steps.join(before.table, ["shard", "idx"], "full").withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<epoch:int,n:bigint>>")))
    else:
        steps = steps.withColumn("counter", F.lit(0))
    steps = steps.join(last, "shard", "left").withColumn("last", F.coalesce("last", F.lit(0)))

    def halved(c: Column, times: Column) -> Column:
        return F.floor(c / F.pow(F.lit(2.0), F.least(times, F.lit(5)))).cast("long")

    start = F.struct(F.coalesce("counter", F.lit(0)).cast("long").alias("c"), F.lit(0).alias("epoch"))
    end = F.aggregate("steps", start, lambda s, x: F.struct(F.least(F.lit(15).cast("long"), halved(s["c"], x["epoch"] - s["epoch"]) + x["n"]).alias("c"), x["epoch"].alias("epoch")))
    return steps.withColumn("end", end).select("shard", "idx", halved(F.col("end.c"), F.col("last") - F.col("end.epoch")).cast("int").alias("counter"))


def estimates(keys: DataFrame, table: DataFrame, cfg: AdmissionConfig) -> DataFrame:
    """(key_hash, estimate): the least of a key's 4 counters, 0 for one that was never raised."""
    shard = F.col("key_hash").bitwiseAND(F.lit(cfg.shards - 1)).cast("int")
    at = keys.select("key_hash").distinct().select("key_hash", shard.alias("shard"), F.explode(places(F.col("key_hash"), 4, cfg.table_len)).alias("idx"))
    return at.join(table, ["shard", "idx"], "left").groupBy("key_hash").agg(F.min(F.coalesce("counter", F.lit(0))).alias("estimate"))


def reset(table: DataFrame) -> DataFrame:
    """``table`` (shard, idx, counter) after a reset: counters halved, those at 0 gone. The doorkeeper's bits are dropped with it."""
    return table.withColumn("counter", F.floor(F.col("counter") / 2).cast("int")).filter("counter > 0")


def bits_of(log: DataFrame, cfg: AdmissionConfig) -> DataFrame:
    """(shard, bit) of all bits that a log sets."""
    shard = F.col("key_hash").bitwiseAND(F.lit(cfg.shards - 1)).cast("int")
    return log.select("key_hash").distinct().select(shard.alias("shard"), F.explode(places(F.col("key_hash"), 3, cfg.door_len)).alias("bit")).distinct()


def advanced(log: DataFrame, before: Sketch, cfg: AdmissionConfig) -> Sketch:
    """``before`` after a further ``log`` (key_hash, seq), so that counted accesses needn't be kept."""
    seen = doorkeeper(log, cfg, before).filter("seen").groupBy("shard").agg(F.count("*").alias("n"))
    total = F.coalesce("adds", F.lit(0)) + F.coalesce("n", F.lit(0))
    adds = before.adds.join(seen, "shard", "full").select("shard", (total - F.floor(F.greatest(total - 1, F.lit(0)) / cfg.reset_at) * cfg.reset_at).cast("long").alias("adds"))
    return Sketch(before.bits.unionByName(bits_of(log, cfg)).distinct(), counters(log, cfg, before=before), adds)


def allow(pairs: DataFrame, log: DataFrame, cfg: AdmissionConfig, bucket: Column | None = None) -> DataFrame:
    """``pairs`` (candidate, victim) with candidate_freq, victim_freq and allow, after the whole log; see allow_by."""
    return allow_by(pairs, counters(log, cfg, bucket=bucket), bits_of(log, cfg), cfg)


def allow_by(pairs: DataFrame, table: DataFrame, set_bits: DataFrame, cfg: AdmissionConfig) -> DataFrame:
    """``pairs`` (candidate, victim) with candidate_freq, victim_freq and allow.

    A key is allowed against itself; an unseen candidate never; else it has to be more frequent.
    """
    both = pairs.select(F.col("candidate").alias("key_hash")).union(pairs.select("victim")).distinct()
    freq = estimates(both, table, cfg)
    shard = F.col("key_hash").bitwiseAND(F.lit(cfg.shards - 1)).cast("int")
    bits = both.select("key_hash", shard.alias("shard"), F.explode(F.array_distinct(places(F.col("key_hash"), 3, cfg.door_len))).alias("bit"))
    unseen = bits.join(set_bits, ["shard", "bit"], "left_anti").select("key_hash").distinct().withColumn("unseen", F.lit(True))
    out = pairs.join(freq.select(F.col("key_hash").alias("candidate"), F.col("estimate").alias("candidate_freq")), "candidate").join(freq.select(F.col("key_hash").alias("victim"), F.col("estimate").alias("victim_freq")), "victim")
    out = out.join(unseen.withColumnRenamed("key_hash", "candidate"), "candidate", "left")
    verdict = F.when(F.col("candidate") == F.col("victim"), True).when(F.col("unseen"), False).otherwise(F.col("candidate_freq") > F.col("victim_freq"))
    return out.withColumn("allow", verdict).drop("unseen")
