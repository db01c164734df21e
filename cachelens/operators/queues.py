"""Refresh queues of expired entries, and the ways a worker looks for the next one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import SHARDS

#: Shards that sampling looks at, and entries that it sees, for each entry that it wants.
SEEN_EACH = 16


def ring(pushes: DataFrame, size: int, by: str = "shard") -> DataFrame:
    """``pushes`` (``by``, seq, ...) with pushed: a ring of ``size`` places (two at least) per ``by`` takes size - 1, first come first served."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("seq"))
    return pushes.withColumn("pushed", place <= max(2, size) - 1)


def enqueue_touched(touches: DataFrame, size: int) -> DataFrame:
    """(shard, key, seq, queued): the first touch of each expired entry, and whether its shard's ring had a place.

    ``touches`` (shard, key, seq, expired): a touch of a fresh entry queues nothing, and an entry is queued at most once.
    """
    firsts = touches.filter("expired").groupBy("shard", "key").agg(F.min("seq").alias("seq"))
    return ring(firsts, size).withColumnRenamed("pushed", "queued")


def ahead_of(shard: str, start: int) -> Column:
    return F.pmod(F.col(shard) - F.lit(start), F.lit(SHARDS))


def peek_queued(queue: DataFrame, entries: DataFrame, start: int) -> DataFrame:
    """(shard, key, outcome) of the keys that one look through all rings pops, in the order of the shards from ``start`` on.

    ``queue`` (shard, key, seq); ``entries`` (key, expired). One key a shard is popped, until one is there and still
    expired: "taken". Before it, "gone" are keys without an entry and "fresh" those that aren't expired any more.
    """
    heads = queue.groupBy("shard").agg(F.min_by("key", "seq").alias("key"))
    state = F.when(F.col("expired").isNull(), "gone").when(F.col("expired"), "taken").otherwise("fresh")
    looked = heads.join(entries.select("key", "expired"), "key", "left").withColumn("outcome", state).withColumn("ahead", ahead_of("shard", start))
    first = looked.filter("outcome = 'taken'").agg(F.min("ahead").alias("until"))
    return looked.join(F.broadcast(first), F.col("ahead") <= F.coalesce("until", F.lit(SHARDS))).select("shard", "key", "outcome")  # one row


def peek_sampled(entries: DataFrame, start: int, sample: int) -> DataFrame:
    """(key, updated_us): of the expired among the sampled entries the one updated least recently.

    ``entries`` (shard, key, draw, expired, updated_us) are seen shard by shard from ``start`` on, in the order of the
    drawn numbers, until SEEN_EACH * ``sample`` are seen or ``sample`` expired ones are found.
    """
    most = SEEN_EACH * sample
    # No more than ``most`` of any shard can be seen, so the rest needn't come along.
    near = entries.withColumn("ahead", ahead_of("shard", start)).filter(F.col("ahead") < most)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("draw", "key"))).filter(F.col("place") <= most)
    before = Window.orderBy("ahead", "draw", "key").rowsBetween(Window.unboundedPreceding, -1)  # of at most ``most`` ** 2 rows
    seen = near.withColumn("seen", F.count("*").over(before)).withColumn("found", F.coalesce(F.sum(F.col("expired").cast("int")).over(before), F.lit(0)))
    looked = seen.filter((F.col("seen") < most) & (F.col("found") < sample) & F.col("expired"))
    return looked.agg(F.min_by(F.struct("key", "updated_us"), F.struct("updated_us", "seen")).alias("v")).filter("v IS NOT NULL").select("v.*")


def walk(entries: DataFrame, order: Column, stop: Column, shards: int = SHARDS) -> DataFrame:
    """The entries that a scan of the first ``shards`` shards calls back for: in each shard by ``order`` up to the first that says stop."""
    marked = entries.filter(F.col("shard") < shards).withColumn("walked", order).withColumn("says_stop", F.coalesce(stop, F.lit(False)))
    last = marked.filter("says_stop").groupBy(F.col("shard").alias("in_shard")).agg(F.min("walked").alias("last"))
    kept = marked.join(last, F.col("shard") == F.col("in_shard"), "left").filter("last IS NULL OR walked <= last")
    return kept.select(*entries.columns)


def lookup_identity(log: DataFrame, slots: int) -> DataFrame:
    """``log`` (key, seq, identity, key_hash) with slot, outcome and owner of a table that knows ``slots`` hashes only.

    A slot belongs to its first key for good. Another key with the same hash is told apart by its identity: its access is
    a "collision", which computes the value again and leaves it under the owner's identity.
    """
    placed = log.withColumn("slot", F.col("key_hash").bitwiseAND(F.lit(slots - 1)))
    owners = placed.groupBy(F.col("slot").alias("of_slot")).agg(F.min(F.struct("seq", "identity", "key")).alias("first"))
    own = F.col("identity") == F.col("first.identity")
    outcome = F.when(~own, "collision").when(F.col("seq") == F.col("first.seq"), "miss").otherwise("hit")
    return placed.join(owners, F.col("slot") == F.col("of_slot")).withColumn("outcome", outcome).withColumn("owner", F.col("first.key")).drop("of_slot", "first")


def write_decisions(writes: DataFrame) -> DataFrame:
    """``writes`` (key, seq, payload, weight) with decision, len_delta, mem_delta: "insert", "touch" for an equal payload, "update".

    The table without admission and limits; a hot key's writes are one window.
    """
    own = Window.partitionBy("key").orderBy("seq")
    before = F.lag(F.struct("payload", "weight")).over(own)
    rows = writes.withColumn("before", before)
    same = F.col("before.payload").eqNullSafe(F.col("payload"))
    decision = F.when(F.col("before").isNull(), "insert").when(same, "touch").otherwise("update")
    rows = rows.withColumn("decision", decision)
    mem = F.when(F.col("decision") == "insert", F.col("weight")).when(F.col("decision") == "touch", F.lit(0)).otherwise(F.col("weight") - F.col("before.weight"))
    return rows.withColumn("len_delta", (F.col("decision") == "insert").cast("int")).withColumn("mem_delta", mem.cast("long")).drop("before")
