"""What the background workers do over time, in closed form: paced requests, eviction ticks, expiry at a rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running, running_max

#: Time by which running sums are cut.
BUCKET_US = 3_600_000_000
#: Bytes by which running sums over weights are cut.
BUCKET_BYTES = 1 << 26


def tokens_buffer(rate: int) -> int:
    """Tokens that a limiter keeps ready: a tenth of its rate, one at least."""
    return max(1, int(rate * 0.1))


def paced(requests: DataFrame, rate: int, by: list[str] | None = None) -> DataFrame:
    """``requests`` (at_us, id, ...) with served_us: one at a time per ``by``, at least 1 / ``rate`` seconds apart.

    Request i is served at the largest of at_j + (i - j) / rate for all j up to i, which is a running maximum. The
    order is (at_us, id).
    """
    by, gap = by or [], 1_000_000 // rate
    bucket = F.floor(F.col("at_us") / BUCKET_US)
    numbered = running(requests, by, bucket, ["at_us", "id"], {"place": F.lit(1)})
    topped = running_max(numbered, by, bucket, ["at_us", "id"], "top", F.col("at_us") - F.col("place") * gap)
    return topped.withColumn("served_us", F.col("top") + F.col("place") * gap).drop("top", "place")


def evictor_ticks(inserts: DataFrame, soft_limit: int, every_us: int) -> DataFrame:
    """(tick, scans, hits, items, bytes) of every tick at which something was inserted since the one before.

    ``inserts`` (at_us, id, weight) are new entries in the order (at_us, id). A tick comes every ``every_us``. It scans if
    there are entries, hits if they weigh more than ``soft_limit``, and evicts the oldest until they don't. With oldest
    first, an entry goes at the first tick at which more than ``soft_limit`` was inserted from it on, so no step
    waits for the one before. Ticks without inserts scan and never hit; they are left out.
    """
    ticked = inserts.withColumn("tick", F.floor(F.col("at_us") / every_us) + 1)
    before = running(ticked, [], F.floor(F.col("at_us") / BUCKET_US), ["at_us", "id"], {"before": F.col("weight")})
    upto = before.groupBy("tick").agg(F.max(F.col("before") + F.col("weight")).alias("upto"))
    # Sums rise from tick to tick. In one order of levels from above, the tick seen last before an entry is the first
    # one whose sum is over the entry's level; a tick whose sum equals the level sorts behind the entry.
    entries = before.select((F.col("before") + soft_limit).alias("level"), "weight", F.lit(None).cast("long").alias("ends"), F.lit(0).alias("turn"))
    levels = entries.unionByName(upto.select(F.col("upto").alias("level"), F.lit(None).cast("long").alias("weight"), F.col("tick").alias("ends"), F.lit(1).alias("turn")))
    seen = running_max(levels, [], -F.floor(F.col("level") / BUCKET_BYTES), [F.desc("level"), "turn"], "last", -F.col("ends"))
    evicted = seen.filter("turn = 0 AND last IS NOT NULL").groupBy((-F.col("last")).alias("at_tick")).agg(F.count("*").alias("items"), F.sum("weight").alias("bytes"))
    out = upto.join(evicted, F.col("tick") == F.col("at_tick"), "left")
    return out.select("tick", F.lit(1).alias("scans"), F.col("items").isNotNull().cast("int").alias("hits"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def lifetimer_ticks(entries: DataFrame, ttl_us: int, rate: int, every_us: int) -> DataFrame:
    """(tick, scans, hits, misses, affected) of a worker that removes expired entries at ``rate`` a second.

    ``entries`` (key, updated_us): each is due from updated_us + ttl_us on, the longest not updated first, and is taken
    by one token. A tick sums ``every_us``; one in which nothing is removed is left out. scans: the tick's tokens.
    """
    due = entries.select(F.col("key").alias("id"), (F.col("updated_us") + ttl_us + 1).alias("at_us"))
    served = paced(due, rate).withColumn("tick", F.floor(F.col("served_us") / every_us))
    tokens = every_us * rate // 1_000_000
    rows = served.groupBy("tick").agg(F.count("*").alias("hits"))
    return rows.select("tick", F.lit(tokens).cast("long").alias("scans"), "hits", (F.lit(tokens) - F.col("hits")).cast("long").alias("misses"), F.col("hits").alias("affected"))
