"""Keyed storage over access logs: lookups, upserts, deletes, recency and eviction as joins and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import SHARDS, key_hash
from ..sources.tables import written
from .ranks import running


def classify_hits(log: DataFrame) -> DataFrame:
    """``log`` (key, seq, ...) with outcome: "miss" for a key's first access, else "hit"; the cache is unbounded.

    seq is unique. The first accesses are joined on key and seq, so a hot key's rows spread over all tasks.
    """
    firsts = log.groupBy(F.col("key").alias("first_key")).agg(F.min("seq").alias("first_seq"))
    same = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("seq") == F.col("first_seq"))
    return log.join(firsts, same, "left").withColumn("outcome", F.when(F.col("first_seq").isNotNull(), "miss").otherwise("hit")).drop("first_key", "first_seq")


def get_or_compute(requests: DataFrame, entries: DataFrame, loader: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, loaded): entries for known keys, and the loader's rows for the others, loaded once per key.

    ``requests`` (key, ...), ``entries`` (key, payload); ``loader`` takes the missing distinct keys (key) and
    returns (key, payload), or a null payload for a failure, which is answered but not kept in ``loaded``.
    """
    missing = requests.select("key").distinct().join(entries.select("key"), "key", "left_anti")
    loaded = loader(missing)
    hits = requests.join(entries.select("key", "payload"), "key").withColumn("outcome", F.lit("hit"))
    misses = requests.join(loaded.select("key", "payload"), "key").withColumn("outcome", F.when(F.col("payload").isNull(), "miss_error").otherwise("miss_admitted"))
    return hits.unionByName(misses), loaded.filter("payload IS NOT NULL")


def delete_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key"), "key", "left_anti")


def shard_stats(entries: DataFrame) -> DataFrame:
    """(shard, len, mem)"""
    return entries.groupBy("shard").agg(F.count("*").alias("len"), F.sum("weight").alias("mem"))


def last_wins(writes: DataFrame, value: str) -> DataFrame:
    """(key, value) of each key's last write by seq, with partial aggregation and no sort."""
    return writes.groupBy("key").agg(F.max_by(value, "seq").alias(value))


def write_deltas(writes: DataFrame) -> DataFrame:
    """``writes`` with len_delta and bytes_delta: (1, weight) for an insert, (0, change) for a replacement."""
    before = F.lag("weight").over(Window.partitionBy("key").orderBy("seq"))
    return writes.withColumn("before", before).withColumn("len_delta", F.when(F.col("before").isNull(), 1).otherwise(0)).withColumn("bytes_delta", F.col("weight") - F.coalesce("before", F.lit(0))).drop("before")


def recency(log: DataFrame) -> DataFrame:
    """(key, touched): each key's last access."""
    return log.groupBy("key").agg(F.max("seq").alias("touched"))


def lru_rank(entries: DataFrame) -> DataFrame:
    """``entries`` (key, shard, touched) with lru_rank, 1 for the least recent of its shard; ties by key."""
    return entries.withColumn("lru_rank", F.row_number().over(Window.partitionBy("shard").orderBy("touched", "key")))


def peek(entries: DataFrame, k: int = 1, most_recent: bool = False, where: Column | None = None) -> DataFrame:
    """Per shard, the first match of ``where`` among its k least (or most) recent entries."""
    order = [F.desc("touched"), F.desc("key")] if most_recent else ["touched", "key"]
    rank = Window.partitionBy("shard").orderBy(*order)
    near = entries.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k)
    if where is not None:
        near = near.filter(where)
    return near.withColumn("match", F.row_number().over(rank)).filter("match = 1").drop("match", "place")


def pop_tail(entries: DataFrame) -> DataFrame:
    """``entries`` without the least recent of each shard."""
    return lru_rank(entries).filter("lru_rank > 1").drop("lru_rank")


def victim_by_list(entries: DataFrame, start: int, probes: int = 8) -> DataFrame:
    """The least recent of the entries of ``probes`` consecutive shards from ``start`` on; ties to the nearer shard."""
    ahead = F.pmod(F.col("shard") - F.lit(start), F.lit(SHARDS))
    return entries.filter(ahead < probes).agg(F.min_by(F.struct("key", "shard", "touched"), F.struct("touched", ahead, "key")).alias("v")).filter("v IS NOT NULL").select("v.*")


def victim_by_sample(entries: DataFrame, start: int, shards: int, keys: int, seed: int) -> DataFrame:
    """The least recent of up to ``keys`` randomly drawn entries of each of ``shards`` shards from ``start`` on."""
    ahead = F.pmod(F.col("shard") - F.lit(start), F.lit(SHARDS))
    drawn = entries.filter(ahead < shards).withColumn("draw", draw(F.col("key"), seed))
    near = drawn.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("draw", "key"))).filter(F.col("place") <= keys)
    return near.agg(F.min_by(F.struct("key", "shard", "touched"), F.struct("touched", "key")).alias("v")).filter("v IS NOT NULL").select("v.*")


def draw(key: Column, seed: int) -> Column:
    """A pseudo-random number per key and seed, which other engines compute as well."""
    return key_hash(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def evict_sampled_until(entries: DataFrame, limit: int, rounds: int, shards: int = 4, keys: int = 8, seed: int = 0) -> DataFrame:
    """The entries that sampled eviction removes in up to ``rounds`` picks until the weight is at most ``limit``; with pick, 1 for the first.

    Pick number k looks at up to ``keys`` drawn entries of each of the next ``shards`` shards and takes the least recent. In
    SHARDS / ``shards`` picks no shard is looked at twice, so all of them are found at once; a round is so many picks.
    """
    each = SHARDS // shards
    left, gone, weight = entries, None, entries.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    for done in range(0, rounds, each):
        if weight <= limit:
            break
        ahead = F.pmod(F.col("shard") - 1, F.lit(SHARDS))
        drawn = left.withColumn("pick", (F.floor(ahead / shards) + 1 + done).cast("int")).filter(F.col("pick") <= rounds).withColumn("draw", draw(F.col("key"), seed + done))
        near = drawn.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("draw", "key"))).filter(F.col("place") <= keys)
        victims = near.groupBy("pick").agg(F.min_by(F.struct("key", "shard", "weight", "touched"), F.struct("touched", ahead, "draw")).alias("v")).select("pick", "v.*")
        # At most one victim a pick: the sum of SHARDS / ``shards`` rows.
        freed = F.coalesce(F.sum("weight").over(Window.orderBy("pick").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        victims = written(victims.withColumn("freed", freed).filter(F.lit(weight) - F.col("freed") > limit).drop("freed"), "victims")
        weight -= victims.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
        gone = victims if gone is None else gone.unionByName(victims)
        left = written(delete_keys(left, victims), "left")
    return entries.select("key", "shard", "weight", "touched").limit(0).withColumn("pick", F.lit(0)) if gone is None else gone


def evict_until(entries: DataFrame, limit: int, start: int = 1) -> DataFrame:
    """The entries that list eviction removes to bring the total weight to ``limit``.

    Victims go round-robin over the shards from ``start`` on, each shard's least recent first. The running
    sum over all victims is that of whole rounds before (one row a round) plus that within the round, so no
    window holds all entries.
    """
    turn = F.pmod(F.col("shard") - F.lit(start), F.lit(SHARDS))
    ranked = lru_rank(entries).withColumn("turn", turn)
    sums = ranked.groupBy("lru_rank").agg(F.sum("weight").alias("round_weight"))
    rounds = running(sums, [], F.floor(F.col("lru_rank") / 4096), ["lru_rank"], {"rounds_before": F.col("round_weight")}).drop("round_weight")
    total = entries.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    within = Window.partitionBy("lru_rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("rounds_before") + F.coalesce(F.sum("weight").over(within), F.lit(0))
    return ranked.join(rounds, "lru_rank").withColumn("freed_before", freed).filter(F.lit(total) - F.col("freed_before") > limit).drop("turn", "rounds_before")


def evict_oldest_until(entries: DataFrame, limit: int, buckets: int = 256) -> DataFrame:
    """The globally least recent entries to remove until the total weight is at most ``limit`` (what sampling tends to).

    Recency is cut into ``buckets`` ranges of about as many entries each first; only the range in which the limit is
    met needs its order. Entries of one and the same time are one range.
    """
    edges = entries.agg(F.percentile_approx("touched", [k / buckets for k in range(1, buckets)], 10_000)).first()[0]
    if edges is None:
        return entries.withColumn("freed_before", F.lit(0).cast("long"))
    edges = sorted(set(edges))
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.col("touched") > e))
    total = entries.agg(F.sum("weight")).first()[0]
    cut = entries.withColumn("range", bucket)
    sums = cut.groupBy("range").agg(F.sum("weight").alias("held"))
    sums = sums.select("range", (F.sum("held").over(Window.orderBy("range")) - F.col("held")).alias("before"))
    within = Window.partitionBy("range").orderBy("touched", "key").rowsBetween(Window.unboundedPreceding, -1)
    live = cut.join(F.broadcast(sums), "range").filter(F.lit(total) - F.col("before") > limit)  # at most ``buckets`` rows
    return live.withColumn("freed_before", F.col("before") + F.coalesce(F.sum("weight").over(within), F.lit(0))).filter(F.lit(total) - F.col("freed_before") > limit).drop("range", "before")


def reuse_distance(log: DataFrame, period: Column, run: Column | None = None, piece: int = 1 << 16) -> DataFrame:
    """(key, seq, distance): distinct other keys between an access and its key's previous one, within each ``period``.

    A single LRU list of capacity c hits exactly where distance < c. A period starts empty. Of the accesses
    between the two, those are repeats whose own previous one lies there too, so the distance is their number
    less the accesses that are earlier but whose previous one is later. These are counted by halving: two
    accesses of a period part at one binary digit of their positions, where the earlier one has 0 and the
    later one 1, and a running sum per digit counts the former. That is a row per access and digit.

    No sorted run holds a whole period. ``run`` never falls as seq grows: positions are ranks within its values
    plus the sizes of those before. Running sums are cut at every ``piece`` positions of the previous accesses,
    and the pieces' own sums are added.
    """
    rows = log.withColumn("period", period).withColumn("run", F.lit(0) if run is None else run)
    before = F.sum("n").over(Window.partitionBy("in_period").orderBy("in_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.groupBy(F.col("period").alias("in_period"), F.col("run").alias("in_run")).agg(F.count("*").alias("n"))
    runs = runs.select("in_period", "in_run", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("in_period")).alias("size"))
    own = Window.partitionBy("period", "key").orderBy("seq")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("period", "run").orderBy("seq")))
    ranked = ranked.join(runs, F.col("period").eqNullSafe(F.col("in_period")) & F.col("run").eqNullSafe(F.col("in_run"))).withColumn("at", F.col("before") + F.col("place"))
    again = ranked.withColumn("prev", F.lag("at").over(own)).filter("prev IS NOT NULL").select("period", "key", "seq", "at", "prev", "size")
    digits = again.withColumn("digit", F.explode(F.sequence(F.lit(0), F.length(F.bin("size")) - 1)))
    digits = digits.withColumn("block", F.call_function("shiftright", "at", F.col("digit") + 1)).withColumn("late", F.call_function("shiftright", "at", "digit").bitwiseAND(F.lit(1)))
    # A block of at most ``piece`` positions stays whole.
    digits = digits.withColumn("part", F.when(F.pow(F.lit(2.0), F.col("digit") + 1) > piece, F.floor(F.col("prev") / piece)).otherwise(-1))
    later = Window.partitionBy("period", "digit", "block", "part").orderBy(F.desc("prev")).rowsBetween(Window.unboundedPreceding, 0)
    names = {c: f"of_{c}" for c in ("period", "digit", "block", "part")}
    parts = digits.filter("part >= 0").groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.sum(1 - F.col("late")).alias("held"))
    behind = Window.partitionBy("of_period", "of_digit", "of_block").orderBy(F.desc("of_part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*names.values(), F.coalesce(F.sum("held").over(behind), F.lit(0)).alias("held_behind"))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    counted = digits.withColumn("repeats", F.sum(1 - F.col("late")).over(later)).filter("late = 1").join(parts, same, "left")
    repeats = F.sum(F.col("repeats") + F.coalesce("held_behind", F.lit(0)))
    return counted.groupBy("key", "seq", "at", "prev").agg(repeats.alias("repeats")).select("key", "seq", (F.col("at") - F.col("prev") - 1 - F.col("repeats")).alias("distance"))
