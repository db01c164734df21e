"""A cache whose entries are a table: batches of requests are answered, loaded, admitted, evicted and expired by joins.

Each call takes a whole batch, with one time for all of it, and leaves a new table of entries in the shared
folder, so lineage stays short and lost executors cost one step. Within a batch a key is loaded once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CacheConfig, adjusted
from .functions.keys import SHARDS, key_hash, shard_of
from .functions.scalars import expired, expiry_probability, weight
from .operators import admission, lifetime, queues, storage
from .sources.tables import written

#: Removals at expiry a second, where nothing is loaded again.
REMOVALS_PER_SECOND = 100_000
#: Places of a shard's refresh queue; one stays free.
RING = 1024
Loader = Callable[[DataFrame], DataFrame]


class Cache:
    """Entries (key, payload, shard, weight, touched, updated_us, ttl_us, removes) under a configuration.

    A loader takes distinct keys (key) and returns (key, payload) with, if it likes, ttl_us and on_ttl of its
    own; a null payload is a failure, which is answered but not kept. Times are microseconds. Requests for a
    null key are answered by nothing. With admission, a key counts once a batch.
    """

    def __init__(self, spark: SparkSession, cfg: CacheConfig, key_type: str = "long", payload_type: str = "string"):
        self.spark, self.cfg = spark, adjusted(cfg)
        self.empty = f"key {key_type}, payload {payload_type}, shard int, weight long, touched long, updated_us long, ttl_us long, removes boolean"
        self.entries = spark.createDataFrame([], self.empty)
        self.queue = spark.createDataFrame([], f"shard int, key {key_type}, seq long")
        self.turn, self.workers = 0, None
        self.sketch = admission.Sketch.empty(spark)
        self.admitted, self.evicted, self.aged = dict.fromkeys(("allowed", "not_allowed", "hard_items", "hard_bytes"), 0), dict.fromkeys(("scans", "hits", "items", "bytes"), 0), dict.fromkeys(("affected", "errors", "scans", "hits", "misses"), 0)

    def keep(self, entries: DataFrame) -> None:
        self.entries = written(entries.select([x.split()[0] for x in self.empty.split(", ")]), "entries")

    def fresh(self, loaded: DataFrame, now_us: int) -> DataFrame:
        """Entries of loaded rows."""
        life = self.cfg.lifetime
        ttl, removes = F.lit(life.ttl_us if life else 0).cast("long"), F.lit(life.is_remove if life else True)
        if "ttl_us" in loaded.columns:
            ttl = F.coalesce(F.col("ttl_us"), ttl)
        if "on_ttl" in loaded.columns:
            removes = F.coalesce(F.col("on_ttl") != "refresh", removes)
        now = F.lit(now_us).cast("long")
        return loaded.select("key", "payload", shard_of(key_hash(F.col("key"))).alias("shard"), weight(F.col("payload")).alias("weight"), now.alias("touched"), now.alias("updated_us"), ttl.alias("ttl_us"), removes.alias("removes"))

    def get(self, requests: DataFrame, loader: Loader, now_us: int) -> DataFrame:
        """``requests`` (key, ...) with payload and outcome: hit, miss_admitted, miss_rejected or miss_error."""
        requests = requests.filter("key IS NOT NULL")
        answers, loaded = storage.get_or_compute(requests, self.entries, lambda missing: written(loader(missing), "loaded"))
        fresh, asked = self.fresh(loaded, now_us), requests.select("key").distinct()
        rejected = None
        if self.cfg.admission is not None:
            own = asked.select(key_hash(F.col("key")).alias("key_hash"))
            seen = own.select("key_hash", F.struct(F.lit(now_us).cast("long").alias("at"), F.col("key_hash").alias("key")).alias("seq"))
            self.record(seen)
            added = fresh.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
            if self.cfg.eviction is not None and self.mem() and self.mem() + added > self.cfg.db.size_bytes:
                rejected = written(self.rejected(fresh), "rejected")
                fresh = storage.delete_keys(fresh, rejected)
        answers = written(answers if rejected is None else self.marked(answers, rejected), "answers")
        if self.cfg.admission is not None:
            turned = 0 if rejected is None else rejected.count()
            self.admitted["not_allowed"] += turned
            self.admitted["allowed"] += fresh.count()
        touched = self.entries.join(asked.withColumn("asked", F.lit(True)), "key", "left").withColumn("touched", F.when(F.col("asked"), F.lit(now_us).cast("long")).otherwise(F.col("touched"))).drop("asked")
        self.enqueue(self.entries.join(asked, "key", "left_semi"), now_us)
        self.keep(touched.unionByName(fresh))
        if self.cfg.eviction is not None and self.mem() > self.cfg.db.size_bytes:
            items, size = self.evict(self.cfg.db.size_bytes)
            self.admitted["hard_items"] += items
            self.admitted["hard_bytes"] += size
        return answers

    def record(self, seen: DataFrame) -> None:
        """Counts accesses (key_hash, seq) in the admission sketch; the accesses themselves aren't kept."""
        after = admission.advanced(seen, self.sketch, self.cfg.admission)
        self.sketch = admission.Sketch(written(after.bits, "bits"), written(after.table, "counters"), written(after.adds, "adds"))

    def rejected(self, fresh: DataFrame) -> DataFrame:
        """(key) of the loaded entries that aren't more frequent than the least recent entry."""
        self.turn += 1
        if self.cfg.eviction is None or self.cfg.eviction.is_listing:
            found = storage.victim_by_list(self.entries, 0, probes=1024)
        else:  # of the next two shards, as far as they have entries
            found = storage.victim_by_sample(self.entries, self.turn, 2, 8, seed=self.turn)
            found = found if not found.isEmpty() else storage.victim_by_sample(self.entries, 0, SHARDS, 8, seed=self.turn)
        victim = found.select(key_hash(F.col("key"))).first()[0]
        pairs = fresh.select("key", key_hash(F.col("key")).alias("candidate"), F.lit(victim).cast("long").alias("victim"))
        verdict = admission.allow_by(pairs.select("candidate", "victim").distinct(), self.sketch.table, self.sketch.bits, self.cfg.admission)
        return pairs.join(verdict.filter("NOT allow").select("candidate"), "candidate", "left_semi").select("key")

    def enqueue(self, touched: DataFrame, now_us: int) -> None:
        """Touched entries that have expired are queued for refresh, once each, as far as their shard's ring has places."""
        if self.cfg.lifetime is None:
            return
        old = expired(F.lit(now_us).cast("long"), F.col("updated_us"), F.col("ttl_us"))
        new = touched.select("shard", "key", F.lit(now_us).cast("long").alias("seq"), old.alias("expired"))
        held = self.queue.select("shard", "key", "seq", F.lit(True).alias("expired"))
        self.queue = written(queues.enqueue_touched(held.unionByName(new), RING).filter("queued").select("shard", "key", "seq"), "queue")

    def marked(self, answers: DataFrame, rejected: DataFrame) -> DataFrame:
        turned = rejected.withColumn("turned", F.lit(True))
        return answers.join(turned, "key", "left").withColumn("outcome", F.when(F.col("turned"), "miss_rejected").otherwise(F.col("outcome"))).drop("turned")

    def delete(self, keys: DataFrame) -> None:
        """Entries of ``keys`` (key) go; unknown keys are no error."""
        self.keep(storage.delete_keys(self.entries, keys))

    def clear(self, shard: int | None = None) -> None:
        """All entries go, or those of one shard. What waits in refresh queues stays there until it is looked for."""
        if shard is None:
            self.entries = self.spark.createDataFrame([], self.empty)
        else:
            self.keep(self.entries.filter(F.col("shard") != shard))

    def len(self) -> int:
        return self.entries.count()

    def mem(self) -> int:
        return self.entries.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]

    def shards(self) -> DataFrame:
        """(shard, len, mem)"""
        return storage.shard_stats(self.entries)

    def around(self, where: Column | None = None, stop: Column | None = None, shards: int = SHARDS) -> DataFrame:
        """The entries, or those that match; with ``stop`` in each shard by key up to the first that it holds for, in the first ``shards``."""
        found = self.entries if stop is None and shards == SHARDS else queues.walk(self.entries, F.col("key"), F.lit(False) if stop is None else stop, shards)
        return found if where is None else found.filter(where)

    def close(self) -> None:
        """Stops the background workers; the entries stay."""
        if self.workers is not None:
            self.workers.close()

    def update(self, change: Column, where: Column | None = None) -> None:
        """A scan that writes: payloads become ``change`` where it holds; their times stay."""
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        self.keep(self.entries.withColumn("payload", F.when(hit, change).otherwise(F.col("payload"))).withColumn("weight", weight(F.col("payload"))))

    def evict(self, limit: int) -> tuple[int, int]:
        """(items, bytes) evicted to bring the weight to ``limit``: round-robin lists, or the oldest by sampling's ideal."""
        listing = self.cfg.eviction is None or self.cfg.eviction.is_listing
        gone = written((storage.evict_until if listing else storage.evict_oldest_until)(self.entries, limit).select("key", "weight"), "evicted")
        items, size = gone.agg(F.count("*"), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if items:
            self.delete(gone)
        return items, size

    def force_call(self) -> None:
        """One round of the evictor: down to the soft limit if it is exceeded."""
        if self.cfg.eviction is None:
            return
        mem = self.mem()
        self.evicted["scans"] += mem > 0
        if mem > self.cfg.eviction.soft_limit_bytes:
            items, size = self.evict(self.cfg.eviction.soft_limit_bytes)
            self.evicted["hits"] += 1
            self.evicted["items"] += items
            self.evicted["bytes"] += size

    def expire(self, now_us: int, loader: Loader | None = None, seconds: int = 1, seed: int = 0) -> None:
        """One round of the lifetime worker over ``seconds``: the longest not updated of the expired entries are removed or loaded again, within the rate."""
        life = self.cfg.lifetime
        if life is None:
            return
        now = F.lit(now_us).cast("long")
        old = expired(now, F.col("updated_us"), F.col("ttl_us"))
        if life.stochastic:
            draw = F.pmod(F.xxhash64("key", F.lit(now_us), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
            chance = expiry_probability(now, F.col("updated_us"), F.col("ttl_us"), life.beta, life.coefficient)
            old = draw < chance
        rate = REMOVALS_PER_SECOND if life.is_remove else life.rate
        flags = self.queue.select("key", F.lit(True).alias("flag"))
        rows = self.entries.join(flags, "key", "left").withColumn("expired", old).withColumn("is_queued", F.coalesce("flag", F.lit(False)))
        due = written(lifetime.expired_first(rows, max(1, rate * seconds)).select("key", "removes"), "due")
        # Taken keys leave the queue, and so do those that are gone or fresh again.
        waiting = rows.filter("expired AND is_queued").select("key")
        self.queue = written(self.queue.join(waiting, "key", "left_semi").join(due, "key", "left_anti"), "queue")
        found, again = due.agg(F.count("*"), F.count_if(~F.col("removes"))).first()
        self.aged["scans"] += 1
        self.aged["hits" if found else "misses"] += 1
        kept = storage.delete_keys(self.entries, due.filter("removes"))
        affected = found - again
        if again and loader is not None:
            loaded = written(loader(due.filter("NOT removes").select("key")), "loaded")
            renewed = self.fresh(loaded.filter("payload IS NOT NULL"), now_us).drop("touched")
            touched = self.entries.select("key", "touched")
            kept = storage.delete_keys(kept, renewed).unionByName(renewed.join(touched, "key"))
            affected += renewed.count()
            self.aged["errors"] += found - affected
        self.aged["affected"] += affected
        if found:
            self.keep(kept)

    def metrics(self) -> dict[str, dict[str, int]]:
        """Cumulative counters of admission and hard limit, evictor, and lifetime worker."""
        return {"cache": dict(self.admitted), "evictor": dict(self.evicted), "lifetimer": dict(self.aged)}
