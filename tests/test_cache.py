"""The cache over tables: requests, limits, admission, expiry."""

import threading
import time

from pyspark.sql import functions as F

from cachelens.cache import Cache
from cachelens.config import AdmissionConfig, CacheConfig, DbConfig, EvictionConfig, LifetimeConfig
from cachelens.functions.keys import key_hash
from cachelens.operators import storage
from cachelens.streaming.workers import NotResponded, Workers


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "key long")


def load(size=44):
    return lambda missing: missing.withColumn("payload", F.when(F.col("key") >= 0, F.lpad(F.col("key").cast("string"), size, "0")))


def outcomes(answers):
    return sorted((r.key, r.outcome) for r in answers.collect())


def test_requests(spark):
    cache = Cache(spark, CacheConfig())
    assert outcomes(cache.get(keys(spark, 1, 1, 2, -1, None), load(), 10)) == [(-1, "miss_error"), (1, "miss_admitted"), (1, "miss_admitted"), (2, "miss_admitted")]
    assert outcomes(cache.get(keys(spark, 1, 3, -1), load(), 20)) == [(-1, "miss_error"), (1, "hit"), (3, "miss_admitted")]
    assert {r.key: (r.touched, r.updated_us) for r in cache.around().collect()} == {1: (20, 10), 2: (10, 10), 3: (20, 20)}
    assert (cache.len(), cache.mem()) == (3, 300)
    assert [r.key for r in cache.around(F.col("touched") < 20).collect()] == [2]
    cache.update(F.lit("x"), F.col("key") == 1)
    assert cache.mem() == 257 and sum(r.mem for r in cache.shards().collect()) == 257
    cache.delete(keys(spark, 2, 9))
    assert cache.len() == 2
    assert cache.get(keys(spark), load(), 30).count() == 0
    one = cache.around(F.col("key") == 1).first().shard
    cache.clear(one)
    assert {r.key for r in cache.around().collect()} == {3}
    cache.clear()
    assert (cache.len(), cache.mem()) == (0, 0)


def test_limits(spark):
    cache = Cache(spark, CacheConfig(db=DbConfig(size_bytes=1000), eviction=EvictionConfig(mode="sampling")))
    cache.get(keys(spark, *range(9)), load(), 1)
    cache.force_call()
    assert cache.mem() == 800 and cache.metrics()["evictor"] == {"scans": 1, "hits": 1, "items": 1, "bytes": 100}
    cache.get(keys(spark, *range(20, 25)), load(), 2)
    assert cache.mem() == 1000 and {r.key for r in cache.around().collect()} >= set(range(20, 25))
    assert cache.metrics()["cache"]["hard_items"] == 3
    listed = Cache(spark, CacheConfig(db=DbConfig(size_bytes=1000), eviction=EvictionConfig()))
    listed.get(keys(spark, *range(30)), load(), 1)
    assert listed.mem() == 1000


def test_admission(spark):
    cfg = CacheConfig(db=DbConfig(size_bytes=300), admission=AdmissionConfig(), eviction=EvictionConfig())
    cache = Cache(spark, cfg)
    cache.get(keys(spark, 1, 2, 3), load(), 0)
    assert outcomes(cache.get(keys(spark, 7), load(), 1)) == [(7, "miss_rejected")]
    assert {r.key for r in cache.around().collect()} == {1, 2, 3}
    often = keys(spark, 7).select(key_hash(F.col("key")).alias("key_hash"))
    seen = often.select("key_hash", F.explode(F.sequence(F.lit(2).cast("long"), F.lit(9).cast("long"))).alias("at"))
    cache.record(seen.select("key_hash", F.struct("at", F.col("key_hash").alias("key")).alias("seq")))
    assert outcomes(cache.get(keys(spark, 7), load(), 10)) == [(7, "miss_admitted")]
    assert cache.len() == 3 and cache.metrics()["cache"] == {"allowed": 4, "not_allowed": 1, "hard_items": 1, "hard_bytes": 100}


def test_expiry(spark):
    remove = Cache(spark, CacheConfig(lifetime=LifetimeConfig(ttl_us=10)))
    remove.get(keys(spark, 1, 2), load(), 0)
    remove.expire(10)
    assert remove.len() == 2
    remove.expire(11)
    assert remove.len() == 0 and remove.metrics()["lifetimer"] == {"affected": 2, "errors": 0, "scans": 2, "hits": 1, "misses": 1}
    renew = Cache(spark, CacheConfig(lifetime=LifetimeConfig(on_ttl="refresh", ttl_us=10, rate=1)))
    renew.get(keys(spark, 1), load(), 0)
    renew.get(keys(spark, 2), load(), 1)
    renew.expire(20, load(4))
    assert {r.key: (r.payload[-4:], r.weight, r.updated_us, r.touched) for r in renew.around().collect()} == {1: ("0001", 60, 20, 0), 2: ("0002", 100, 1, 1)}
    renew.expire(21, lambda due: due.withColumn("payload", F.lit(None).cast("string")))
    assert renew.metrics()["lifetimer"]["errors"] == 1 and renew.len() == 2
    own = Cache(spark, CacheConfig(lifetime=LifetimeConfig(on_ttl="refresh", ttl_us=10)))
    own.get(keys(spark, 1, 2), lambda m: load()(m).withColumn("ttl_us", F.when(F.col("key") == 1, 100)).withColumn("on_ttl", F.lit("remove")), 0)
    own.expire(50)
    assert [r.key for r in own.around().collect()] == [1]


def test_first_accesses_of_a_hot_and_a_null_key(spark):
    rows = [(1, i) for i in range(50)] + [(None, 60), (None, 61), (2, 70)]
    got = storage.classify_hits(spark.createDataFrame(rows, "key long, seq long").withColumn("first_seen", F.lit(0)))
    assert sorted(r.seq for r in got.collect() if r.outcome == "miss") == [0, 60, 70] and got.count() == 53


def test_touched_expired_entries_are_taken_first(spark):
    cache = Cache(spark, CacheConfig(lifetime=LifetimeConfig(on_ttl="refresh", ttl_us=10, rate=1)))
    cache.get(keys(spark, 1, 2, 3), load(), 0)
    assert outcomes(cache.get(keys(spark, 3), load(), 20)) == [(3, "hit")]  # served though expired
    assert [r.key for r in cache.queue.collect()] == [3]
    cache.expire(20, load())
    assert {r.key: r.updated_us for r in cache.around().collect()} == {1: 0, 2: 0, 3: 20} and cache.queue.isEmpty()
    assert [r.key for r in cache.around(shards=0).collect()] == []


def test_workers_tick_log_and_close(spark):
    records = []
    cfg = CacheConfig(db=DbConfig(size_bytes=1000, telemetry_logs=True, telemetry_interval_us=1_000_000), eviction=EvictionConfig(mode="sampling", calls_per_sec=2), lifetime=LifetimeConfig(ttl_us=3_600_000_000))
    cache = Cache(spark, cfg)
    cache.get(keys(spark, *range(9)), load(), time.time_ns() // 1000)
    running = Workers(cache, load(), lambda *r: records.append(r)).start()
    began = time.time()
    while time.time() - began < 90 and (cache.mem() > 800 or not any(r[1] == "soft_evictor" and "hits=1" in r[2] for r in records)):
        time.sleep(0.5)
    with running.lock:
        assert cache.mem() == 800 and {r[1] for r in records} == {"lifetime_manager", "soft_evictor", "storage"}
        failed = []

        def call():
            try:
                running.force_call(0.1)
            except NotResponded as e:
                failed.append(e)

        caller = threading.Thread(target=call)
        caller.start()
        caller.join()
        assert failed
    running.force_call(30)
    cache.close()
    assert not any(q.isActive for q in running.queries) and cache.len() == 8
    running.force_call(0.1)
