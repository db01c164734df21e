"""The queries of the cache-workload operators over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cache import Cache
from ..config import AdmissionConfig, CacheConfig, DbConfig, EvictionConfig, LifetimeConfig, load_config
from ..functions.keys import entry_key, identity, key_hash, key_hash_sql, mix64, mix64_sql, next_pow2, same_key, shard_of
from ..functions.scalars import cached_time, expired, expiry_probability, fmt_mem, payload_equal, stream_seed, uniform, weight
from ..operators import admission, lifetime, queues, replay, storage, telemetry, workers
from ..sources.tables import document_entries, event_log, shared_folder, table
from ..streaming.ttl import drain_ttl_stream

TTL_US = 6 * 3600 * 1_000_000
NOW = "2024-01-31 00:00:00"
NOW_US = 1_706_659_200_000_000
ADMISSION = AdmissionConfig()
DAY_US = 86_400_000_000

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


LOG = "log AS (SELECT user_id AS key, epoch_us(ts) AS ts_us, event_id, 56 + octet_length(encode(coalesce(props, ''))) AS weight, event_type AS op FROM events)"
USERS = f"users AS (SELECT user_id AS key, {key_hash_sql('user_id')} & 1023 AS shard, max(epoch_us(ts)) AS touched, count(*) AS n FROM events GROUP BY user_id)"
DOCS = f"docs AS (SELECT doc_id AS key, ({key_hash_sql('doc_id')} & 1023)::INT AS shard, (56 + octet_length(encode(coalesce(text, ''))))::BIGINT AS weight, doc_id AS touched FROM documents)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (key, shard, touched): a user's last access."""
    log = event_log(spark, sf_dir)
    return log.groupBy("key").agg(F.max("ts_us").alias("touched")).withColumn("shard", shard_of(key_hash(F.col("key"))))


@query(f"WITH {LOG}, c AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY ts_us, event_id) = 1 AS miss FROM log) SELECT ({key_hash_sql('key')} & 1023)::INT AS shard, count(*) FILTER (NOT miss) AS hits, count(*) FILTER (miss) AS misses FROM c GROUP BY 1")
def get_hit_miss(spark, sf_dir):
    rows = storage.classify_hits(event_log(spark, sf_dir))
    return rows.groupBy(shard_of(key_hash(F.col("key"))).alias("shard")).agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count_if(F.col("outcome") == "miss").alias("misses"))


@query("SELECT e.event_id, e.user_id AS key, coalesce(c.c_name, 'loaded-' || e.user_id) AS payload, CASE WHEN c.c_custkey IS NULL THEN 'miss_admitted' ELSE 'hit' END AS outcome FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 3 = 0")
def get_or_compute_join(spark, sf_dir):
    seed = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("payload"))
    requests = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"))
    answers, _ = storage.get_or_compute(requests, seed, lambda missing: missing.withColumn("payload", F.concat(F.lit("loaded-"), F.col("key").cast("string"))))
    return answers.select("event_id", "key", "payload", "outcome")


@query(f"WITH {DOCS} SELECT shard, count(*) AS len, sum(weight)::BIGINT AS mem FROM docs WHERE key NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY shard")
def del_anti(spark, sf_dir):
    gone = event_log(spark, sf_dir).filter("op = 'error'").select("key").distinct()
    return storage.shard_stats(storage.delete_keys(document_entries(spark, sf_dir), gone))


@query(f"WITH {DOCS} SELECT shard, count(*) AS len, sum(weight)::BIGINT AS mem FROM docs GROUP BY shard")
def shard_stats(spark, sf_dir):
    return storage.shard_stats(document_entries(spark, sf_dir))


def line_writes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_partkey").alias("key"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"), F.floor(F.col("l_quantity")).cast("long").alias("weight"), "l_orderkey", "l_linenumber")


@query("SELECT l_partkey AS key, arg_max(floor(l_quantity)::BIGINT, (l_shipdate, l_orderkey, l_linenumber)) AS weight FROM lineitem GROUP BY l_partkey")
def upsert_last_wins(spark, sf_dir):
    return storage.last_wins(line_writes(spark, sf_dir), "weight")


@query("WITH w AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, floor(l_quantity)::BIGINT AS weight, lag(floor(l_quantity)::BIGINT) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS before FROM lineitem) SELECT key, l_orderkey, l_linenumber, (before IS NULL)::INT AS len_delta, (weight - coalesce(before, 0))::BIGINT AS bytes_delta FROM w")
def set_deltas(spark, sf_dir):
    return storage.write_deltas(line_writes(spark, sf_dir)).select("key", "l_orderkey", "l_linenumber", "len_delta", "bytes_delta")


@query(f"WITH {USERS} SELECT key, shard::INT AS shard, touched, row_number() OVER (PARTITION BY shard ORDER BY touched, key)::INT AS lru_rank FROM users")
def lru_rank(spark, sf_dir):
    return storage.lru_rank(users(spark, sf_dir)).select("key", "shard", "touched", "lru_rank")


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY touched, key) AS p FROM docs), m AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY p) AS q FROM r WHERE p <= 3 AND weight > 2000) SELECT key, shard, weight FROM m WHERE q = 1")
def lru_peek_tail_k(spark, sf_dir):
    return storage.peek(document_entries(spark, sf_dir), 3, where=F.col("weight") > 2000).select("key", "shard", "weight")


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY touched DESC, key DESC) AS p FROM docs) SELECT key, shard, weight FROM r WHERE p = 1")
def lru_peek_head(spark, sf_dir):
    return storage.peek(document_entries(spark, sf_dir), 1, most_recent=True).select("key", "shard", "weight")


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY touched, key) AS p FROM docs) SELECT key, shard FROM r WHERE p > 1")
def lru_pop_tail(spark, sf_dir):
    return storage.pop_tail(document_entries(spark, sf_dir)).select("key", "shard")


@query(f"WITH {DOCS} SELECT key, shard, touched FROM docs WHERE (shard - 1020 + 1024) % 1024 < 8 ORDER BY touched, (shard - 1020 + 1024) % 1024, key LIMIT 1")
def victim_by_list(spark, sf_dir):
    return storage.victim_by_list(document_entries(spark, sf_dir), 1020)


@query(f"WITH {DOCS} SELECT key, shard, touched FROM docs ORDER BY touched, key LIMIT 1")
def victim_global(spark, sf_dir):
    return storage.victim_by_list(document_entries(spark, sf_dir), 0, probes=1024)


def draw_sql(key: str, seed: int) -> str:
    return key_hash_sql(f"({key} || '|{seed}')")


@query(f"WITH {DOCS}, d AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {draw_sql('key', 1)}, key) AS place FROM docs WHERE (shard - 1 + 1024) % 1024 < 64) SELECT key, shard, touched FROM d WHERE place <= 8 ORDER BY touched, key LIMIT 1")
def victim_by_sample(spark, sf_dir):
    return storage.victim_by_sample(document_entries(spark, sf_dir), 1, 64, 8, seed=1)


@query(f"WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY touched, key) AS lru_rank, (shard - 1 + 1024) % 1024 AS turn FROM docs), s AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY lru_rank, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before, sum(weight) OVER () AS total FROM r) SELECT key, shard, weight, freed_before FROM s WHERE total - freed_before > 1000000")
def evict_until_limit(spark, sf_dir):
    return storage.evict_until(document_entries(spark, sf_dir), 1_000_000).select("key", "shard", "weight", "freed_before")


@query(f"WITH {DOCS}, s AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY touched, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS freed_before, sum(weight) OVER () AS total FROM docs) SELECT key, weight, freed_before FROM s WHERE total - freed_before > 1000000")
def evict_oldest_until_limit(spark, sf_dir):
    return storage.evict_oldest_until(document_entries(spark, sf_dir), 1_000_000).select("key", "weight", "freed_before")


SAMPLED = f"""{DOCS}, a AS (SELECT *, (shard - 1 + 1024) % 1024 AS ahead, {draw_sql('key', 0)} AS draw FROM docs),
    p AS (SELECT *, (ahead // 4 + 1)::INT AS pick, row_number() OVER (PARTITION BY shard ORDER BY draw, key) AS place FROM a WHERE ahead < 800),
    v AS (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY touched, ahead, draw) AS best FROM p WHERE place <= 8),
    f AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM v WHERE best = 1)"""


@query(f"WITH {SAMPLED} SELECT pick, key, shard, weight FROM f WHERE (SELECT sum(weight) FROM docs) - freed > (SELECT sum(weight) * 9 // 10 FROM docs)")
def evict_by_sample(spark, sf_dir):
    entries = document_entries(spark, sf_dir)
    limit = entries.agg(F.sum("weight")).first()[0] * 9 // 10
    return storage.evict_sampled_until(entries, limit, rounds=200).select("pick", "key", "shard", "weight")


DISTANCES = f"""{LOG}, r AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) AS pos FROM log),
    l AS (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS prev FROM r),
    d AS (SELECT a.event_id, a.key, (SELECT count(DISTINCT b.key) FROM l b WHERE b.pos > a.prev AND b.pos < a.pos) AS distance FROM l a WHERE a.prev IS NOT NULL)"""


def log_distances(spark, sf_dir):
    """Positions are counted hour by hour and added up; no access is lost at the hour's edge."""
    return storage.reuse_distance(event_log(spark, sf_dir), F.lit(0), run=F.floor(F.col("ts_us") / (DAY_US // 24)))


@query(f"WITH {DISTANCES} SELECT event_id, key, distance FROM d")
def lru_reuse_distance(spark, sf_dir):
    return log_distances(spark, sf_dir).select(F.col("seq.id").alias("event_id"), "key", "distance")


@query(f"WITH {DISTANCES} SELECT c.capacity, count(*) FILTER (distance < capacity) AS hits FROM d, (SELECT unnest([5, 10, 20, 50]) AS capacity) c GROUP BY c.capacity")
def lru_hit_by_capacity(spark, sf_dir):
    rows = log_distances(spark, sf_dir).groupBy("distance").agg(F.count("*").alias("n"))
    sizes = rows.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in (5, 10, 20, 50)])))
    return sizes.groupBy("capacity").agg(F.sum(F.when(F.col("distance") < F.col("capacity"), F.col("n")).otherwise(0)).alias("hits"))


@query(f"SELECT event_id, ({NOW_US} - epoch_us(ts) > 3600000000 * (1 + user_id % 800)) AS expired FROM events")
def expired_deterministic(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select("event_id", expired(F.lit(NOW_US), F.col("ts_us"), F.lit(3_600_000_000) * (1 + F.col("key") % 800)).alias("expired"))


@query(f"SELECT event_id, CASE WHEN {NOW_US} - epoch_us(ts) >= {12 * DAY_US} THEN round(1 - exp(-0.5::DOUBLE * ({NOW_US} - epoch_us(ts))::DOUBLE / {24 * DAY_US}), 9) ELSE 0.0::DOUBLE END AS probability FROM events")
def expire_probability(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select("event_id", F.round(expiry_probability(F.lit(NOW_US), F.col("ts_us"), F.lit(24 * DAY_US), 0.5, 0.5), 9).alias("probability"))


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, event_id) AS n FROM log),
    f AS (SELECT key, event_id, ts_us, n, ts_us AS anchor, 'miss' AS outcome FROM o WHERE n = 1
    UNION ALL SELECT o.key, o.event_id, o.ts_us, o.n, CASE WHEN o.ts_us - f.anchor > {TTL_US} THEN o.ts_us ELSE f.anchor END, CASE WHEN o.ts_us - f.anchor > {TTL_US} THEN 'miss' ELSE 'hit' END FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
    SELECT key, event_id, ts_us, outcome FROM f""")
def ttl_fold(spark, sf_dir):
    return lifetime.ttl_fold(event_log(spark, sf_dir), TTL_US)


@query("WITH d AS (SELECT user_id AS key, epoch_us(ts) AS updated_us, event_id, epoch_us(date_trunc('hour', ts)) AS due_us FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY due_us ORDER BY updated_us, key)::INT AS place FROM d) SELECT key, event_id, place FROM r WHERE place <= 3")
def refresh_pick_oldest(spark, sf_dir):
    log = event_log(spark, sf_dir)
    hour = 3_600_000_000
    due = log.select("key", "event_id", F.col("ts_us").alias("updated_us"), (F.floor(F.col("ts_us") / hour) * hour).alias("due_us"))
    return lifetime.refresh_picks(due, 3).select("key", "event_id", "place")


def hour():
    """By this sums over the log are cut."""
    return F.floor(F.col("ts_us") / 3_600_000_000)


def hashed_log(spark, sf_dir):
    return event_log(spark, sf_dir).withColumn("key_hash", key_hash(F.col("key")))


def spots(h: str, count: int, size: int) -> str:
    """DuckDB list of the positions of a hash, nested by unrolled mixing of a UBIGINT."""
    chain = f"[{h}::UBIGINT]"
    for _ in range(count - 1):
        chain = f"list_transform([{chain}], lambda a: list_append(a, {mix64_sql('a[-1]')}))[1]"
    return f"list_transform({chain}, lambda p: (p & {size - 1})::BIGINT)"


SEEN = f"""{LOG}, keys AS (SELECT DISTINCT key, {key_hash_sql('key')} AS h FROM log),
    bits AS (SELECT key, h, h & {ADMISSION.shards - 1} AS shard, unnest(list_distinct({spots('h', 3, ADMISSION.door_len)})) AS bit FROM keys),
    firsts AS (SELECT shard, bit, min((ts_us, event_id)) AS first FROM bits JOIN log USING (key) GROUP BY shard, bit),
    known AS (SELECT key, h, shard, max(first) AS all_set FROM bits JOIN firsts USING (shard, bit) GROUP BY key, h, shard),
    seen AS (SELECT log.*, h, shard, all_set < (ts_us, event_id) AS seen FROM log JOIN known USING (key))"""
INCS = f"""{SEEN}, ord AS (SELECT key, h, shard, ((row_number() OVER (PARTITION BY shard ORDER BY ts_us, event_id) - 1) // {ADMISSION.reset_at})::INT AS epoch FROM seen WHERE seen),
    kidx AS (SELECT key, unnest({spots('h', 4, ADMISSION.table_len)}) AS idx FROM keys),
    incs AS (SELECT shard, idx, epoch, count(*) AS n FROM ord JOIN kidx USING (key) GROUP BY shard, idx, epoch)"""
COUNTERS = f"""{INCS}, lasts AS (SELECT shard, max(epoch) AS last FROM incs GROUP BY shard), slots AS (SELECT DISTINCT shard, idx FROM incs),
    fold AS (SELECT s.shard, s.idx, 0 AS epoch, least(15, coalesce(n, 0)) AS c FROM slots s LEFT JOIN incs i ON i.shard = s.shard AND i.idx = s.idx AND i.epoch = 0
    UNION ALL SELECT f.shard, f.idx, f.epoch + 1, least(15, f.c // 2 + coalesce(i.n, 0)) FROM fold f JOIN lasts l ON l.shard = f.shard AND f.epoch < l.last LEFT JOIN incs i ON i.shard = f.shard AND i.idx = f.idx AND i.epoch = f.epoch + 1),
    counters AS (SELECT f.shard, f.idx, f.c FROM fold f JOIN lasts l ON l.shard = f.shard AND l.last = f.epoch),
    est AS (SELECT key, h, min(coalesce(c, 0)) AS estimate FROM keys JOIN kidx USING (key) LEFT JOIN counters k ON k.shard = h & {ADMISSION.shards - 1} AND k.idx = kidx.idx GROUP BY key, h)"""


@query(f"WITH {SEEN} SELECT event_id, shard::INT AS shard, seen FROM seen")
def doorkeeper_seen(spark, sf_dir):
    return admission.doorkeeper(hashed_log(spark, sf_dir), ADMISSION).select("event_id", "shard", "seen")


@query(f"WITH {INCS}, counters AS (SELECT shard, idx, least(15, sum(n)) AS c FROM incs GROUP BY shard, idx) SELECT h AS key_hash, min(coalesce(c, 0))::INT AS estimate FROM keys JOIN kidx USING (key) LEFT JOIN counters k ON k.shard = h & {ADMISSION.shards - 1} AND k.idx = kidx.idx GROUP BY h")
def sketch_estimate(spark, sf_dir):
    log = hashed_log(spark, sf_dir)
    return admission.estimates(log, admission.counters(log, ADMISSION, aging=False, bucket=hour()), ADMISSION)


@query(f"WITH RECURSIVE {COUNTERS} SELECT shard::INT AS shard, idx, c::INT AS counter FROM counters")
def sketch_aged(spark, sf_dir):
    return admission.counters(hashed_log(spark, sf_dir), ADMISSION, bucket=hour())


@query(f"WITH RECURSIVE {COUNTERS} SELECT shard::INT AS shard, idx, (c // 2)::INT AS counter FROM counters WHERE c // 2 > 0")
def sketch_reset(spark, sf_dir):
    return admission.reset(admission.counters(hashed_log(spark, sf_dir), ADMISSION, bucket=hour()))


@query(f"WITH RECURSIVE {COUNTERS}, v AS (SELECT h, estimate FROM est ORDER BY key LIMIT 1) SELECT est.h AS candidate, v.h AS victim, est.estimate::INT AS candidate_freq, v.estimate::INT AS victim_freq, (est.h = v.h OR est.estimate > v.estimate) AS allow FROM est, v")
def admission_allow(spark, sf_dir):
    log = hashed_log(spark, sf_dir)
    victim = log.agg(F.min_by("key_hash", "key")).first()[0]
    pairs = log.select(F.col("key_hash").alias("candidate")).distinct().withColumn("victim", F.lit(victim).cast("long"))
    return admission.allow(pairs, log, ADMISSION, hour()).select("candidate", "victim", "candidate_freq", "victim_freq", "allow")


@query("SELECT l_partkey AS key, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, key LIMIT 20")
def hot_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20)


def fmt_sql(x: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    return "CASE " + " ".join(f"WHEN {x} >= {1 << 10 * k} THEN ({x} // {1 << 10 * k}) || '{units[k]} ' || (({x} % {1 << 10 * k}) // {1 << 10 * (k - 1)}) || '{units[k - 1]}'" for k in range(4, 0, -1)) + f" ELSE {x} || 'B' END"


SIZES = "(o_orderkey * o_orderkey * o_custkey)"


@query(f"SELECT o_orderkey, {fmt_sql(SIZES)} AS size FROM orders")
def fmt_mem_sizes(spark, sf_dir):
    """Sizes made of keys, as a decimal where a long may overflow: exact up to 38 digits, an error beyond (SQL's end at a BIGINT)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    wide, about = key.cast("decimal(20,0)"), key.cast("double") * key
    fits = F.greatest(about, F.abs(about * cust)) < 9e18
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(fits, key * key * cust).alias("short"), F.when(~fits, wide * wide * cust).alias("wide"))
    return rows.select("o_orderkey", F.coalesce(fmt_mem(F.col("short")), fmt_mem(F.col("wide"))).alias("size"))


@query("SELECT o_orderkey, (CASE WHEN o_custkey <= 1 THEN 1 ELSE 1::BIGINT << length(bin(o_custkey - 1)) END)::BIGINT AS pow2 FROM orders")
def next_pow2_sizes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", next_pow2(F.col("o_custkey")).cast("long").alias("pow2"))


@query(f"SELECT o_orderkey, ({mix64_sql('o_orderkey::UBIGINT')} >> 1)::BIGINT AS mixed FROM orders")
def mix64_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.shiftrightunsigned(mix64(F.col("o_orderkey")), 1).alias("mixed"))


@query("WITH d AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS other FROM documents) SELECT doc_id, text IS NOT DISTINCT FROM other AS same FROM d")
def payload_equal_neighbours(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = F.lag("text").over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.withColumn("other", other).select("doc_id", payload_equal(F.col("text"), F.col("other")).alias("same"))


@query(f"WITH {DOCS} SELECT key, weight FROM docs")
def entry_weight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), weight(F.col("text")).alias("weight"))


INTERVALS = f"{LOG}, c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_us, event_id) = 1 AS miss FROM log), w AS (SELECT ts_us // {DAY_US} AS interval, count(*) FILTER (NOT miss) AS hits, count(*) FILTER (miss) AS misses, coalesce(sum(weight) FILTER (miss), 0)::BIGINT AS bytes_loaded FROM c GROUP BY 1)"


@query(f"WITH {INTERVALS} SELECT interval, hits, misses, bytes_loaded FROM w")
def telemetry_window(spark, sf_dir):
    return telemetry.interval_counts(storage.classify_hits(event_log(spark, sf_dir)), DAY_US)


@query(f"WITH {INTERVALS}, x AS (SELECT interval, hits, lag(hits) OVER (ORDER BY interval) AS before FROM w) SELECT interval, hits, CASE WHEN before IS NULL OR hits < before THEN hits ELSE hits - before END AS hits_delta FROM x")
def telemetry_delta(spark, sf_dir):
    rows = telemetry.interval_counts(storage.classify_hits(event_log(spark, sf_dir)), DAY_US)
    return telemetry.counter_deltas(rows.select("interval", "hits"), "interval", ["hits"])


HALF_US = NOW_US - 15 * DAY_US
BATCHES = f"old AS (SELECT DISTINCT user_id FROM events WHERE epoch_us(ts) < {HALF_US})"


def loaded_users(missing: DataFrame) -> DataFrame:
    return missing.withColumn("payload", F.concat(F.lit("user-"), F.col("key").cast("string")))


@query(f"WITH {BATCHES} SELECT event_id, user_id AS key, 'user-' || user_id AS payload, CASE WHEN user_id IN (FROM old) THEN 'hit' ELSE 'miss_admitted' END AS outcome FROM events WHERE epoch_us(ts) >= {HALF_US}")
def cache_get_batches(spark, sf_dir):
    """Two batches of requests through one cache; the second one's answers."""
    cache, log = Cache(spark, CacheConfig()), event_log(spark, sf_dir).select("event_id", "key", "ts_us")
    cache.get(log.filter(F.col("ts_us") < HALF_US), loaded_users, HALF_US)
    return cache.get(log.filter(F.col("ts_us") >= HALF_US), loaded_users, NOW_US).select("event_id", "key", "payload", "outcome")


#: Few users have been seen by then.
EARLY_US = NOW_US - 30 * DAY_US + DAY_US // 8


@query(f"SELECT user_id AS key, 'user-' || user_id AS payload, {NOW_US}::BIGINT AS updated_us FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE epoch_us(ts) < {EARLY_US}))")
def cache_expire_removes(spark, sf_dir):
    """What a cache holds once the entries of the first of two batches have outlived their time."""
    cache, log = Cache(spark, CacheConfig(lifetime=LifetimeConfig(ttl_us=DAY_US))), event_log(spark, sf_dir).select("event_id", "key", "ts_us")
    cache.get(log.filter(F.col("ts_us") < EARLY_US), loaded_users, EARLY_US)
    cache.get(log.filter(F.col("ts_us") >= EARLY_US), loaded_users, NOW_US)
    cache.expire(NOW_US, seconds=3600)
    return cache.around().select("key", "payload", "updated_us")


EXPIRED = f"d AS (SELECT user_id AS key, {key_hash_sql('user_id')} & 1023 AS shard, max(epoch_us(ts)) AS updated_us FROM events GROUP BY user_id)"


@query(f"WITH {EXPIRED} SELECT shard::INT AS shard, arg_min(key, (updated_us, key)) AS key, count(*) AS expired FROM d WHERE {NOW_US} - updated_us > {TTL_US} GROUP BY shard")
def peek_expired(spark, sf_dir):
    rows = users(spark, sf_dir).withColumnRenamed("touched", "updated_us")
    old = expired(F.lit(NOW_US), F.col("updated_us"), F.lit(TTL_US))
    return lifetime.oldest_expired(rows.withColumn("expired", old))


LIFE = f"""{LOG}, held AS (SELECT DISTINCT key, 56 + length('user-' || key) AS weight FROM log), total AS (SELECT count(*) AS n, sum(weight) AS mem FROM held),
    odd AS (SELECT key, CASE WHEN key % 2 = 1 THEN 57 ELSE weight END AS weight FROM held), kept AS (SELECT * FROM odd WHERE key % 5 <> 0),
    run AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(weight) OVER () AS mem FROM kept),
    soft AS (SELECT * FROM run WHERE mem - freed <= 4000)"""


@query(f"""WITH {LIFE} SELECT 'get' AS step, n AS len, mem::BIGINT AS mem, 0::BIGINT AS scans, 0::BIGINT AS hits, 0::BIGINT AS items, 0::BIGINT AS bytes FROM total
    UNION ALL SELECT 'update', count(*), sum(weight)::BIGINT, 0, 0, 0, 0 FROM odd
    UNION ALL SELECT 'delete', count(*), sum(weight)::BIGINT, 0, 0, 0, 0 FROM kept
    UNION ALL SELECT 'force_call', (SELECT count(*) FROM soft), (SELECT coalesce(sum(weight), 0) FROM soft)::BIGINT, 1, (max(mem) > 4000)::BIGINT, count(*) - (SELECT count(*) FROM soft), (sum(weight) - (SELECT coalesce(sum(weight), 0) FROM soft))::BIGINT FROM run
    UNION ALL SELECT 'clear', 0, 0, 1, (max(mem) > 4000)::BIGINT, count(*) - (SELECT count(*) FROM soft), (sum(weight) - (SELECT coalesce(sum(weight), 0) FROM soft))::BIGINT FROM run""")
def cache_lifecycle(spark, sf_dir):
    """Length, weight and the evictor's counters of a cache after each step of its life; entries of one batch go by key."""
    cache = Cache(spark, CacheConfig(db=DbConfig(size_bytes=1 << 40), eviction=EvictionConfig(mode="sampling", soft_limit_coefficient=4000 / (1 << 40))))
    keys = event_log(spark, sf_dir).select("key")
    rows = []

    def note(step: str) -> None:
        held = cache.metrics()["evictor"]
        rows.append((step, cache.len(), cache.mem(), held["scans"], held["hits"], held["items"], held["bytes"]))

    cache.get(keys, loaded_users, NOW_US)
    note("get")
    cache.update(F.lit("x"), F.col("key") % 2 == 1)
    note("update")
    cache.delete(keys.filter("key % 5 = 0").distinct())
    note("delete")
    cache.force_call()
    note("force_call")
    cache.clear()
    note("clear")
    return spark.createDataFrame(rows, "step string, len long, mem long, scans long, hits long, items long, bytes long")


BATCH_KEYS = f"b1 AS (SELECT DISTINCT user_id AS key FROM events WHERE epoch_us(ts) < {EARLY_US}), b2 AS (SELECT DISTINCT user_id AS key FROM events WHERE epoch_us(ts) >= {EARLY_US})"


@query(f"WITH {BATCH_KEYS}, t AS (SELECT key FROM b1 ORDER BY key IN (SELECT key FROM b2) DESC, key LIMIT 20) SELECT key, CASE WHEN key IN (SELECT key FROM t) THEN 'again-' ELSE 'user-' END || key AS payload, (CASE WHEN key IN (SELECT key FROM b1) AND key NOT IN (SELECT key FROM t) THEN {EARLY_US} ELSE {NOW_US} END)::BIGINT AS updated_us FROM (SELECT key FROM b1 UNION SELECT key FROM b2)")
def cache_refresh(spark, sf_dir):
    """A cache after a round that loads expired entries again, within its rate: those that were touched since come first."""
    cache, log = Cache(spark, CacheConfig(lifetime=LifetimeConfig(on_ttl="refresh", ttl_us=DAY_US, rate=20))), event_log(spark, sf_dir).select("event_id", "key", "ts_us")
    cache.get(log.filter(F.col("ts_us") < EARLY_US), loaded_users, EARLY_US)
    cache.get(log.filter(F.col("ts_us") >= EARLY_US), loaded_users, NOW_US)
    cache.expire(NOW_US, lambda due: due.withColumn("payload", F.concat(F.lit("again-"), F.col("key").cast("string"))))
    return cache.around().select("key", "payload", "updated_us")


@query(f"""WITH {LIFE}, r AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(weight) OVER () AS mem FROM held), g AS (SELECT * FROM r WHERE mem - freed > 3000)
    SELECT (SELECT n FROM total) - count(*) AS len, ((SELECT mem FROM total) - coalesce(sum(weight), 0))::BIGINT AS mem, count(*) AS hard_items, coalesce(sum(weight), 0)::BIGINT AS hard_bytes FROM g""")
def cache_hard_limit(spark, sf_dir):
    """What stays of a batch that weighs more than the cache may hold, and the counters of the hard limit."""
    cache = Cache(spark, CacheConfig(db=DbConfig(size_bytes=3000), eviction=EvictionConfig(mode="sampling")))
    cache.get(event_log(spark, sf_dir).select("key"), loaded_users, NOW_US)
    held = cache.metrics()["cache"]
    return spark.createDataFrame([(cache.len(), cache.mem(), held["hard_items"], held["hard_bytes"])], "len long, mem long, hard_items long, hard_bytes long")


@query(f"WITH {DOCS} SELECT key, key % 5 = 0 AS is_queued FROM docs WHERE key % 3 = 0 ORDER BY key % 5 = 0 DESC, touched, key LIMIT 100")
def expired_queue_first(spark, sf_dir):
    rows = document_entries(spark, sf_dir).withColumn("expired", F.col("key") % 3 == 0).withColumn("is_queued", F.col("key") % 5 == 0).withColumn("updated_us", F.col("touched"))
    return lifetime.expired_first(rows, 100).select("key", "is_queued")


@query(f"SELECT event_id, {key_hash_sql('user_id')} AS hash, substr(md5(user_id::VARCHAR), 1, 16) AS upper, substr(md5(user_id::VARCHAR), 17, 16) AS lower, coalesce(user_id = lag(user_id) OVER (PARTITION BY {key_hash_sql('user_id')} & 63 ORDER BY event_id), false) AS same FROM events")
def key_identity(spark, sf_dir):
    """Each access's key in three parts, and whether the access before with the same last six bits of the hash has the same key."""
    log = hashed_log(spark, sf_dir).select("event_id", identity(F.col("key")).alias("own"), F.col("key_hash").bitwiseAND(63).alias("slot"))
    before = F.lag("own").over(Window.partitionBy("slot").orderBy("event_id"))
    return log.withColumn("before", before).select("event_id", "own.*", same_key(F.col("own"), F.col("before")).alias("same"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(text) ELSE doc_id::VARCHAR END AS key FROM documents")
def entry_keys(spark, sf_dir):
    """Entries without a key of their own have one made of their payload."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", entry_key(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id")), F.col("text")).alias("key"))


@query(f"SELECT event_id, (CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 3 = 1 THEN {DAY_US} * (user_id % 30) ELSE {TTL_US} END)::BIGINT AS ttl_us, CASE WHEN user_id % 3 = 0 THEN false WHEN user_id % 3 = 1 THEN user_id % 30 <> 0 AND {NOW_US} - epoch_us(ts) > {DAY_US} * (user_id % 30) ELSE {NOW_US} - epoch_us(ts) > {TTL_US} END AS expired FROM events")
def item_ttl(spark, sf_dir):
    """Times to live that loaders gave their own entries, 0 for ever, the configured one elsewhere."""
    own = F.when(F.col("key") % 3 == 0, F.lit(0).cast("long")).when(F.col("key") % 3 == 1, F.lit(DAY_US) * (F.col("key") % 30))
    rows = event_log(spark, sf_dir).withColumn("ttl_us", F.coalesce(own, F.lit(TTL_US)).cast("long"))
    return rows.select("event_id", "ttl_us", expired(F.lit(NOW_US), F.col("ts_us"), F.col("ttl_us")).alias("expired"))


TICKED = f"""{LOG}, t AS (SELECT *, ts_us // 3600000000 + 1 AS tick, sum(weight) OVER (ORDER BY ts_us, event_id) AS upto FROM log), u AS (SELECT tick, max(upto) AS upto FROM t GROUP BY tick),
    g AS (SELECT weight, (SELECT min(u.tick) FROM u WHERE u.upto > t.upto - t.weight + 20000) AS gone FROM t)"""


@query(f"WITH {TICKED} SELECT u.tick, 1 AS scans, (count(g.gone) > 0)::INT AS hits, count(g.gone) AS items, coalesce(sum(g.weight), 0)::BIGINT AS bytes FROM u LEFT JOIN g ON g.gone = u.tick GROUP BY u.tick")
def evictor_ticks(spark, sf_dir):
    """The evictor's counters hour by hour, every access being an insert."""
    inserts = event_log(spark, sf_dir).select(F.col("ts_us").alias("at_us"), F.col("event_id").alias("id"), "weight")
    return workers.evictor_ticks(inserts, 20_000, 3_600_000_000)


#: A busy log: 100,000 times as fast.
BUSY = "busy AS (SELECT event_id AS id, event_type AS lane, epoch_us(ts) // 100000 AS at_us FROM events)"


def busy_log(spark, sf_dir):
    return event_log(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("op").alias("lane"), F.floor(F.col("ts_us") / 100_000).alias("at_us"))


@query(f"WITH {BUSY}, n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY at_us, id) AS place FROM busy) SELECT id, lane, (max(at_us - place * 20000) OVER (PARTITION BY lane ORDER BY at_us, id) + place * 20000)::BIGINT AS served_us FROM n")
def paced_requests(spark, sf_dir):
    return workers.paced(busy_log(spark, sf_dir), 50, ["lane"]).select("id", "lane", "served_us")


@query(f"WITH {BUSY}, n AS (SELECT *, row_number() OVER (ORDER BY at_us, id) AS place FROM busy), s AS (SELECT max(at_us + 1000001 - place * 10000) OVER (ORDER BY at_us, id) + place * 10000 AS served FROM n) SELECT (served // 1000000)::BIGINT AS tick, 100::BIGINT AS scans, count(*) AS hits, 100 - count(*) AS misses, count(*) AS affected FROM s GROUP BY 1")
def lifetimer_ticks(spark, sf_dir):
    """The lifetime worker's counters second by second, with more entries due than its rate allows."""
    entries = busy_log(spark, sf_dir).select(F.col("id").alias("key"), F.col("at_us").alias("updated_us"))
    return workers.lifetimer_ticks(entries, 1_000_000, 100, 1_000_000)


QUEUE = f"""touched AS (SELECT ({key_hash_sql('user_id')} & 31)::INT AS shard, user_id AS key, min((epoch_us(ts), event_id)) AS seq FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
    queue AS (SELECT shard, key, row_number() OVER (PARTITION BY shard ORDER BY seq) AS place FROM touched)"""


def touch_queue(spark, sf_dir):
    touches = hashed_log(spark, sf_dir).select(F.col("key_hash").bitwiseAND(31).cast("int").alias("shard"), "key", "seq", (F.col("event_id") % 3 == 0).alias("expired"))
    return queues.enqueue_touched(touches, 4)


@query(f"WITH {QUEUE} SELECT shard, key, place <= 3 AS queued FROM queue")
def refresh_queue(spark, sf_dir):
    return touch_queue(spark, sf_dir).select("shard", "key", "queued")


@query(f"WITH {QUEUE}, looked AS (SELECT shard, key, (shard - 5 + 1024) % 1024 AS ahead, CASE WHEN key % 3 = 1 THEN 'gone' WHEN key % 4 = 0 THEN 'taken' ELSE 'fresh' END AS outcome FROM queue WHERE place = 1) SELECT shard, key, outcome FROM looked WHERE ahead <= (SELECT coalesce(min(ahead), 1024) FROM looked WHERE outcome = 'taken')")
def peek_by_queue(spark, sf_dir):
    entries = event_log(spark, sf_dir).select("key", (F.col("key") % 4 == 0).alias("expired")).distinct().filter("key % 3 <> 1")
    return queues.peek_queued(touch_queue(spark, sf_dir).filter("queued"), entries, 5)


@query(f"WITH {DOCS}, a AS (SELECT *, (shard - 1 + 1024) % 1024 AS ahead, {draw_sql('key', 1)} AS draw FROM docs), o AS (SELECT *, key % 7 = 0 AS expired, row_number() OVER w - 1 AS seen, coalesce(sum((key % 7 = 0)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found FROM a WHERE ahead < 512 WINDOW w AS (ORDER BY ahead, draw, key)) SELECT key, 100000 - touched AS updated_us FROM o WHERE seen < 512 AND found < 32 AND expired ORDER BY touched DESC, seen LIMIT 1")
def peek_by_sampling(spark, sf_dir):
    rows = document_entries(spark, sf_dir).withColumn("draw", storage.draw(F.col("key"), 1)).withColumn("expired", F.col("key") % 7 == 0).withColumn("updated_us", 100_000 - F.col("touched"))
    return queues.peek_sampled(rows, 1, 32)


@query(f"WITH {DOCS}, l AS (SELECT shard, min(key) AS last FROM docs WHERE weight > 3000 GROUP BY shard) SELECT d.shard, d.key FROM docs d LEFT JOIN l USING (shard) WHERE d.shard < 900 AND (l.last IS NULL OR d.key <= l.last)")
def around_early_stop(spark, sf_dir):
    """A scan by key that stops in each shard at the first large entry, and after 900 shards."""
    return queues.walk(document_entries(spark, sf_dir), F.col("key"), F.col("weight") > 3000, 900).select("shard", "key")


@query(f"WITH {LOG}, p AS (SELECT *, {key_hash_sql('key')} & 63 AS slot, first_value(key) OVER (PARTITION BY {key_hash_sql('key')} & 63 ORDER BY ts_us, event_id) AS owner, row_number() OVER (PARTITION BY {key_hash_sql('key')} & 63 ORDER BY ts_us, event_id) AS n FROM log) SELECT event_id, slot, owner, CASE WHEN key <> owner THEN 'collision' WHEN n = 1 THEN 'miss' ELSE 'hit' END AS outcome FROM p")
def lookup_collisions(spark, sf_dir):
    log = hashed_log(spark, sf_dir).withColumn("identity", F.md5(F.col("key").cast("string")))
    return queues.lookup_identity(log, 64).select("event_id", "slot", "owner", "outcome")


@query("WITH w AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, floor(l_quantity)::BIGINT % 3 AS payload, lag(floor(l_quantity)::BIGINT % 3) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS before FROM lineitem) SELECT key, l_orderkey, l_linenumber, CASE WHEN before IS NULL THEN 'insert' WHEN before = payload THEN 'touch' ELSE 'update' END AS decision, (before IS NULL)::INT AS len_delta, (payload - coalesce(before, -56))::BIGINT AS mem_delta FROM w")
def set_decisions(spark, sf_dir):
    """What each write does to a table without admission and limits."""
    writes = line_writes(spark, sf_dir).withColumn("payload", F.col("weight") % 3).withColumn("weight", F.col("payload") + 56)
    return queues.write_decisions(writes).select("key", "l_orderkey", "l_linenumber", "decision", "len_delta", "mem_delta")


@query("SELECT event_id, (epoch_us(ts) + event_id) - (epoch_us(ts) + event_id) % 10000 AS cached_us, epoch_us(ts) + event_id AS real_us FROM events")
def cached_clock(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("now", F.col("ts_us") + F.col("event_id"))
    return log.select("event_id", cached_time(F.col("now")).alias("cached_us"), cached_time(F.col("now"), enabled=False).alias("real_us"))


@query(f"SELECT o_orderkey, ({mix64_sql(mix64_sql('o_orderkey::UBIGINT'))} >> 11)::DOUBLE / 9007199254740992::DOUBLE AS drawn FROM orders")
def random_floats(spark, sf_dir):
    """The first draw of a stream seeded with each order's key."""
    return table(spark, sf_dir, "orders").select("o_orderkey", uniform(stream_seed(F.col("o_orderkey"))).alias("drawn"))


CHANGED = "concat(substr(text, 1, 9), 'X', substr(text, 11))"
HALVES = " , ".join(f"xor(xor({key_hash_sql(f'substr({h}, 1, 16)')}, {key_hash_sql(f'substr({h}, (n // 2) * 2 + 1, 16)')}), {key_hash_sql(f'substr({h}, 2 * n - 15, 16)')}) AS {h}x" for h in ("a", "b"))


@query(f"WITH h AS (SELECT doc_id, hex(encode(text)) AS a, hex(encode({CHANGED})) AS b, octet_length(encode(text)) AS n, octet_length(encode({CHANGED})) AS m FROM documents), x AS (SELECT *, {HALVES} FROM h) SELECT doc_id, CASE WHEN a IS NULL THEN b IS NULL WHEN n <> m THEN false WHEN n < 32 THEN a = b ELSE ax = bx END AS same FROM x")
def payload_sampled_equal(spark, sf_dir):
    """Texts against themselves with the tenth character changed, by length and three sampled blocks."""
    docs = table(spark, sf_dir, "documents")
    changed = F.concat(F.substring("text", 1, 9), F.lit("X"), F.expr("substring(text, 11)"))
    return docs.select("doc_id", payload_equal(F.col("text"), changed, sampled=True).alias("same"))


#: (size, coefficient in percent, mode, on_ttl, capacity, shards, least table, multiplier, bits)
CONFIGS = [(size, percent, mode, on_ttl, capacity, shards, least, multiplier, bits) for size in (1 << 20, 3_000_001) for percent in (50, 80) for mode, on_ttl in (("listing", "remove"), ("sampling", "refresh"), ("other", "other")) for capacity, shards, least, multiplier, bits in ((128, 4, 64, 3, 2), (10_000, 16, 64, 10, 3), (5, 8, 1, 0, 1))]
POW2 = "CASE WHEN {0} <= 1 THEN 1 ELSE 1::BIGINT << length(bin({0} - 1)) END"


@query(f"""WITH c(size, percent, mode, on_ttl, capacity, shards, least, multiplier, bits) AS (VALUES {', '.join(map(str, CONFIGS))}),
    t AS (SELECT *, greatest({POW2.format('greatest(1, capacity // shards)')}, least)::BIGINT AS table_len FROM c)
    SELECT size::BIGINT AS size, percent::BIGINT AS percent, mode, on_ttl, capacity::BIGINT AS capacity, (size * percent // 100)::BIGINT AS soft_limit, mode = 'listing' AS listing, on_ttl <> 'refresh' AS removes, table_len,
        ({POW2.format('greatest(1, table_len * bits)')})::BIGINT AS door_len, ((CASE WHEN multiplier = 0 THEN 10 ELSE multiplier END) * table_len)::BIGINT AS reset_at, true AS enabled FROM t""")
def config_derived(spark, sf_dir):
    """What is derived from configurations, and whether their parts are enabled."""
    rows = []
    for size, percent, mode, on_ttl, capacity, shards, least, multiplier, bits in CONFIGS:
        cfg = load_config({"db": {"size_bytes": size}, "admission": {"capacity": capacity, "shards": shards, "min_table": least, "sample_multiplier": multiplier, "door_bits": bits}, "eviction": {"mode": mode, "soft_limit_coefficient": percent / 100}, "lifetime": {"on_ttl": on_ttl}})
        a = cfg.admission
        rows.append((size, percent, mode, on_ttl, capacity, cfg.eviction.soft_limit_bytes, cfg.eviction.is_listing, cfg.lifetime.is_remove, a.table_len, a.door_len, a.reset_at, None not in (cfg.admission, cfg.eviction, cfg.lifetime)))
    return spark.createDataFrame(rows, "size long, percent long, mode string, on_ttl string, capacity long, soft_limit long, listing boolean, removes boolean, table_len long, door_len long, reset_at long, enabled boolean")


COUNTERS_OF = [f"{record}_{c}" for record, names in telemetry.RECORDS.items() for c in names]


def counter_sql(name: str, k: int) -> str:
    """A counter that falls now and then: the accesses of some keys, modulo a number; the hard evictor's rarely move."""
    return f"(sum(count(*) FILTER (user_id % {len(COUNTERS_OF)} = {k}{' AND event_id % 97 = 0' if name.startswith('hard') else ''})) OVER (ORDER BY epoch_us(ts) // {DAY_US}) * {1 if 'hard' in name else 1000 + k} % 100003)::BIGINT AS {name}"


FULL = load_config({"db": {"size_bytes": 1 << 30}, "admission": {}, "eviction": {}, "lifetime": {}})


def delta_sql(name: str) -> str:
    return f"CASE WHEN lag({name}) OVER w IS NULL OR {name} < lag({name}) OVER w THEN {name} ELSE {name} - lag({name}) OVER w END AS {name}"


def fields_sql(record: str) -> str:
    return " || ' ' || ".join(f"'{c}=' || {'(' + fmt_sql(f'{record}_{c}') + ')' if c.endswith('bytes') else f'{record}_{c}'}" for c in telemetry.RECORDS[record])


@query(f"""WITH s AS (SELECT epoch_us(ts) // {DAY_US} AS interval, sum(count(*)) OVER (ORDER BY epoch_us(ts) // {DAY_US})::BIGINT AS entries, {', '.join(counter_sql(n, k) for k, n in enumerate(COUNTERS_OF))} FROM events GROUP BY epoch_us(ts) // {DAY_US}),
    d AS (SELECT interval, entries, entries * 1000 AS mem, {', '.join(map(delta_sql, COUNTERS_OF))} FROM s WINDOW w AS (ORDER BY interval))
    {' UNION ALL '.join(f"SELECT interval, '{r}' AS record, {fields_sql(r)} AS fields FROM d" + (" WHERE hard_evictor_freed_items > 0 OR hard_evictor_freed_bytes > 0" if r == 'hard_evictor' else '') for r in telemetry.RECORDS)}
    UNION ALL SELECT interval, 'storage', 'size=' || ({fmt_sql('mem')}) || ' entries=' || entries || ' soft_limit=819MB 204KB hard_limit=1GB 0MB' FROM d""")
def telemetry_records(spark, sf_dir):
    """The log of a cache whose counters are made of the accesses of each day."""
    events = table(spark, sf_dir, "events").withColumn("interval", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY_US))
    rare = F.col("event_id") % 97 == 0
    mine = {n: (F.col("user_id") % len(COUNTERS_OF) == k) & (rare if n.startswith("hard") else F.lit(True)) for k, n in enumerate(COUNTERS_OF)}
    days = events.groupBy("interval").agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in mine.items()])
    upto = Window.orderBy("interval")  # one row a day
    snapshots = days.select("interval", F.sum("rows").over(upto).alias("entries"), *[(F.sum(n).over(upto) * (1 if "hard" in n else 1000 + k) % 100003).alias(n) for k, n in enumerate(COUNTERS_OF)])
    return telemetry.log_records(snapshots.withColumn("mem", F.col("entries") * 1000), FULL)


REPLAY = CacheConfig(db=DbConfig(size_bytes=4096), admission=ADMISSION, eviction=EvictionConfig())


@query()
def replay_full(spark, sf_dir):
    return replay.replay(hashed_log(spark, sf_dir), REPLAY, groups=1)


@query()
def replay_sharded(spark, sf_dir):
    return replay.replay(hashed_log(spark, sf_dir), REPLAY, groups=16, compat=True)


@query(ORACLES["ttl_fold"])
def stream_replay(spark, sf_dir):
    return drain_ttl_stream(spark, sf_dir, TTL_US, shared_folder(spark, "ttl"))
