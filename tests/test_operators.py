"""Set-based operators against the sequential model, and the model's own behaviour."""

import random

import pytest
from pyspark.sql import functions as F

from cachelens.config import AdmissionConfig, CacheConfig, DbConfig, EvictionConfig, LifetimeConfig
from cachelens.operators import admission, lifetime, queues, replay, storage, telemetry, workers
from cachelens.plans import catalogue
from cachelens.sources.tables import written

SMALL = AdmissionConfig(capacity=16, shards=2, min_table=8, sample_multiplier=3, door_bits=4)


def hashes(n, keys, seed):
    rng = random.Random(seed)
    pool = [rng.getrandbits(60) for _ in range(keys)]
    return [pool[min(rng.randrange(keys), rng.randrange(keys))] for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_sketch_equals_sequential(spark, seed):
    stream = hashes(400, 40, seed)
    model, seen = replay.Admitter(SMALL), []
    for h in stream:
        seen.append(model.seen(h))
        model.record(h)
    log = spark.createDataFrame(list(enumerate(stream)), "seq long, key_hash long")
    got = {r.seq: r.seen for r in admission.doorkeeper(log, SMALL).collect()}
    assert [got[i] for i in range(len(stream))] == seen
    table = {(r.shard, r.idx): r.counter for r in admission.counters(log, SMALL).collect()}
    for shard, counters in enumerate(model.table):
        assert counters == [table.get((shard, i), 0) for i in range(SMALL.table_len)]
    keys = sorted(set(stream))
    pairs = [(a, keys[0]) for a in keys] + [(12345, keys[0])]
    allowed = admission.allow(spark.createDataFrame(pairs, "candidate long, victim long"), log, SMALL).collect()
    assert {(r.candidate, r.allow) for r in allowed} == {(a, model.allow(a, b)) for a, b in pairs}


def test_sketch_advances_batch_by_batch(spark):
    stream = hashes(240, 30, 4)
    model, sketch = replay.Admitter(SMALL), admission.Sketch.empty(spark)
    for begin in range(0, 240, 60):
        log = spark.createDataFrame(list(enumerate(stream))[begin : begin + 60], "seq long, key_hash long")
        sketch = admission.advanced(log, sketch, SMALL)
        sketch = admission.Sketch(*(written(x, "sketch") for x in (sketch.bits, sketch.table, sketch.adds)))
        for h in stream[begin : begin + 60]:
            model.record(h)
        table = {(r.shard, r.idx): r.counter for r in sketch.table.collect()}
        assert [[table.get((s, i), 0) for i in range(SMALL.table_len)] for s in range(SMALL.shards)] == model.table
        assert {(r.shard, r.bit) for r in sketch.bits.collect()} == {(s, b) for s, d in enumerate(model.door) for b in d}
        adds = {r.shard: r.adds for r in sketch.adds.collect()}
        assert [adds.get(s, 0) for s in range(SMALL.shards)] == model.adds


def test_admitter_gates_and_ages():
    a = replay.Admitter(AdmissionConfig())
    found = []
    for _ in range(3):
        found.append(a.estimate(0x100))
        a.record(0x100)
    assert found == [0, 0, 1]
    b = replay.Admitter(AdmissionConfig())
    for _ in range(10):
        b.record(0x200)
    assert not b.allow(0x100, 0x200) and b.allow(0x100, 0x100)
    c = replay.Admitter(AdmissionConfig())
    for h, n in ((0x200, 2), (0x100, 50)):
        for _ in range(n):
            c.record(h)
    assert c.allow(0x100, 0x200)
    before = c.estimate(0x100)
    c.reset()
    assert c.estimate(0x100) == before // 2 and not c.seen(0x100)


def entries(spark, n, seed):
    rng = random.Random(seed)
    return [(k, rng.randrange(6), rng.randrange(1, 50), rng.randrange(1000)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_eviction_equals_round_robin(spark, seed):
    rows = entries(spark, 40, seed)
    df = spark.createDataFrame(rows, "key long, shard int, weight long, touched long")
    limit = sum(r[2] for r in rows) // 3
    got = {r.key for r in storage.evict_until(df, limit, start=1).collect()}
    queues = {s: sorted([r for r in rows if r[1] == s], key=lambda r: (r[3], r[0])) for s in range(1024)}
    mem, turn, gone = sum(r[2] for r in rows), 0, set()
    while mem > limit:
        turn = (turn + 1) % 1024
        if queues[turn]:
            r = queues[turn].pop(0)
            mem -= r[2]
            gone.add(r[0])
    assert got == gone
    oldest = {r.key for r in storage.evict_oldest_until(df, limit, buckets=7).collect()}
    mem, gone = sum(r[2] for r in rows), set()
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        if mem > limit:
            mem -= r[2]
            gone.add(r[0])
    assert oldest == gone
    assert not storage.evict_until(df, 10**9).collect() and not storage.evict_oldest_until(df.limit(0), 0).collect()


def test_recency(spark):
    df = spark.createDataFrame([(1, 0, 5, 10), (2, 0, 5, 20), (3, 0, 5, 30), (4, 1, 5, 5)], "key long, shard int, weight long, touched long")
    assert {r.key for r in storage.peek(df).collect()} == {1, 4}
    assert {r.key for r in storage.peek(df, most_recent=True).collect()} == {3, 4}
    assert {r.key for r in storage.peek(df, 2, where=F.col("key") == 2).collect()} == {2}
    assert {r.key for r in storage.pop_tail(df).collect()} == {2, 3}
    assert storage.victim_by_list(df, 1).first().key == 4 and storage.victim_by_list(df, 1018).first().key == 4
    assert storage.victim_by_list(df, 500).count() == 0
    assert storage.victim_by_sample(df, 0, 1, 8, 1).first().key == 1
    assert storage.shard_stats(df).filter("shard = 0").first()[1:] == (3, 15)


def test_get_or_compute_and_deltas(spark):
    requests = spark.createDataFrame([(1,), (1,), (2,), (3,)], "key long")
    known = spark.createDataFrame([(1, "a")], "key long, payload string")
    answers, loaded = storage.get_or_compute(requests, known, lambda m: m.withColumn("payload", F.when(F.col("key") == 2, "b")))
    assert sorted((r.key, r.payload, r.outcome) for r in answers.collect()) == [(1, "a", "hit"), (1, "a", "hit"), (2, "b", "miss_admitted"), (3, None, "miss_error")]
    assert [tuple(r) for r in loaded.collect()] == [(2, "b")]
    writes = spark.createDataFrame([(1, 1, 10), (1, 2, 4), (2, 3, 7)], "key long, seq long, weight long")
    assert sorted((r.key, r.len_delta, r.bytes_delta) for r in storage.write_deltas(writes).collect()) == [(1, 0, -6), (1, 1, 10), (2, 1, 7)]
    assert storage.last_wins(writes, "weight").filter("key = 1").first().weight == 4
    counters = spark.createDataFrame([(1, 5), (2, 9), (3, 2), (4, -1)], "t long, n long")
    assert [r.n_delta for r in telemetry.counter_deltas(counters, "t", ["n"]).orderBy("t").collect()] == [5, 4, 2, 0]


def test_ttl_fold_equals_model(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(1000), i, rng.randrange(4)) for i in range(200))
    log = spark.createDataFrame([(k, e, t) for t, e, k in rows], "key long, event_id long, ts_us long")
    cfg = CacheConfig(lifetime=LifetimeConfig(ttl_us=90))
    model = replay.CacheReplay(cfg, 1 << 40)
    expected = {e: model.access(k, 1, t)[0].replace("_admitted", "") for t, e, k in rows}
    assert {r.event_id: r.outcome for r in lifetime.ttl_fold(log, 90).collect()} == expected
    assert "stale_hit" in {r.outcome for r in lifetime.ttl_fold(log, 90, serve_stale=True).collect()}


def test_replay_limits(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(60), 0, i, i, 1024) for i in range(1500)]
    rows = [(k, k * 7919 + 13, e, t, w) for k, _, e, t, w in rows]
    log = spark.createDataFrame(rows, "key long, key_hash long, event_id long, ts_us long, weight long")
    cfg = CacheConfig(db=DbConfig(size_bytes=10 * 1024), admission=AdmissionConfig(), eviction=EvictionConfig())
    for compat in (False, True):
        got = replay.replay(log, cfg, compat=compat).collect()
        assert len(got) == 1500
        admitted = sum(r.outcome == "miss_admitted" for r in got)
        assert (admitted - sum(r.evicted_items for r in got)) * 1024 <= 12 * 1024
        assert any(r.outcome == "miss_rejected" for r in got) and any(r.outcome == "hit" for r in got)
    plain = replay.replay(log, CacheConfig(), groups=4).collect()
    assert sum(r.outcome == "miss_admitted" for r in plain) == len({r[0] for r in rows})


class PlainCache:
    """The replayed cache once more, from lists and scans: what happens on each access, in both modes."""

    def __init__(self, cfg, limit, compat):
        self.a, self.limit, self.compat = cfg.admission, limit, compat
        self.rows, self.iter, self.now = {}, 0, 0  # hash -> [weight, touched]
        self.bits = [[0] * self.a.door_len for _ in range(self.a.shards)]
        self.counts = [[0] * self.a.table_len for _ in range(self.a.shards)]
        self.adds = [0] * self.a.shards

    def chain(self, h, n, size):
        out = []
        for _ in range(n):
            out.append(h % size)
            z = (h + 0x9E3779B97F4A7C15) % 2**64
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            h = z ^ (z >> 31)
        return out

    def record(self, h):
        s, spots = h % self.a.shards, self.chain(h, 3, self.a.door_len)
        if not all(self.bits[s][k] for k in spots):
            for k in spots:
                self.bits[s][k] = 1
            return
        if self.adds[s] >= self.a.reset_at:
            self.counts[s], self.adds[s] = [c // 2 for c in self.counts[s]], 0
        for k in self.chain(h, 4, self.a.table_len):
            self.counts[s][k] = min(15, self.counts[s][k] + 1)
        self.adds[s] += 1

    def estimate(self, h):
        return min(self.counts[h % self.a.shards][k] for k in self.chain(h, 4, self.a.table_len))

    def mem(self):
        return sum(w for w, _ in self.rows.values())

    def tail(self, shard):
        return min(((t, h) for h, (_, t) in self.rows.items() if h % 1024 == shard), default=None)

    def evict(self, limit, spins):
        items = freed = 0
        while self.rows:
            done = self.mem() <= limit
            if self.compat and (spins == 0 or done and freed <= 8 * 2**20) or not self.compat and done:
                break
            spins -= 1
            if self.compat:
                self.iter += 1
                found = self.tail(self.iter % 1024)
            else:
                found = min((t, h) for h, (_, t) in self.rows.items())
            if found:
                freed += self.rows.pop(found[1])[0]
                items += 1
        return items, freed

    def access(self, h, weight):
        self.now += 1
        if not self.compat or h not in self.rows:
            self.record(h)
        if h in self.rows:
            self.rows[h][1] = self.now
            return "hit", 0, 0
        over = self.mem() + (0 if self.compat else weight) > self.limit
        if self.rows and (self.compat or over):
            if self.compat:
                tails = [self.tail((self.iter + k) % 1024) for k in range(8)]
                self.iter += 1
                victim = min((t for t in tails if t), default=None, key=lambda t: t[0])
            else:
                victim = min((t, h) for h, (_, t) in self.rows.items())
            seen = all(self.bits[h % self.a.shards][k] for k in self.chain(h, 3, self.a.door_len))
            if victim is None or not (victim[1] == h or seen and self.estimate(h) > self.estimate(victim[1])):
                return "miss_rejected", 0, 0
        items, freed = self.evict(self.limit - (0 if self.compat else weight), 32) if over else (0, 0)
        self.rows[h] = [weight, self.now]
        return "miss_admitted", items, freed


@pytest.mark.parametrize("compat, weight", [(False, 1024), (True, 1024), (True, 3 << 20)])
def test_replay_equals_a_plain_model(spark, compat, weight):
    rng = random.Random(9)
    keys = [min(rng.randrange(40), rng.randrange(40)) for _ in range(1200)]
    rows = [(k, k * 7919 + 13 if weight == 1024 else k % 4 + 1024 * k, i, i, weight + k) for i, k in enumerate(keys)]
    log = spark.createDataFrame(rows, "key long, key_hash long, event_id long, ts_us long, weight long")
    cfg = CacheConfig(db=DbConfig(size_bytes=10 * weight), admission=SMALL, eviction=EvictionConfig())
    model = PlainCache(cfg, 10 * weight, compat)
    expected = [model.access(h, w) for _, h, _, _, w in rows]
    got = replay.replay(log, cfg, compat=compat).orderBy("event_id").collect()
    assert [(r.outcome, r.evicted_items, r.evicted_bytes) for r in got] == expected
    assert {x[0] for x in expected} == {"hit", "miss_admitted", "miss_rejected"}


def test_evictor_and_lifetimer_ticks_equal_loops(spark, monkeypatch):
    rng = random.Random(4)
    rows = sorted((rng.randrange(50_000), i, rng.randrange(1, 60)) for i in range(400))
    monkeypatch.setattr(workers, "BUCKET_US", 700)
    monkeypatch.setattr(workers, "BUCKET_BYTES", 500)
    inserts = spark.createDataFrame([(a, i, w) for a, i, w in rows], "at_us long, id long, weight long")
    held, expected = [], {}
    for tick in range(1, 52):
        new = [w for a, _, w in rows if a // 1000 + 1 == tick]
        held += new
        items = freed = 0
        hit = sum(held) > 300
        while sum(held) > 300:
            freed += held.pop(0)
            items += 1
        if new:
            expected[tick] = (1, int(hit), items, freed)
    assert {r.tick: (r.scans, r.hits, r["items"], r.bytes) for r in workers.evictor_ticks(inserts, 300, 1000).collect()} == expected
    free, served = 0, {}
    for a, i, _ in rows:
        free = max(free, a)
        served[i] = free
        free += 200
    assert {r.id: r.served_us for r in workers.paced(inserts, 5000).collect()} == served
    ticks = workers.lifetimer_ticks(inserts.select(F.col("id").alias("key"), F.col("at_us").alias("updated_us")), 10, 5000, 1000).collect()
    assert sum(r.hits for r in ticks) == 400 and all(r.hits <= r.scans == 5 for r in ticks) and workers.tokens_buffer(5) == 1 and workers.tokens_buffer(50) == 5


def test_sampled_eviction(spark):
    rows = entries(spark, 300, 5)
    df = spark.createDataFrame([(k, (k * 37) % 1024, w, t) for k, _, w, t in rows], "key long, shard int, weight long, touched long")
    total = sum(r[2] for r in rows)
    gone = storage.evict_sampled_until(df, total // 3, rounds=4096).collect()
    assert total - sum(r.weight for r in gone) <= total // 3 < total - sum(r.weight for r in gone) + max(r.weight for r in gone)
    assert len({r.key for r in gone}) == len(gone) and not storage.evict_sampled_until(df, total, rounds=10).collect()
    assert len(storage.evict_sampled_until(df, 0, rounds=20).collect()) <= 20


def test_queues_and_walks(spark):
    pushes = spark.createDataFrame([(0, k, k) for k in range(5)] + [(1, 9, 1)], "shard int, key long, seq long")
    assert {r.key for r in queues.ring(pushes, 4).filter("pushed").collect()} == {0, 1, 2, 9}
    assert queues.ring(pushes, 0).filter("pushed AND shard = 0").count() == 1  # two places at least
    known = spark.createDataFrame([(0, False), (9, True)], "key long, expired boolean")
    assert {(r.key, r.outcome) for r in queues.peek_queued(pushes, known, 0).collect()} == {(0, "fresh"), (9, "taken")}
    assert {(r.key, r.outcome) for r in queues.peek_queued(pushes, known, 1).collect()} == {(9, "taken")}
    assert {(r.key, r.outcome) for r in queues.peek_queued(pushes, known.limit(0), 1).collect()} == {(0, "gone"), (9, "gone")}
    assert {r.key for r in queues.walk(pushes, F.col("key"), F.col("key") == 2).collect()} == {0, 1, 2, 9}
    assert {r.key for r in queues.walk(pushes, F.col("key"), F.lit(None).cast("boolean"), 1).collect()} == {0, 1, 2, 3, 4}


def test_reuse_distance(spark):
    stream = [1, 2, 3, 1, 1, 2, 4, 3, 1]
    log = spark.createDataFrame([(k, i) for i, k in enumerate(stream)], "key long, seq long")
    got = {r.seq: r.distance for r in storage.reuse_distance(log, F.lit(0)).collect()}
    assert got == {3: 2, 4: 0, 5: 2, 7: 3, 8: 3}


def brute_distances(stream):
    last, out = {}, {}
    for i, k in enumerate(stream):
        if k in last:
            out[i] = len(set(stream[last[k] + 1 : i]))
        last[k] = i
    return out


@pytest.mark.parametrize("piece", [4, 1 << 16])
def test_reuse_distance_in_runs_and_pieces(spark, piece):
    rng = random.Random(3)
    stream = [min(rng.randrange(25), rng.randrange(25)) for _ in range(300)]
    log = spark.createDataFrame([(k, i) for i, k in enumerate(stream)], "key long, seq long")
    got = storage.reuse_distance(log, F.lit(0), run=F.floor(F.col("seq") / 37), piece=piece).collect()
    assert {r.seq: r.distance for r in got} == brute_distances(stream) and len(got) == len(brute_distances(stream))


def test_reuse_distance_crosses_midnight(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.user_id, r.event_id) for r in spark.read.parquet(f"{data}/events.parquet").orderBy("ts", "event_id").collect()]
    expected = {rows[i][1]: d for i, d in brute_distances([k for k, _ in rows]).items()}
    got = catalogue.QUERIES["lru_reuse_distance"](spark, data).collect()
    assert {r.event_id: r.distance for r in got} == expected and len(got) == len(rows) - len({k for k, _ in rows})
    hits = {r.capacity: r.hits for r in catalogue.QUERIES["lru_hit_by_capacity"](spark, data).collect()}
    assert hits == {c: sum(d < c for d in expected.values()) for c in (5, 10, 20, 50)}
