"""Scalar tables and key functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cachelens.config import AdmissionConfig, CacheConfig, DbConfig, EvictionConfig, LifetimeConfig, adjusted, config_from_file, duration_us, load_config
from cachelens.functions.keys import mix64, next_pow2
from cachelens.functions.scalars import expired, expiry_probability, fmt_mem, payload_equal, weight
from cachelens.operators.replay import mixed


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_mix64_is_splitmix(spark):
    values = [0, 1, 12345, -1, 2**63 - 1, -(2**63)]
    got = column(spark, values, "long", mix64)
    assert [x % 2**64 for x in got] == [mixed(v % 2**64) for v in values]
    assert got[0] % 2**64 == 16294208416658607535 and got[2] % 2**64 == 2454886589211414944


def test_next_pow2(spark):
    table = {0: 1, 1: 1, 2: 2, 3: 4, 4: 4, 5: 8, 7: 8, 8: 8, 9: 16, 15: 16, 16: 16, 1000: 1024}
    assert column(spark, list(table), "long", next_pow2) == list(table.values())


def test_fmt_mem(spark):
    k, m, g = 1 << 10, 1 << 20, 1 << 30
    table = {512: "512B", 5 * k: "5KB 0B", 10 * m: "10MB 0KB", 2 * g: "2GB 0MB", g * k: "1TB 0GB", 1536: "1KB 512B", 10 * m + 512 * k: "10MB 512KB", 2 * g + 100 * m: "2GB 100MB"}
    assert column(spark, list(table), "long", fmt_mem) == list(table.values())


def test_fmt_mem_does_not_round_up(spark):
    t = 1 << 40
    assert column(spark, [(1 << 60) - 1, (1 << 63) - 1, 8193 * t - 1, None], "long", fmt_mem) == ["1048575TB 1023GB", "8388607TB 1023GB", "8192TB 1023GB", None]
    table = {1023: "1023B", t - 1: "1023GB 1023MB", (1 << 100) - 1: f"{(1 << 60) - 1}TB 1023GB", 10**38 - 1: f"{(10**38 - 1) // t}TB {(10**38 - 1) % t >> 30}GB"}
    assert column(spark, [Decimal(v) for v in table], "decimal(38,0)", fmt_mem) == list(table.values())


def test_payload_equality(spark):
    base = "x" * 100
    at = lambda k: base[:k] + "y" + base[k + 1 :]
    rows = spark.createDataFrame([(base, base), (base, at(50)), (base, at(20)), (base, "x"), (None, None), (None, "")], "a string, b string")
    got = rows.select(payload_equal(F.col("a"), F.col("b")), payload_equal(F.col("a"), F.col("b"), sampled=True)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, True), (False, False), (True, True), (False, False)]


def test_weight_and_expiry(spark):
    assert column(spark, ["", "é", None], "string", weight) == [56, 58, 56]
    assert column(spark, [10, 11, 20], "long", lambda now: expired(now, F.lit(0), F.lit(10))) == [False, True, True]
    assert column(spark, [10, 11], "long", lambda now: expired(now, F.lit(0), F.lit(0))) == [False, False]
    p = column(spark, [4, 5, 10], "long", lambda now: expiry_probability(now, F.lit(0), F.lit(10), 0.5, 0.5))
    assert p[0] == 0 and p[1] == pytest.approx(0.2212, abs=1e-4) and p[2] == pytest.approx(0.3935, abs=1e-4)


def test_configuration():
    cfg = load_config({"db": {"size_bytes": 1000}, "eviction": {"mode": "sampling"}, "lifetime": {"on_ttl": "other"}, "admission": None})
    assert cfg.eviction.soft_limit_bytes == 800 and not cfg.eviction.is_listing and cfg.lifetime.is_remove and cfg.admission is None
    assert not adjusted(CacheConfig(lifetime=LifetimeConfig(on_ttl="refresh"))).lifetime.is_remove
    a = AdmissionConfig()
    assert (a.table_len, a.reset_at, a.door_len) == (64, 192, 128)
    with pytest.raises(ValueError):
        AdmissionConfig(shards=3)
    with pytest.raises(ValueError):
        load_config({"compression": {}})
    assert adjusted(CacheConfig(db=DbConfig(size_bytes=10), eviction=EvictionConfig())).eviction.is_listing


def test_configuration_file(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "cache.yaml"
    path.write_text("db: {size: 1000, telemetry_logs_interval: 5s}\nadmission_control: {capacity: 128, shards: 4, min_table_len_per_shard: 64}\neviction: {mode: listing}\nlifetime: {on_ttl: refresh, ttl: 1h30m}\ncompression: {level: 1}\n")
    cfg = config_from_file(str(path))
    assert (cfg.db.size_bytes, cfg.db.telemetry_interval_us, cfg.eviction.soft_limit_bytes) == (1000, 5_000_000, 800)
    assert cfg.lifetime.ttl_us == 5_400_000_000 and not cfg.lifetime.is_remove and cfg.admission.table_len == 64
    assert duration_us("500ms") == 500_000 and duration_us(1000) == 1
    for text in ("db: 3", "- 1", "other: {}", "db: {other: 1}", "lifetime: {ttl: soon}", "a: [", "admission_control: {shards: 3}"):
        path.write_text(text)
        with pytest.raises(ValueError):
            config_from_file(str(path))
    with pytest.raises(FileNotFoundError):
        config_from_file(str(tmp_path / "none.yaml"))
