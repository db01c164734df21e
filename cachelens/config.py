"""Configuration of the cache whose workload is analysed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from pathlib import Path

try:
    import yaml
except ImportError:  # only files need it
    yaml = None


@dataclass(frozen=True)
class DbConfig:
    size_bytes: int = 1 << 30
    telemetry_logs: bool = False
    telemetry_interval_us: int = 5_000_000
    cached_time: bool = True


@dataclass(frozen=True)
class AdmissionConfig:
    capacity: int = 128
    shards: int = 4
    min_table: int = 64
    sample_multiplier: int = 3
    door_bits: int = 2

    def __post_init__(self):
        if self.shards < 1 or self.shards & (self.shards - 1):
            raise ValueError("shards must be a power of two")
        if self.min_table < 1 or self.min_table & (self.min_table - 1):
            raise ValueError("min_table must be a power of two")

    @property
    def table_len(self) -> int:
        """Counters of a shard: a power of two."""
        wanted = max(1, self.capacity // self.shards)
        return max(1 << (wanted - 1).bit_length(), self.min_table)

    @property
    def door_len(self) -> int:
        """Bits of a shard's doorkeeper: a power of two."""
        wanted = max(1, self.table_len * self.door_bits)
        return 1 << (wanted - 1).bit_length()

    @property
    def reset_at(self) -> int:
        """Increments of a shard after which its counters are halved."""
        return (self.sample_multiplier or 10) * self.table_len


@dataclass(frozen=True)
class EvictionConfig:
    mode: str = "listing"
    soft_limit_coefficient: float = 0.8
    calls_per_sec: int = 5
    backoff_spins: int = 2048
    soft_limit_bytes: int = 0  # derived
    is_listing: bool = True  # derived


@dataclass(frozen=True)
class LifetimeConfig:
    on_ttl: str = "remove"
    ttl_us: int = 6 * 3600 * 1_000_000
    rate: int = 1000
    beta: float = 0.5
    coefficient: float = 0.5
    stochastic: bool = False
    is_remove: bool = True  # derived


@dataclass(frozen=True)
class CacheConfig:
    """None disables a part: everything is admitted, nothing is evicted, nothing expires."""

    db: DbConfig = field(default_factory=DbConfig)
    admission: AdmissionConfig | None = None
    eviction: EvictionConfig | None = None
    lifetime: LifetimeConfig | None = None


def adjusted(cfg: CacheConfig) -> CacheConfig:
    """``cfg`` with the derived fields; any on_ttl but "refresh" means removal."""
    if cfg.eviction is not None:
        soft = int(cfg.db.size_bytes * cfg.eviction.soft_limit_coefficient)
        cfg = replace(cfg, eviction=replace(cfg.eviction, soft_limit_bytes=soft, is_listing=cfg.eviction.mode == "listing"))
    if cfg.lifetime is not None:
        cfg = replace(cfg, lifetime=replace(cfg.lifetime, is_remove=cfg.lifetime.on_ttl != "refresh"))
    return cfg


def load_config(spec: dict) -> CacheConfig:
    """The adjusted configuration of a parsed file: sections db, admission, eviction, lifetime."""
    parts = {"db": DbConfig, "admission": AdmissionConfig, "eviction": EvictionConfig, "lifetime": LifetimeConfig}
    unknown = set(spec) - set(parts)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return adjusted(CacheConfig(**{k: parts[k](**v) for k, v in spec.items() if v is not None}))


# The sections and keys of a configuration file, and what they are called here.
FILE_KEYS = {
    "db": ("db", {"size": "size_bytes", "stat_logs_enabled": "telemetry_logs", "telemetry_logs_interval": "telemetry_interval_us", "cache_time_enabled": "cached_time"}),
    "admission_control": ("admission", {"capacity": "capacity", "shards": "shards", "min_table_len_per_shard": "min_table", "sample_multiplier": "sample_multiplier", "door_bits_per_counter": "door_bits"}),
    "eviction": ("eviction", {"mode": "mode", "soft_limit_coefficient": "soft_limit_coefficient", "calls_per_sec": "calls_per_sec", "backoff_spins_per_call": "backoff_spins"}),
    "lifetime": ("lifetime", {"on_ttl": "on_ttl", "ttl": "ttl_us", "rate": "rate", "coefficient": "coefficient", "beta": "beta", "stochastic_refresh_enabled": "stochastic"}),
}
MICROSECONDS = {"ns": 0.001, "us": 1, "ms": 1000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}


def duration_us(value: str | int) -> int:
    """Microseconds of a duration such as "24h", "1m30s" or "500ms"; a number counts nanoseconds."""
    if isinstance(value, int):
        return value // 1000
    if not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ns|us|ms|s|m|h))+", value):
        raise ValueError(f"not a duration: {value!r}")
    return round(sum(float(n) * MICROSECONDS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", value)))


def config_from_file(path: str) -> CacheConfig:
    """The adjusted configuration of a YAML file. A missing section disables its part; compression is read by nothing.

    Raises FileNotFoundError for no file, OSError for an unreadable one and ValueError for one that isn't such a file.
    """
    if yaml is None:
        raise RuntimeError("configuration files need the yaml package; load_config takes a dict")
    text = Path(path).read_text(encoding="utf-8")
    try:
        parsed = yaml.safe_load(text) or {}
        if not isinstance(parsed, dict):
            raise ValueError("no sections")
        spec = {}
        for section, values in parsed.items():
            if section == "compression" or values is None:
                continue
            name, keys = FILE_KEYS[section]
            spec[name] = {keys[k]: duration_us(v) if keys[k].endswith("_us") else v for k, v in values.items()}
        return load_config(spec)
    except (yaml.YAMLError, KeyError, TypeError, AttributeError, ValueError) as e:
        raise ValueError(f"{path} isn't a configuration: {e}") from e
