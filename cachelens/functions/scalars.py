"""Weights, payload equality, byte sizes and expiry as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import INCREMENT, key_hash, mix64

#: Bytes that an entry takes besides its payload.
ENTRY_BYTES = 56


def weight(payload: Column) -> Column:
    """Entry bytes plus payload bytes; a null payload has none."""
    return (F.lit(ENTRY_BYTES) + F.coalesce(F.octet_length(payload), F.lit(0))).cast("long")


def fmt_mem(size: Column) -> Column:
    """A byte count in its two largest units of 1024, as in "1KB 512B"; a whole number, also a decimal without fraction.

    The remainder goes before a division: a quotient as double or decimal would be rounded up just below a whole one.
    """
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.concat(size.cast("string"), F.lit("B"))
    for k in range(1, 5):
        big, small = 1 << 10 * k, 1 << 10 * (k - 1)
        rest = (size % F.lit(big)).cast("long")
        parts = F.concat(F.floor((size - rest) / F.lit(big)).cast("string"), F.lit(units[k] + " "), F.floor(rest / F.lit(small)).cast("string"), F.lit(units[k - 1]))
        out = F.when(size >= big, parts).otherwise(out)
    return out


def payload_equal(a: Column, b: Column, sampled: bool = False) -> Column:
    """Whether payloads are equal; two nulls are.

    ``sampled`` compares long ones (32 bytes or more) by their length and the hashes of the first, middle and last 8 bytes,
    combined by exclusive or, so that blocks may change places.
    """
    a, b = a.cast("binary"), b.cast("binary")
    if not sampled:
        return a.eqNullSafe(b)
    size = F.octet_length(a)

    def blocks(x: Column) -> Column:
        hashed = [key_hash(F.hex(F.substring(x, at, F.lit(8)))) for at in (F.lit(1), F.floor(size / 2).cast("int") + 1, size - 7)]
        return hashed[0].bitwiseXOR(hashed[1]).bitwiseXOR(hashed[2])

    same = F.when(size != F.octet_length(b), False).when(size < 32, a == b).otherwise(blocks(a) == blocks(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def cached_time(ts_us: Column, enabled: bool = True, tick_us: int = 10_000) -> Column:
    """The time that a clock shows which is set every ``tick_us``; the time itself if it isn't enabled."""
    return (ts_us - F.pmod(ts_us, F.lit(tick_us))) if enabled else ts_us


def uniform(seed: Column) -> Column:
    """The first number in [0, 1) of a SplitMix64 stream: its upper 53 bits."""
    return F.shiftrightunsigned(mix64(seed), 11) / F.lit(float(1 << 53))


def stream_seed(seed: Column) -> Column:
    """The state that a stream starts from: the mixed seed, never 0."""
    mixed = mix64(seed)
    return F.when(mixed == 0, F.lit(INCREMENT - (1 << 64))).otherwise(mixed)


def expired(now_us: Column, updated_us: Column, ttl_us: Column) -> Column:
    """Deterministic expiry: strictly older than its time to live; a ttl of 0 never expires."""
    return (ttl_us != 0) & (now_us - updated_us > ttl_us)


def expiry_probability(now_us: Column, updated_us: Column, ttl_us: Column, beta: float, coefficient: float) -> Column:
    """Chance of stochastic expiry: none before ttl * coefficient, then 1 - exp(-beta * elapsed / ttl)."""
    elapsed = (now_us - updated_us).cast("double")
    due = (ttl_us != 0) & (elapsed >= F.floor(ttl_us * F.lit(coefficient)))
    return F.when(due, 1 - F.exp(-F.lit(beta) * elapsed / ttl_us)).otherwise(0.0)


def probably_expired(now_us: Column, updated_us: Column, ttl_us: Column, beta: float, coefficient: float, seed: int) -> Column:
    """A seeded draw of stochastic expiry."""
    return F.rand(seed) < expiry_probability(now_us, updated_us, ttl_us, beta, coefficient)
