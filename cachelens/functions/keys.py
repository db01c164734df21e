"""Key hashes, shard routing and 64-bit mixing as native column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 1024
# The public SplitMix64 constants.
INCREMENT, MULTIPLIER_1, MULTIPLIER_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def key_hash(key: Column) -> Column:
    """A hash below 2**60 that other engines compute as well: the first 15 hex digits of the MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long")


def identity(key: Column) -> Column:
    """What tells keys with one hash apart: (hash, upper, lower), 64 bits of the MD5 in either half."""
    digest = F.md5(key.cast("string"))
    return F.struct(key_hash(key).alias("hash"), F.substring(digest, 1, 16).alias("upper"), F.substring(digest, 17, 16).alias("lower"))


def same_key(a: Column, b: Column) -> Column:
    """Whether two identities are the same in all three parts; a missing one is no key."""
    return F.coalesce(a == b, F.lit(False))


def entry_key(key: Column, payload: Column) -> Column:
    """An entry's key, or one made of its payload where it has none."""
    return F.coalesce(key.cast("string"), F.md5(payload))


def shard_of(hashed: Column, shards: int = SHARDS) -> Column:
    """The shard by the hash's low bits."""
    return hashed.bitwiseAND(F.lit(shards - 1)).cast("int")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def wrapping_add(a: Column, b: int) -> Column:
    """a + b modulo 2**64, by halves, so that no addition overflows."""
    lo = low(a, 32) + F.lit(b & 0xFFFFFFFF)
    hi = F.shiftrightunsigned(a, 32) + F.lit(b >> 32) + F.shiftrightunsigned(lo, 32)
    return F.shiftleft(low(hi, 32), 32).bitwiseOR(low(lo, 32))


def wrapping_multiply(a: Column, b: int) -> Column:
    """a * b modulo 2**64, by limbs of 22, 22 and 20 bits, so that no product overflows."""
    a0, a1, a2 = low(a, 22), low(F.shiftrightunsigned(a, 22), 22), F.shiftrightunsigned(a, 44)
    b0, b1, b2 = b & 0x3FFFFF, b >> 22 & 0x3FFFFF, b >> 44
    p0 = a0 * b0
    p1 = a0 * b1 + a1 * b0 + F.shiftrightunsigned(p0, 22)
    p2 = a0 * b2 + a1 * b1 + a2 * b0 + F.shiftrightunsigned(p1, 22)
    return F.shiftleft(low(p2, 20), 44).bitwiseOR(F.shiftleft(low(p1, 22), 22)).bitwiseOR(low(p0, 22))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though ``use`` names it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mix64(x: Column) -> Column:
    """SplitMix64's step on a signed 64-bit pattern."""
    step = once(x.cast("long"), lambda v: wrapping_add(v, INCREMENT))
    step = once(step, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 30)))
    step = once(step, lambda v: wrapping_multiply(v, MULTIPLIER_1))
    step = once(step, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 27)))
    step = once(step, lambda v: wrapping_multiply(v, MULTIPLIER_2))
    return once(step, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, 31)))


def mix64_words(x: np.ndarray) -> np.ndarray:
    """The same step on an array of 64-bit words."""
    x = x + np.uint64(INCREMENT)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIER_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIER_2)
    return x ^ (x >> np.uint64(31))


def next_pow2(x: Column) -> Column:
    """The least power of two that isn't below x; 1 for x <= 1."""
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(x - 1))))


# The same in SQL for DuckDB.


def key_hash_sql(key: str) -> str:
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 15))::BIGINT"


def mix64_sql(x: str) -> str:
    """``x`` and the result are UBIGINT."""
    size = "18446744073709551616::UHUGEINT"

    def let(value: str, body: str) -> str:
        return f"list_transform([{value}], lambda v: {body})[1]"

    def times(v: str, b: int) -> str:
        return f"((({v})::UHUGEINT * {b & 0xFFFFFFFF}::UHUGEINT + (({v})::UHUGEINT * {b >> 32}::UHUGEINT) % 4294967296::UHUGEINT * 4294967296::UHUGEINT) % {size})::UBIGINT"

    step = f"(({x}::UHUGEINT + {INCREMENT}::UHUGEINT) % {size})::UBIGINT"
    step = let(step, times("xor(v, v >> 30)", MULTIPLIER_1))
    step = let(step, times("xor(v, v >> 27)", MULTIPLIER_2))
    return let(step, "xor(v, v >> 31)")
