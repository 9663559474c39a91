"""FNV-1a of 64 bits as column expressions, in two lanes of 32 bits so that no product overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset basis by lanes, the low part of the prime (2**40 + 435).
OFFSET_HIGH, OFFSET_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
MASK = (1 << 32) - 1


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as an array of longs; empty for an empty text."""
    pairs = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8")), F.lit("(..)"), 1)
    return F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("long"))


def fnv1a_lanes(text: Column, seed: str = "") -> Column:
    """struct(hi, lo). A seed follows the text behind a zero byte."""
    data = _bytes(text)
    if seed:
        data = F.concat(data, F.array(*[F.lit(b).cast("long") for b in b"\0" + seed.encode()]))
    long = lambda v: F.lit(v).cast("long")
    start = F.struct(long(OFFSET_HIGH).alias("hi"), long(OFFSET_LOW).alias("lo"))

    def step(h: Column, b: Column) -> Column:
        x = h["lo"].bitwiseXOR(b)
        high = h["hi"] * PRIME_LOW + F.shiftleft(x, 8) + F.shiftright(x * PRIME_LOW, 32)
        return F.struct(high.bitwiseAND(long(MASK)).alias("hi"), (x * PRIME_LOW).bitwiseAND(long(MASK)).alias("lo"))

    return F.aggregate(data, start, step)


def fnv1a_mod(text: Column, modulus: int, seed: str = "") -> Column:
    """The unsigned hash modulo a number below 2**15."""
    return F.transform(F.array(fnv1a_lanes(text, seed)), lambda h: ((h["hi"] % modulus) * ((1 << 32) % modulus) + h["lo"] % modulus) % modulus)[0]


def fnv1a(data: bytes) -> int:
    """The same on the driver, for single values."""
    h = OFFSET_HIGH << 32 | OFFSET_LOW
    for b in data:
        h = (h ^ b) * ((1 << 40) + PRIME_LOW) & ((1 << 64) - 1)
    return h
