"""Counter-based randomness: every draw is a hash of its seed, stream and number.

Results don't depend on partitions, retries or the order of work. The portable form
reads hexadecimal digits of MD5, which SQL engines and Python share; the fast form is
XXH64. ``*_of`` are the same draws in Python.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | int | str) -> Column:
    """The text that is hashed: parts joined by a bar. Strings that aren't columns are literals."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _digits(k: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(k.cast("binary")), 1, n), 16, 10)


def uniform(*parts: Column | int | str, fast: bool = False) -> Column:
    """A number strictly between 0 and 1."""
    if fast:
        return (F.shiftrightunsigned(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return (_digits(key(*parts), 13).cast("double") + 0.5) / F.lit(float(1 << 52))


def bucket(buckets: int, *parts: Column | int | str, fast: bool = False) -> Column:
    """A whole number from 0 below buckets."""
    if fast:
        return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(buckets)).cast("int")
    return F.pmod(_digits(key(*parts), 8).cast("long"), F.lit(buckets)).cast("int")


def _hex(parts: tuple) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def uniform_of(*parts: object) -> float:
    return (int(_hex(parts)[:13], 16) + 0.5) / (1 << 52)


def bucket_of(buckets: int, *parts: object) -> int:
    return int(_hex(parts)[:8], 16) % buckets


def gaussian_of(*parts: object) -> float:
    """A standard normal number, from two uniform ones."""
    return math.sqrt(-2 * math.log(uniform_of(*parts, "r"))) * math.cos(2 * math.pi * uniform_of(*parts, "a"))


def uniform_sql(text: str) -> str:
    """The portable uniform in DuckDB, of a SQL text expression."""
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"


def bucket_sql(buckets: int, text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 8))::BIGINT) % {buckets})::INT"
