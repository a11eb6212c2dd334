"""Randomness that depends only on a seed and a row key.

``rand(seed)`` follows the partitioning of its input, so a retried task or another cluster
size gives other rows.  Everything here is a hash of ``seed`` and the row's own key, hence
the same under any partitioning and after any executor loss.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_HEX_DIGITS = 32  # of a row hash
HASH_BUCKET_HEX_DIGITS = 4
HASH_BUCKETS = 16**HASH_BUCKET_HEX_DIGITS

_UNIFORM_HEX_DIGITS = 13  # 52 bits, exact in a double
_UNIFORM_RANGE = float(16**_UNIFORM_HEX_DIGITS)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_hash(seed: int | str, *keys: Column | str) -> Column:
    """md5 of the seed and the row key: 32 hex digits, uniform and unique per key."""
    parts = [F.lit(str(seed))] + [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_bucket(hashed: Column | str, digits: int = HASH_BUCKET_HEX_DIGITS) -> Column:
    """Leading hex digits of a :func:`row_hash`; as text they keep the hash order."""
    return F.substring(_col(hashed), 1, digits)


def uniform01(seed: int | str, key: Column | str, stream: str = "") -> Column:
    """Uniform number in [0, 1) for a row key; ``stream`` separates independent draws."""
    return number_of(uniform_digits(seed, key, stream))


def uniform_digits(seed: int | str, key: Column | str, stream: str = "") -> Column:
    """The hex digits that :func:`uniform01` is made of, leading digit first; as text they keep its order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string"), F.lit(f":{stream}")))


def number_of(digits: Column) -> Column:
    leading = F.substring(digits, 1, _UNIFORM_HEX_DIGITS)
    return F.conv(leading, 16, 10).cast("bigint").cast("double") / F.lit(_UNIFORM_RANGE)


def digits_from(x: Column) -> Column:
    """Hex digits at or above which a uniform number is at least ``x`` (0 to 1); ``g`` is above all of them."""
    least = F.ceil(x * F.lit(_UNIFORM_RANGE)).cast("bigint")  # exact, as the range is a power of two
    return F.when(least < int(_UNIFORM_RANGE), F.lpad(F.lower(F.hex(least)), _UNIFORM_HEX_DIGITS, "0")).otherwise("g")


def gaussian01(seed: int | str, key: Column | str, stream: str = "") -> Column:
    """Standard normal number for a row key (Box-Muller on two uniforms)."""
    u1 = F.lit(1.0) - uniform01(seed, key, f"{stream}#r")
    u2 = uniform01(seed, key, f"{stream}#a")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def uniform_number(seed: int | str, key: object, stream: str = "") -> float:
    """:func:`uniform01` of one key, computed on the spot."""
    digest = hashlib.md5(f"{seed}:{key}:{stream}".encode()).hexdigest()
    return int(digest[:_UNIFORM_HEX_DIGITS], 16) / _UNIFORM_RANGE


def gaussian_number(seed: int | str, key: object, stream: str = "") -> float:
    """:func:`gaussian01` of one key, computed on the spot."""
    u1, u2 = 1.0 - uniform_number(seed, key, f"{stream}#r"), uniform_number(seed, key, f"{stream}#a")
    return math.sqrt(-2.0 * math.log(u1)) * math.cos(2.0 * math.pi * u2)
