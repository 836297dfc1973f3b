"""Keyed pseudo-random columns.

A sequential generator cannot survive partitioning, so every draw is a pure
function of (seed, draw number, record keys): retries and re-partitioning change
nothing.  The function is a digest, so draws of different seeds, numbers or keys
are unrelated, and keys may be of any size and sign.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal digits of the digest: 52 bits, exact in a double


def uniform(seed: int, event_id: Column, *keys: Column, draw: int = 0) -> Column:
    """Uniform in (0,1) from integer keys; the same in any engine with md5."""
    parts = [F.lit(str(seed)), F.lit(str(draw)), *(k.cast("long").cast("string") for k in (event_id, *keys))]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def gaussian(seed: int, event_id: Column, *keys: Column) -> Column:
    """Standard normal by Box-Muller on two draws of one seed."""
    u1, u2 = (uniform(seed, event_id, *keys, draw=d) for d in (0, 1))
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * F.pi() * u2)
