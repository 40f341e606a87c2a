"""Reproducible random numbers as Column expressions.

Every draw is a function of a seed and of the row's own keys, so that a recomputed task,
another partitioning or another engine gives the same number. The keyed SHA-256 also makes
draws unpredictable to anybody who does not hold the seed; with no seed given, one is taken
from system entropy.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from typing import Optional

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietgrove.functions import text

DRAW_BITS = 52
DRAW_SPAN = 1 << DRAW_BITS


def fresh_seed(seed: Optional[object] = None) -> str:
    return secrets.token_hex(32) if seed is None else str(seed)


def draw_sql(seed: object, *keys: str) -> str:
    """A 52-bit integer, uniform over [0, 2^52), as SQL text over SQL keys."""
    parts = "".join(f", coalesce(CAST({k} AS string), '')" for k in keys)
    digest = f"sha2(concat_ws('|', {text.literal(str(seed))}{parts}), 256)"
    return f"CAST(conv(substring({digest}, 1, {DRAW_BITS // 4}), 16, 10) AS bigint)"


def uniform_sql(seed: object, *keys: str) -> str:
    """Uniform in the open interval (0, 1), as SQL text."""
    return f"(({draw_sql(seed, *keys)} + 0.5D) / {float(DRAW_SPAN)!r}D)"


def draw_key(seed: object, *keys: str) -> Column:
    return F.expr(draw_sql(seed, *text.names(keys)))


def uniform(seed: object, *keys: str) -> Column:
    return F.expr(uniform_sql(seed, *text.names(keys)))


def driver_uniform(seed: object, *keys) -> float:
    """The value of ``uniform`` for literal keys, for the few draws made on the driver."""
    text = "|".join([str(seed), *[str(k) for k in keys]])
    digest = hashlib.sha256(text.encode()).hexdigest()
    return (int(digest[:DRAW_BITS // 4], 16) + 0.5) / DRAW_SPAN


def driver_laplace(scale: float, seed: object, *keys) -> float:
    return scale * (math.log(driver_uniform(seed, *keys, 1))
                    - math.log(driver_uniform(seed, *keys, 2)))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def laplace(u1: Column, u2: Column, scale) -> Column:
    """Laplace noise as the difference of two exponentials."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return scale * (F.log(u1) - F.log(u2))


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal (Box-Muller)."""
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def triangular(u: Column, lo: Column, mode: Column, hi: Column) -> Column:
    """Inverse distribution function of the triangular distribution."""
    cut = (mode - lo) / (hi - lo)
    rising = lo + F.sqrt(u * (hi - lo) * (mode - lo))
    falling = hi - F.sqrt((F.lit(1.0) - u) * (hi - lo) * (hi - mode))
    return F.when(u < cut, rising).otherwise(falling)
