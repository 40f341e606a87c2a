"""Small Column helpers."""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Doubles of this size and above are integers.
EXACT_INTEGERS = 2.0 ** 53


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(value, lo, hi) -> Column:
    """``value`` limited to [lo, hi]; null stays null."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    value = as_col(value)
    return F.when(value.isNotNull(), F.greatest(lo, F.least(value, hi)))


def sigmoid(value) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(value)))


def floor_to(value: Column, digits: int) -> Column:
    """Round down to ``digits`` decimals, staying a double.

    Numbers so large that a double holds no such decimals stay as they are.
    """
    scale = float(10 ** digits)
    fits = F.abs(value) * F.lit(scale) < F.lit(EXACT_INTEGERS)
    floored = F.floor(F.when(fits, value * F.lit(scale))).cast("double") / F.lit(scale)
    return F.when(fits, floored).otherwise(value)


def choose(cases: Sequence[tuple[Column, Column]], otherwise: Optional[Column] = None) -> Column:
    """CASE over (condition, value) pairs."""
    if not cases:
        return otherwise if otherwise is not None else F.lit(None)
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def mapped(value, mapping: Mapping, default=None) -> Column:
    """Fixed value mapping; values outside the mapping become ``default``."""
    value = as_col(value)
    return choose([(value == F.lit(k), F.lit(v)) for k, v in mapping.items()], F.lit(default))


def tuple_less(cols: Sequence[Column], cut: Sequence) -> Column:
    """Lexicographic ``cols < cut`` against literal values; a shorter cut compares only the
    leading columns."""
    head, value = cols[0], F.lit(cut[0])
    if len(cut) == 1:
        return head < value
    return (head < value) | ((head == value) & tuple_less(cols[1:], cut[1:]))


def interval_index(cols: Sequence, cuts: Sequence[Sequence]) -> Column:
    """Number of ascending ``cuts`` that are <= the key tuple, by binary search."""
    cols = [as_col(c) for c in cols]

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(tuple_less(cols, cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))
