"""Row splits: train/test, folds, shuffles, set membership and per-tree row allotments.

Sizes are exact. Which rows go where is decided by comparing a row's order key with a few
cut keys (see ``ranking.position_cuts``), so no operator here shuffles the rows.
"""

from __future__ import annotations

import math
from typing import Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions.columns import clamp, interval_index, tuple_less
from quietgrove.functions.draws import draw_key, fresh_seed
from quietgrove.operators.ranking import global_rank, order_exprs, position_cuts

DRAW = "_draw"


def _ordered(df: DataFrame, key: str, shuffle: bool, seed) -> tuple[DataFrame, list[str]]:
    """The order of the rows: by id, or by a seeded draw with the id as tie-break."""
    if not shuffle:
        return df, [key]
    return df.withColumn(DRAW, draw_key(fresh_seed(seed), key)), [DRAW, key]


def shuffle(df: DataFrame, seed, key: str = "row_id", position: Optional[str] = None
            ) -> DataFrame:
    """Rows in random order. The order is that of a seeded draw per row, so it does not
    depend on the partitioning; the sort is a range exchange. ``position`` adds the row's
    place in the new order."""
    drawn = df.withColumn(DRAW, draw_key(fresh_seed(seed), key))
    if position is not None:
        return global_rank(drawn, [DRAW, key], position).drop(DRAW)
    return drawn.orderBy(DRAW, key).drop(DRAW)


def train_test_split(df: DataFrame, train_ratio: float, key: str, shuffle: bool = True,
                     seed=None) -> DataFrame:
    """Add ``is_test``: the first ceil((1 - r) n) rows are test rows."""
    if train_ratio >= 1:
        return df.withColumn("is_test", F.lit(False))
    if train_ratio <= 0:
        return df.withColumn("is_test", F.lit(True))
    return mark_first(df, lambda n: math.ceil((1 - train_ratio) * n), key, shuffle, seed)


def mark_first(df: DataFrame, count: Callable[[int], int], key: str, shuffle: bool = True,
               seed=None, name: str = "is_test") -> DataFrame:
    """Flag the first ``count(n)`` of n rows."""
    ordered, cols = _ordered(df, key, shuffle, seed)
    _, cuts = position_cuts(ordered, cols,
                            lambda n: [min(count(n), n) - 1] if min(count(n), n) > 0 else [])
    flag = ~_greater(order_exprs(ordered, cols), cuts[0]) if cuts else F.lit(False)
    return ordered.withColumn(name, flag).drop(DRAW)


def _greater(cols: Sequence[Column], cut) -> Column:
    equal = F.lit(True)
    for c, v in zip(cols, cut):
        equal = equal & (c == F.lit(v))
    return ~tuple_less(cols, cut) & ~equal


def fold_starts(n: int, k: int) -> list[int]:
    """First position of folds 1 .. k-1: blocks of n // k, the first n mod k one larger."""
    size, extra = divmod(n, k)
    return [f * size + min(f, extra) for f in range(1, k)]


def kfold(df: DataFrame, k: int, key: str, shuffle: bool = True, seed=None) -> DataFrame:
    """Add ``fold`` in 0 .. k-1; train on ``fold <> f``, test on ``fold = f``."""
    ordered, cols = _ordered(df, key, shuffle, seed)
    n, cuts = position_cuts(ordered, cols, lambda n: [s for s in fold_starts(n, k) if s < n])
    fold = interval_index(order_exprs(ordered, cols), cuts)
    return ordered.withColumn("fold", fold).drop(DRAW)


def subset(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Keep the rows whose id is listed."""
    return df.join(ids.select(key), key, "left_semi")


def remove_rows(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Drop the rows whose id is listed."""
    return df.join(ids.select(key), key, "left_anti")


def balanced_quotas(n: int, trees: int) -> list[int]:
    """Rows per tree when tree t takes floor(unused / (trees - t))."""
    out, unused = [], n
    for t in range(trees):
        out.append(unused // (trees - t))
        unused -= out[-1]
    return out


def geometric_quotas(n: int, trees: int, eta: float) -> list[int]:
    """Rows per tree when shares shrink by 1 - eta; cut at the first tree without rows."""
    out = []
    for t in range(trees):
        q = int(n * eta * math.pow(1 - eta, t) / (1 - math.pow(1 - eta, trees)))
        if q == 0:
            break
        out.append(q)
    return out


def allot(df: DataFrame, quotas, key: str, shuffle: bool = True, seed=None,
          name: str = "tree_id") -> tuple[DataFrame, list[int]]:
    """Cut the order into consecutive, hence disjoint, blocks of ``quotas(n)`` rows each.
    Rows left over get a null. Returns the table and the block sizes."""
    ordered, cols = _ordered(df, key, shuffle, seed)
    sizes: list[int] = []

    def starts(n):
        sizes.extend(quotas(n))
        ends = [sum(sizes[:t + 1]) for t in range(len(sizes))]
        return [e for e in ends if e < n]

    n, cuts = position_cuts(ordered, cols, starts)
    block = interval_index(order_exprs(ordered, cols), cuts)
    if sum(sizes) < n:
        block = F.when(block < len(sizes), block)
    return ordered.withColumn(name, block.cast("int")).drop(DRAW), sizes


def partition_balanced(df: DataFrame, trees: int, seed=None, key: str = "row_id",
                       shuffle: bool = True) -> DataFrame:
    """Disjoint rows per tree, in equal shares."""
    return allot(df, lambda n: balanced_quotas(n, trees), key, shuffle, seed)[0]


def partition_geometric(df: DataFrame, trees: int, eta: float, seed=None, key: str = "row_id",
                        shuffle: bool = True) -> DataFrame:
    """Disjoint rows per tree, in geometrically shrinking shares."""
    return allot(df, lambda n: geometric_quotas(n, trees, eta), key, shuffle, seed)[0]


def gradient_filter(df: DataFrame, quota: Optional[int], l2: float, seed=None,
                    grad: str = "grad", key: str = "row_id", mode: str = "fill",
                    shuffle: bool = True, keep_all: bool = False,
                    order: Optional[Sequence[str]] = None) -> DataFrame:
    """Gradient-based choice of one tree's rows.

    fill  take rows with |g| <= l2 first, fill up with others; their g is clipped
    drop  take any rows, then leave out those with |g| > l2
    take  take any rows; their g is clipped
    clip  keep all rows, clip every g
    With ``keep_all`` the choice is returned as a ``selected`` flag instead of a filter.
    ``order`` names stored columns that already hold the random order.
    """
    clipped = clamp(grad, -float(l2), float(l2))
    if mode == "clip":
        return df.withColumn(grad, clipped)
    if mode not in ("fill", "drop", "take"):
        raise ValueError(f"unknown mode {mode}")
    ordered, cols = (df, list(order)) if order else _ordered(df, key, shuffle, seed)
    outside = F.abs(F.col(grad)) > F.lit(float(l2))
    if mode == "fill":
        ordered = ordered.withColumn("_outside", outside.cast("int"))
        cols = ["_outside", *cols]
    _, cuts = position_cuts(ordered, cols, lambda n: [min(quota, n) - 1] if min(quota, n) else [])
    taken = ~_greater(order_exprs(ordered, cols), cuts[0]) if cuts else F.lit(False)
    if mode == "drop":
        taken = taken & ~outside
    out = ordered.withColumn("selected", taken)
    if mode in ("fill", "take"):
        out = out.withColumn(grad, F.when(F.col("selected"), clipped).otherwise(F.col(grad)))
    out = out.drop("_outside") if order else out.drop(DRAW, "_outside")
    return out if keep_all else out.where("selected").drop("selected")
