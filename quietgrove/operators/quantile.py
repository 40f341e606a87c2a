"""Private order statistics and the feature scaling built on them.

The mechanism picks a gap between neighbouring values with probability proportional to its
width times exp(epsilon * utility / 2), and then a uniform point inside. Only gaps between
distinct values have a width, so a histogram of the values and its running counts are all it
needs; both are distributed.
"""

from __future__ import annotations

import math
from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import clamp
from quietgrove.functions.draws import fresh_seed, uniform_sql
from quietgrove.operators.histogram import ValueChunks, long_form
from quietgrove.operators.prefix import running_sums
from quietgrove.spec import Feature, Scaled


def bounds_of(percentile: float) -> tuple[float, float]:
    """Quantiles of a central interval: 95 gives 0.025 and 0.975."""
    tail = (1.0 - percentile / 100.0) / 2.0
    return tail, percentile / 100.0 + tail


def quantile_weights(df: DataFrame, cols: Sequence[str], percentile: float, eps: float,
                     lo: float, hi: float) -> DataFrame:
    """Every gap of every column with its log weight, for the lower (0) and upper (1) bound.

    Columns: feature_idx, side, gap (number of values at or below it), gap_lo, gap_hi,
    log_weight. Values are clamped to the public range [lo, hi], whose ends close the first
    and last gap. Each of the two bounds gets half the budget. Nulls are no values: a column's
    ranks count its other rows only, and a column without any has no gap.
    """
    lo, hi = float(lo), float(hi)
    features = [Feature(i, c) for i, c in enumerate(cols)]
    clamped = df.select(*[clamp(F.col(c).cast("double"), lo, hi).alias(c) for c in cols])
    present = clamped.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    hist = (long_form(clamped, features, []).where("value IS NOT NULL")
            .groupBy("feature_idx", "value").agg(F.count(F.lit(1)).alias("n")))
    chunks = ValueChunks.measure(clamped, features)
    ranked = running_sums(hist, ["feature_idx"], ["value"], ["n"], chunks.sql(), totals=False,
                          next_of="value")
    # One gap after each distinct value, plus the one before the first.
    gaps = ranked.selectExpr(
        "feature_idx",
        "inline(CASE WHEN before_n = 0 THEN array("
        f"struct(0L AS gap, {text.literal(lo)} AS gap_lo, value AS gap_hi), "
        f"struct(n AS gap, value AS gap_lo, coalesce(next_value, {text.literal(hi)}) AS gap_hi)) "
        "ELSE array(struct(before_n + n AS gap, value AS gap_lo, "
        f"coalesce(next_value, {text.literal(hi)}) AS gap_hi)) END)")
    half = text.literal(eps / 2.0)

    def target(q: float) -> str:
        return text.case([(f"feature_idx = {i}", f"{math.floor((present[i] - 1) * q + 1.5)}L")
                          for i in range(len(cols))])

    sides = ", ".join(f"struct({s} AS side, {target(q)} AS target)"
                      for s, q in enumerate(bounds_of(percentile)))
    utility = "(CASE WHEN gap < target THEN gap + 1 - target ELSE target - gap END)"
    return (gaps.where("gap_hi > gap_lo").selectExpr("*", f"inline(array({sides}))")
            .selectExpr("feature_idx", "side", "gap", "gap_lo", "gap_hi",
                        f"ln(gap_hi - gap_lo) + {half} * {utility} / 2 AS log_weight"))


def dp_quantile_interval(df: DataFrame, cols: Sequence[str], percentile: float, eps: float,
                         lo: float, hi: float, seed=None) -> DataFrame:
    """Private lower and upper percentile bound per column: (column, lower, upper)."""
    seed = fresh_seed(seed)
    weights = quantile_weights(df, cols, percentile, eps, lo, hi)
    u = uniform_sql(f"{seed}|gap", "feature_idx", "side", "gap")
    inside = uniform_sql(f"{seed}|point", "feature_idx", "side")
    drawn = (weights.selectExpr("*", f"log_weight - ln(-ln({u})) AS noisy")
             .groupBy("feature_idx", "side")
             .agg(F.max_by(F.struct("gap_lo", "gap_hi"), "noisy").alias("g"))
             .selectExpr("feature_idx", "side", f"g.gap_lo + (g.gap_hi - g.gap_lo) * {inside} AS b"))
    label = text.case([(f"feature_idx = {i}", text.literal(c)) for i, c in enumerate(cols)])
    both = drawn.groupBy("feature_idx").agg(
        F.expr("min(b)").alias("lower"), F.expr("max(b)").alias("upper"))
    return both.selectExpr(f"{label} AS column", "lower", "upper")


def scale_features_private(df: DataFrame, cols: Sequence[str], percentile: float, eps: float,
                           borders: tuple[float, float], lo: float, hi: float, seed=None,
                           bounds: Optional[Mapping[str, tuple[float, float]]] = None
                           ) -> DataFrame:
    """Clip each column to private percentile bounds (or to given ones) and map it onto
    ``borders``. The budget ``eps`` is spent once per column."""
    if bounds is None:
        maps = fit_scaling(df, cols, percentile, eps, borders, dict.fromkeys(cols, (lo, hi)), seed)
    else:
        maps = {c: Scaled(*bounds[c], *borders) for c in cols}
    return apply_scaling(df, maps)


def fit_scaling(df: DataFrame, cols: Sequence[str], percentile: float, eps: float,
                borders: tuple[float, float], limits: Mapping[str, tuple[float, float]], seed=None
                ) -> dict[str, Scaled]:
    """Maps of the columns onto ``borders`` from private percentile bounds, ``eps`` for each column.

    ``limits`` are the columns' public ranges; a column without a value keeps its range.
    Columns of one range share their jobs.
    """
    seed, bounds = fresh_seed(seed), dict(limits)
    ranges: dict = {}
    for c in cols:
        ranges.setdefault(limits[c], []).append(c)
    for (lo, hi), group in ranges.items():
        key = seed if len(ranges) == 1 else f"{seed}|{cols.index(group[0])}"
        for r in dp_quantile_interval(df, group, percentile, eps, lo, hi, key).collect():
            bounds[r["column"]] = (r["lower"], r["upper"])
    return {c: Scaled(*(float(b) for b in (*bounds[c], *borders))) for c in cols}


def apply_scaling(df: DataFrame, maps: Mapping[str, Scaled]) -> DataFrame:
    """The columns replaced by their mapped values."""
    return df.withColumns({c: F.expr(m.sql(text.name(c))) for c, m in maps.items()})
