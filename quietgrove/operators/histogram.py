"""Split candidates and their gains, from histograms.

Rows are turned into (group, feature, value) counts and gradient sums with map-side partial
aggregation; every candidate's left and right sums then come from running sums over the
histogram. The cost is one pass over the rows plus work per distinct value.

A histogram has the columns ``by`` + feature_idx, value (numeric features), category (text
features), n, g and optionally h.
"""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import EXACT_INTEGERS, choose
from quietgrove.operators.prefix import (chunk_bounds, chunk_of, distinct_counts,
                                         running_sums)
from quietgrove.spec import Feature, Grid

GAIN_DIGITS = 10
CANDIDATE = ["feature_idx", "value", "category"]


def long_form(df: DataFrame, features: Sequence[Feature], keep: Sequence[str],
              packed: Optional[str] = None) -> DataFrame:
    """One row per (row, feature): ``keep`` + feature_idx, value, category.

    ``packed`` names an array column that holds all features, as numbers and in order; the
    rows then have no category.
    """
    if packed:
        return df.selectExpr(*text.names(keep), f"posexplode({packed}) AS (feature_idx, value)")
    parts = []
    for f in features:
        col = text.name(f.name)
        number = "CAST(NULL AS double)" if f.text else f"CAST({col} AS double)"
        parts.append(f"{f.index}, {number}, {col if f.text else 'CAST(NULL AS string)'}")
    return df.selectExpr(*text.names(keep), f"stack({len(features)}, {', '.join(parts)}) "
                         f"AS ({', '.join(CANDIDATE)})")


def _grouped(long: DataFrame, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Sums per group and value; packed rows get their (empty) category afterwards."""
    if "category" in long.columns:
        return long.groupBy(*by, *CANDIDATE).agg(*aggs)
    keys = [*by, *CANDIDATE[:2]]
    sums = long.groupBy(*keys).agg(*aggs)
    rest = [c for c in sums.columns if c not in keys]
    return sums.selectExpr(*text.names(keys), "CAST(NULL AS string) AS category",
                           *text.names(rest))


def _sums(grad: str, hess: Optional[str]) -> list[Column]:
    out = [F.expr("count(1) AS n"), F.expr(f"sum({text.name(grad)}) AS g")]
    return out + [F.expr(f"sum({text.name(hess)}) AS h")] if hess else out


def candidates_distinct(df: DataFrame, features: Sequence[Feature], by: Sequence[str] = (),
                        grad: str = "grad", hess: Optional[str] = None,
                        packed: Optional[str] = None) -> DataFrame:
    """Every distinct value of every feature in each group, with row count and sums."""
    keep = [*by, grad] + ([hess] if hess else [])
    return _grouped(long_form(df, features, keep, packed), by, _sums(grad, hess))


def grid_index(value: Column, grid: Grid) -> Column:
    """Largest i with lo + i * step <= value; -1 below the grid, capped at its last point."""
    lo, step = F.lit(float(grid.lo)), F.lit(float(grid.step))
    i = F.floor((value - lo) / step)
    # The division may land one off next to a grid point: compare with the points themselves.
    i = F.when(value < lo + i * step, i - 1).when(value >= lo + (i + 1) * step, i + 1).otherwise(i)
    return F.least(F.greatest(i, F.lit(-1)), F.lit(grid.size - 1)).cast("int")


def candidates_grid(df: DataFrame, features: Sequence[Feature], grid: Grid,
                    by: Sequence[str] = (), grad: str = "grad", hess: Optional[str] = None
                    ) -> DataFrame:
    """Grid points lo + i * step of every numeric feature in each group, present or not.

    ``n`` and ``g`` belong to the cell that starts at the point. Rows below the grid are in a
    cell of their own, with ``value`` null: they count towards every left side, but are no
    candidate.
    """
    numeric = [f for f in features if not f.is_cat]
    cells = (long_form(df, numeric, [*by, grad] + ([hess] if hess else []))
             .groupBy(*by, "feature_idx", grid_index(F.col("value"), grid).alias("cell"))
             .agg(*_sums(grad, hess)))
    points = F.explode(F.sequence(F.lit(-1), F.lit(grid.size - 1)))
    dense = cells.select(*by, "feature_idx").distinct().select(*by, "feature_idx",
                                                               points.alias("cell"))
    value = F.when(F.col("cell") >= 0, F.lit(float(grid.lo)) + F.col("cell") * float(grid.step))
    return _filled(dense.join(cells, [*by, "feature_idx", "cell"], "left"), hess).select(
        *by, "feature_idx", value.alias("value"), F.lit(None).cast("string").alias("category"),
        *_measures(hess))


def candidates_packed_grid(df: DataFrame, features: Sequence[Feature], grid: Grid, packed: str,
                           by: Sequence[str] = (), grad: str = "grad", hess: Optional[str] = None
                           ) -> DataFrame:
    """``candidates_grid`` of the numeric features and ``candidates_distinct`` of the others, from an
    array that holds all features in order.

    One pass turns each value into its cell, so map-side sums leave a row per task and cell. The
    points without rows are then filled in from each cell up to the next: that needs a row's
    neighbour only, in the partitioning that running sums need anyway.
    """
    lo, step, size = text.literal(float(grid.lo)), text.literal(float(grid.step)), grid.size

    def cell(f: Feature) -> str:
        x = f"get({packed}, {f.index})"
        if f.is_cat:
            return x
        i = f"floor(({x} - {lo}) / {step})"
        exact = (f"CASE WHEN {x} < {lo} + {i} * {step} THEN {i} - 1 WHEN {x} >= {lo} + ({i} + 1) * {step} "
                 f"THEN {i} + 1 ELSE {i} END")
        return f"CAST(least(greatest({exact}, -1), {size - 1}) AS double)"

    sums = _measures(hess)
    keep = [*by, grad] + ([hess] if hess else [])
    listed = ", ".join(cell(f) for f in features)
    cells = (df.selectExpr(*text.names(keep), f"posexplode(array({listed})) AS (feature_idx, cell)")
             .groupBy(*by, "feature_idx", "cell").agg(*_sums(grad, hess)))
    numeric = f"feature_idx IN ({', '.join(str(f.index) for f in features if not f.is_cat) or '-1'})"
    keys = text.names([*by, "feature_idx"])
    window = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY cell)"
    near = cells.selectExpr("*", f"lead(cell) {window} AS _next", f"lag(cell) {window} AS _last")
    points = (f"CASE WHEN {numeric} THEN transform(sequence(CASE WHEN _last IS NULL THEN least(CAST(cell AS int), 0) "
              f"ELSE CAST(cell AS int) END, coalesce(CAST(_next AS int), {size}) - 1), p -> CAST(p AS double)) "
              "ELSE array(cell) END")
    spread = near.selectExpr("*", f"explode({points}) AS _point")
    value = f"CASE WHEN NOT {numeric} THEN _point WHEN _point >= 0 THEN {lo} + _point * {step} END"
    zeros = {"n": "0L", "g": "0.0D", "h": "0.0D"}
    return spread.selectExpr(*keys, f"{value} AS value", "CAST(NULL AS string) AS category",
                             *[f"CASE WHEN _point = cell THEN {s} ELSE {zeros[s]} END AS {s}" for s in sums])


def candidates_declared(df: DataFrame, features: Sequence[Feature], categories: Mapping,
                        by: Sequence[str] = (), grad: str = "grad",
                        hess: Optional[str] = None) -> DataFrame:
    """Declared categories of every categorical feature in each group, present or not.

    ``categories`` maps feature names to lists; an int n stands for codes 0 .. n-1.
    """
    cat = [f for f in features if f.is_cat and f.name in categories]
    here = {f.index: F.col("feature_idx") == f.index for f in cat}
    known = choose([(here[f.index], F.col("category" if f.text else "value")
                     .isin([c if f.text else float(c) for c in _declared(categories[f.name])]))
                    for f in cat])
    present = (candidates_distinct(df, cat, by, grad, hess)
               .withColumn("_known", known)
               .groupBy(*by, "feature_idx", F.when(F.col("_known"), F.col("value")).alias("value"),
                        F.when(F.col("_known"), F.col("category")).alias("category"))
               .agg(*[F.sum(m).alias(m) for m in _measures(hess)]))
    # The extra null entry holds rows of undeclared categories: counted, but no candidate.
    declared = choose([
        (here[f.index],
         F.array(*[F.struct(F.lit(None if f.text or c is None else float(c)).cast("double")
                            .alias("value"),
                            F.lit(c if f.text else None).cast("string").alias("category"))
                   for c in [None, *_declared(categories[f.name])]])) for f in cat])
    dense = present.select(*by, "feature_idx").distinct().select(
        *by, "feature_idx", F.inline(declared))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*by, *CANDIDATE]]
    keep = [F.col(f"d.{c}").alias(c) for c in [*by, *CANDIDATE]]
    joined = dense.alias("d").join(present.alias("p"), same, "left")
    measured = [F.col(f"p.{m}").alias(m) for m in _measures(hess)]
    return _filled(joined.select(*keep, *measured), hess)


def _declared(given) -> list:
    return list(range(given)) if isinstance(given, int) else list(given)


def _measures(hess) -> list[str]:
    return ["n", "g"] + (["h"] if hess else [])


def _filled(df: DataFrame, hess) -> DataFrame:
    out = df.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    for m in _measures(hess)[1:]:
        out = out.withColumn(m, F.coalesce(m, F.lit(0.0)))
    return out


class ValueChunks:
    """How the value range of each feature is cut for the running sums; ``None`` boundaries
    everywhere mean that each (group, feature) fits one window."""

    def __init__(self, features: Sequence[Feature], bounds: Mapping[str, Sequence[float]],
                 text_chunks: Mapping[str, int]):
        self.features, self.bounds, self.text_chunks = features, bounds, text_chunks

    @classmethod
    def measure(cls, df: DataFrame, features: Sequence[Feature],
                counts: Optional[Mapping[str, int]] = None,
                rows_per_chunk: int = 500_000) -> "ValueChunks":
        """``counts`` are approximate distinct counts, if already known."""
        if counts is None:
            counts = distinct_counts(df, [f.name for f in features])[1]
        bounds = chunk_bounds(df, {f.name: counts[f.name] for f in features if not f.text},
                              rows_per_chunk)
        texts = {f.name: int(counts[f.name] // rows_per_chunk) for f in features if f.text}
        return cls(features, bounds, {c: n + 1 for c, n in texts.items() if n})

    def sql(self) -> Optional[str]:
        cases = []
        for f in self.features:
            here = f"feature_idx = {f.index}"
            if self.bounds.get(f.name):
                cases.append((here, chunk_of("value", self.bounds[f.name])))
            elif self.text_chunks.get(f.name):
                # Order is irrelevant for categories; only the totals need the chunks.
                parts = f"CAST(pmod(xxhash64(category), {self.text_chunks[f.name]}) AS int)"
                cases.append((here, parts))
        return text.case(cases, "0") if cases else None


def _is_cat(features: Sequence[Feature]) -> str:
    cat = [str(f.index) for f in features if f.is_cat]
    return f"feature_idx IN ({', '.join(cat)})" if cat else "false"


def gain_sql(g_left: str, n_left: str, g_right: str, n_right: str, l2_lambda: float,
             floor_digits: bool = False) -> str:
    """GL^2 / (nL + lambda) + GR^2 / (nR + lambda), not below 0."""
    lam = text.literal(float(l2_lambda))
    gain = f"{g_left} * {g_left} / ({n_left} + {lam}) + {g_right} * {g_right} / ({n_right} + {lam})"
    if floor_digits:
        scale = text.literal(float(10 ** GAIN_DIGITS))
        fits = f"({gain}) * {scale} < {text.literal(EXACT_INTEGERS)}"
        floored = f"CAST(floor(CASE WHEN {fits} THEN ({gain}) * {scale} END) AS double) / {scale}"
        gain = f"CASE WHEN {fits} THEN {floored} ELSE {gain} END"
    return f"greatest({gain}, 0.0D)"


def split_gain(hist: DataFrame, features: Sequence[Feature], l2_lambda: float,
               by: Sequence[str] = (), chunks: Optional[ValueChunks] = None,
               floor_digits: bool = False) -> DataFrame:
    """Gain of every candidate: left is ``<`` the value for numeric features and ``=`` for
    categorical ones. Candidates with an empty side are left out."""
    sums = [c for c in ("n", "g", "h") if c in hist.columns]
    chunk = chunks.sql() if chunks else None
    wide = running_sums(hist, [*by, "feature_idx"], ["value", "category"], sums, chunk)
    is_cat = _is_cat(features)
    left = {s: f"CASE WHEN {is_cat} THEN {s} ELSE before_{s} END" for s in sums}
    cols = [*text.names([*by, *CANDIDATE]), *[f"{left[s]} AS {s}_left" for s in sums],
            *[f"total_{s} - {left[s]} AS {s}_right" for s in sums]]
    # A null value with a null category is the cell below a grid: no candidate.
    sides = wide.where("value IS NOT NULL OR category IS NOT NULL").selectExpr(*cols)
    return sides.where("n_left > 0 AND n_right > 0").selectExpr(
        "*", gain_sql("g_left", "n_left", "g_right", "n_right", l2_lambda, floor_digits)
        + " AS gain")


def sibling_gain(df: DataFrame, features: Sequence[Feature], l2_lambda: float,
                 parent: str = "parent_id", side: str = "side", by: Sequence[str] = (),
                 grad: str = "grad", chunks: Optional[ValueChunks] = None,
                 floor_digits: bool = False, packed: Optional[str] = None) -> DataFrame:
    """Gains pooled over siblings: a candidate must occur in a node and split its own rows,
    but its gain counts the rows of the node and of its sibling (``side`` 0 or 1).

    One histogram per parent serves both children.
    """
    hist = sibling_histogram(df, features, parent, side, by, grad, packed)
    return sibling_gain_of(hist, features, l2_lambda, parent, side, by, chunks, floor_digits)


def sibling_histogram(df: DataFrame, features: Sequence[Feature], parent: str = "parent_id",
                      side: str = "side", by: Sequence[str] = (), grad: str = "grad",
                      packed: Optional[str] = None) -> DataFrame:
    """Distinct values below each parent: sums of both children, of each, and where they occur."""
    g, side_of = text.name(grad), text.name(side)
    own = [F.expr("count(1) AS n"), F.expr(f"sum({g}) AS g")]
    for s in (0, 1):
        own += [F.expr(f"count(CASE WHEN {side_of} = {s} THEN 1 END) AS n{s}"),
                F.expr(f"sum(CASE WHEN {side_of} = {s} THEN {g} ELSE 0.0D END) AS g{s}")]
    found = _grouped(long_form(df, features, [*by, parent, side, grad], packed),
                     [*by, parent], own)
    return found.selectExpr("*", "n0 > 0 AS in0", "n1 > 0 AS in1")


def pooled_siblings(hist: DataFrame, parent: str = "parent_id", side: str = "side",
                    by: Sequence[str] = ()) -> DataFrame:
    """The same from a histogram by parent and side whose candidates do not depend on the rows:
    grid points and declared values are candidates of both children."""
    own = [F.sum("n").alias("n"), F.sum("g").alias("g")]
    for s in (0, 1):
        here = F.col(side) == s
        own += [F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n{s}"),
                F.coalesce(F.sum(F.when(here, F.col("g"))), F.lit(0.0)).alias(f"g{s}")]
    found = hist.groupBy(*by, parent, *CANDIDATE).agg(*own)
    return found.selectExpr("*", "true AS in0", "true AS in1")


def sibling_gain_of(hist: DataFrame, features: Sequence[Feature], l2_lambda: float,
                    parent: str = "parent_id", side: str = "side", by: Sequence[str] = (),
                    chunks: Optional[ValueChunks] = None, floor_digits: bool = False) -> DataFrame:
    """``sibling_gain`` from a histogram of the siblings."""
    side_of = text.name(side)
    sums = ["n", "g", "n0", "g0", "n1", "g1"]
    wide = running_sums(hist, [*by, parent, "feature_idx"], ["value", "category"], sums,
                        chunks.sql() if chunks else None)
    is_cat = _is_cat(features)
    left = {s: f"(CASE WHEN {is_cat} THEN {s} ELSE before_{s} END)" for s in sums}
    right = {s: f"(total_{s} - {left[s]})" for s in sums}
    gain = gain_sql(left["g"], left["n"], right["g"], right["n"], l2_lambda, floor_digits)
    children = ", ".join(
        f"{s}, in{s}, {left[f'n{s}']}, {left[f'g{s}']}, {right[f'n{s}']}, {right[f'g{s}']}"
        for s in (0, 1))
    return (wide.selectExpr(*text.names([*by, parent, *CANDIDATE]), f"{gain} AS gain",
                            f"stack(2, {children}) AS ({side_of}, _own, n_left, g_left, "
                            "n_right, g_right)")
            .where("(value IS NOT NULL OR category IS NOT NULL) AND _own AND n_left > 0 AND n_right > 0")
            .drop("_own"))
