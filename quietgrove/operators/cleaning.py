"""Projection, missing rows, encodings, target preparation and scaling."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import as_col, clamp, interval_index, mapped
from quietgrove.operators.ranking import global_rank, order_exprs, position_cuts
from quietgrove.scratch import materialize

# A category mapping of at most this many rows is broadcast; larger ones are joined by a
# shuffle, with skewed categories split at run time.
BROADCAST_CATEGORIES = 1_000_000


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def drop_missing(df: DataFrame, marker: str = "?") -> DataFrame:
    """Drop rows that hold the marker in any text column. Comes before any column is
    dropped, so that a marker in a dropped column counts too."""
    texts = [c for c, t in df.dtypes if t == "string"]
    keep = F.lit(True)
    for c in texts:
        keep = keep & ~F.coalesce(F.trim(F.col(c)) == marker, F.lit(False))
    return df.where(keep) if texts else df


def map_values(df: DataFrame, col: str, mapping: Mapping, default=None) -> DataFrame:
    """Replace values by a fixed mapping."""
    return df.withColumn(col, mapped(col, mapping, default))


# -- label encoding ------------------------------------------------------------------------

def category_codes(df: DataFrame, cols: Sequence[str], order: str = "sorted",
                   key: Optional[str] = None) -> DataFrame:
    """(column, category, code) for all given columns; codes start at 0 in each column, and a
    missing value is no category.

    ``sorted`` numbers categories alphabetically, ``first_seen`` by the smallest ``key``
    among their rows.
    """
    if order not in ("sorted", "first_seen"):
        raise ValueError(f"unknown order {order}")
    if order == "first_seen" and key is None:
        raise ValueError("first_seen needs a key")
    parts = ", ".join(f"{text.literal(c)}, CAST({text.name(c)} AS string)" for c in cols)
    ident = [key] if order == "first_seen" else []
    long = df.selectExpr(*text.names(ident), f"stack({len(cols)}, {parts}) AS (column, category)"
                         ).where("category IS NOT NULL")
    first = F.min(text.name(key)) if order == "first_seen" else F.min("category")
    found = materialize(long.groupBy("column", "category").agg(first.alias("_first")))
    sizes = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    if max(sizes.values(), default=0) <= BROADCAST_CATEGORIES:
        place = F.row_number().over(W.partitionBy("column").orderBy("_first", "category")) - 1
        return found.select("column", "category", place.cast("double").alias("code"))
    # Too many categories for one window per column: rank them all, subtract column starts.
    ranked = global_rank(found, ["column", "_first", "category"], "_pos")
    starts, total = [], 0
    for c in sorted(sizes):
        starts.append((F.col("column") == c, F.lit(total)))
        total += sizes[c]
    start = F.coalesce(*[F.when(cond, v) for cond, v in starts])
    return ranked.select("column", "category", (F.col("_pos") - start).cast("double").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], order: str = "sorted",
                 key: Optional[str] = None, codes: Optional[DataFrame] = None) -> DataFrame:
    """Replace categories by their codes (doubles)."""
    if codes is None:
        codes = materialize(category_codes(df, cols, order, key))
    sizes = {r["column"]: r["count"] for r in codes.groupBy("column").count().collect()}
    out = df
    for c in cols:
        mine = codes.where(F.col("column") == c).select(
            F.col("category").alias(f"_cat_{c}"), F.col("code").alias(f"_code_{c}"))
        if sizes.get(c, 0) <= BROADCAST_CATEGORIES:
            mine = F.broadcast(mine)
        out = out.join(mine, F.col(c).cast("string") == F.col(f"_cat_{c}"), "left")
    return out.select(*[F.col(f"_code_{c}").alias(c) if c in cols else F.col(c)
                        for c in df.columns])


def minority_positive(df: DataFrame, y: str) -> DataFrame:
    """Make 1 the rarer label: flip labels 0 and 1 if ones outnumber zeros."""
    counts = df.agg(F.sum((F.col(y) == 1).cast("bigint")).alias("ones"),
                    F.sum((F.col(y) == 0).cast("bigint")).alias("zeros")).first()
    flip = (counts["ones"] or 0) > (counts["zeros"] or 0)
    value = F.col(y).cast("double")
    return df.withColumn(y, F.lit(1.0) - value if flip else value)


def quantile_bin(df: DataFrame, y: str, bins: int, key: str, signed: bool = False,
                 name: str = "bin") -> DataFrame:
    """Class of a numeric target: ``bins`` classes that start at the sorted target's values
    at i * floor(n / bins); a class counts the starts <= y, minus 1. ``signed`` turns class
    0 into -1."""
    _, cuts = position_cuts(df, [y, key], lambda n: [i * (n // bins) for i in range(bins)])
    starts = [(c[0],) for c in cuts]
    cls = (interval_index(order_exprs(df, [y]), starts) - 1).cast("int")
    if signed:
        cls = F.when(cls == 0, F.lit(-1)).otherwise(cls)
    return df.withColumn(name, cls)


def select_target(df: DataFrame, objective: str, objectives: Mapping[str, str],
                  name: str = "y") -> DataFrame:
    """Keep one of several target columns, as ``name``; the other targets are dropped."""
    chosen = objectives[objective]
    rest = [c for c in objectives.values() if c != chosen]
    return df.withColumn(name, F.col(chosen).cast("double")).drop(*rest, chosen)


# -- scaling -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Scaler:
    """Min-max scaling and its inverse."""

    data_min: float
    data_max: float
    feature_min: float
    feature_max: float
    required: bool = True
    exact: bool = True  # bounds were read from the rows, not given

    @property
    def scale(self) -> float:
        width = self.data_max - self.data_min
        return (self.feature_max - self.feature_min) / (width if width else 1.0)

    @property
    def min_(self) -> float:
        return self.feature_min - self.data_min * self.scale

    def forward(self, value) -> Column:
        value = as_col(value)
        if not self.required:
            return value
        width = self.data_max - self.data_min
        share = (value - F.lit(self.data_min)) / F.lit(width if width else 1.0)
        return share * F.lit(self.feature_max - self.feature_min) + F.lit(self.feature_min)

    def inverse(self, value) -> Column:
        value = as_col(value)
        return (value - F.lit(self.min_)) / F.lit(self.scale) if self.required else value


def fit_scaler(df: DataFrame, y: str, lo: float = -1.0, hi: float = 1.0, bounds=None) -> Scaler:
    """Scaler into [lo, hi]; none is needed if all values already lie there. Public
    ``bounds`` spare the exact minimum and maximum, which a private run cannot read for
    free."""
    if bounds is not None:
        return Scaler(float(bounds[0]), float(bounds[1]), lo, hi, True, False)
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    required = r["lo"] is not None and (r["lo"] < lo or r["hi"] > hi)
    return Scaler(float(r["lo"] or 0.0), float(r["hi"] or 0.0), lo, hi, required, True)


def scale_target(df: DataFrame, y: str, lo: float = -1.0, hi: float = 1.0, bounds=None
                 ) -> tuple[DataFrame, Scaler]:
    """Min-max scale the target into [lo, hi]; values outside public bounds are clamped."""
    scaler = fit_scaler(df, y, lo, hi, bounds)
    value = F.col(y).cast("double")
    if bounds is not None:
        value = clamp(value, float(bounds[0]), float(bounds[1]))
    return df.withColumn(y, scaler.forward(value)), scaler


def unscale(df: DataFrame, col: str, scaler: Scaler) -> DataFrame:
    """Undo the scaling of a target or a prediction."""
    return df.withColumn(col, scaler.inverse(col))
