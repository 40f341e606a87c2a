"""Reading tables under a column-role spec."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietgrove.functions.draws import draw_key, fresh_seed
from quietgrove.functions.columns import tuple_less
from quietgrove.operators.cleaning import drop_missing
from quietgrove.operators.ranking import order_exprs, position_cuts
from quietgrove.spec import TableSpec


def load_table(spark: SparkSession, path: str, spec: TableSpec, sep: Optional[str] = None,
               header: Optional[bool] = None) -> DataFrame:
    """Features (file order), target and row id of a file or folder, without rows that miss
    a value. Numeric columns and regression targets become doubles; other columns keep
    their text for the encoders."""
    if spec.format == "csv":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])
        raw = (spark.read.schema(schema).option("sep", sep or spec.sep)
               .option("header", spec.header if header is None else header)
               .option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True)
               .option("ignoreTrailingWhiteSpace", True).csv(path))
    else:
        raw = spark.read.format(spec.format).load(path).select(*[f"`{c}`" for c in spec.columns])
    return apply_spec(drop_missing(raw, spec.missing), spec)


def apply_spec(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns of a table by role."""
    out = [F.col(f"`{spec.row_id}`")] if spec.row_id else []
    for c in spec.features:
        col = F.col(f"`{c}`")
        out.append(col.cast("double").alias(c) if c in spec.numeric else col)
    target = F.col(f"`{spec.target}`")
    out.append(target.cast("double").alias(spec.target) if spec.task == "regression" else target)
    return df.select(*out)


def append_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both tables, matched by column name."""
    return first.unionByName(second)


def take_first(df: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows with the smallest keys. Rows without a key are never taken; of several rows
    at the last key as many are taken as fit."""
    return _first(df.where(F.col(f"`{key}`").isNotNull()), n, [key])


def _first(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """n rows in the order of the keys, found by a cut key instead of gathering the rows."""
    total, cuts = position_cuts(df, keys, lambda rows: [n - 1] if 0 < n < rows else [])
    if not cuts:
        return df if n > 0 else df.limit(0)
    exprs, cut = order_exprs(df, keys), cuts[0]
    at = F.lit(True)
    for c, v in zip(exprs, cut):
        at = at & (c == F.lit(v))
    below, tied = df.where(tuple_less(exprs, cut)), df.where(at)
    room = n - below.count()
    return below.unionByName(tied if tied.count() == room else tied.limit(room))


def sample_n(df: DataFrame, n: int, seed=None, key: str = "row_id", marker: str = "?"
             ) -> DataFrame:
    """n random rows among those without a missing value."""
    draw = drop_missing(df, marker).withColumn("_draw", draw_key(fresh_seed(seed), key))
    return _first(draw.where(F.col(f"`{key}`").isNotNull()), n, ["_draw", key]).drop("_draw")
