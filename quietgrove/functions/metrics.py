"""Error metrics as aggregate Columns; usable in any ``groupBy(...).agg``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions.columns import as_col

ZERO_TARGET = 10e-6  # fixed value: stands in for a zero target in the percentage error


def rmse(y, p) -> Column:
    return F.sqrt(F.avg(F.pow(as_col(y) - as_col(p), F.lit(2.0))))


def error_rate(y, p) -> Column:
    """Share of wrong labels in percent."""
    return F.avg((as_col(y) != as_col(p)).cast("double")) * F.lit(100.0)


def accuracy(y, p) -> Column:
    """Share of right labels as a fraction."""
    return F.avg((as_col(y) == as_col(p)).cast("double"))


def mape(y, p) -> Column:
    """Mean absolute error in percent of the target."""
    y = F.when(as_col(y) == 0, F.lit(ZERO_TARGET)).otherwise(as_col(y))
    return F.avg(F.abs((y - as_col(p)) / y)) * F.lit(100.0)


METRICS = {"rmse": rmse, "error_rate": error_rate, "accuracy": accuracy, "mape": mape}


def score_summary(df: DataFrame, score: str = "score", by=(), halve_std: bool = False) -> DataFrame:
    """Mean and population standard deviation of scores; ``halve_std`` reports std / 2."""
    spread = F.stddev_pop(score)
    return df.groupBy(*by).agg(F.avg(score).alias("mean"),
                               (spread / 2 if halve_std else spread).alias("std"))
