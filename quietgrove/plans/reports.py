"""Result tables computed from scored rows.

A scored row has: row_id, dataset, n, fold, config, budget, label, y, p. Metrics are
aggregates per group, so everything here combines on the map side.
"""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.functions.metrics import METRICS
from quietgrove.plans.model import BoostedModel
from quietgrove.scratch import materialize

TRACE_GRADIENT_DIGITS = 8
TRACE_LEAF_DIGITS = 10
TINY = 1e-10  # negative sums above -TINY are shown as 0


def fold_scores(scored: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Metric per group and fold."""
    return scored.groupBy(*by, "fold").agg(METRICS[metric]("y", "p").alias("score"))


def mean_scores(scored: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of the fold scores per group."""
    return fold_scores(scored, metric, by).groupBy(*by).agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def result_series(scored: DataFrame, metric: str, configs: Sequence[str],
                  flat: Optional[str] = None) -> DataFrame:
    """Mean and std by budget, one column pair per configuration. ``flat`` names the
    configuration without a budget (budget 0); it becomes a constant column pair."""
    means = mean_scores(scored, metric, ("config", "budget"))
    if flat is not None:
        means = means.where((F.col("config") == flat) | (F.col("budget") > 0))
    wide = (means.where(F.col("config").isin(list(configs))).groupBy("budget")
            .pivot("config", list(configs)).agg(F.first("mean").alias("mean"),
                                                F.first("std").alias("std")))
    if flat is None:
        return wide
    row = means.where(F.col("config") == flat).select("mean", "std").first()
    return wide.where(F.col("budget") > 0).withColumns({
        f"{flat}_{m}": F.lit(row[m] if row else None).cast("double") for m in ("mean", "std")})


def error_extent(scored: DataFrame, metric: str, by: Sequence[str] = ("config", "budget")
                 ) -> DataFrame:
    """Lowest mean minus its std, and highest mean plus its std."""
    return mean_scores(scored, metric, by).agg(
        (F.min("mean") - F.min_by("std", "mean")).alias("low"),
        (F.max("mean") + F.max_by("std", "mean")).alias("high"))


def histogram(df: DataFrame, col: str, bins: int, lo: Optional[float] = None,
              hi: Optional[float] = None) -> DataFrame:
    """Equal-width histogram: (bin, bin_lo, bin_hi, n); the last bin includes the maximum."""
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = (float(r[m]) if given is None else given
                  for m, given in (("lo", lo), ("hi", hi)))
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = (df.where(F.col(col).between(lo, hi)).groupBy(place.alias("bin"))
               .agg(F.count(F.lit(1)).alias("n")))
    return counted.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                          (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def complexity_curve(scored: DataFrame, labels: Sequence[str], metric: str = "mape") -> DataFrame:
    """Mean and std of the error by sample size, one column pair per target."""
    means = mean_scores(scored, metric, ("n", "label"))
    return means.groupBy("n").pivot("label", list(labels)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))


def compare_runs(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """Mean metric by budget of two runs, side by side."""
    left = mean_scores(a, metric, ("budget",)).select("budget", F.col("mean").alias("mean_a"),
                                                      F.col("std").alias("std_a"))
    right = mean_scores(b, metric, ("budget",)).select("budget", F.col("mean").alias("mean_b"),
                                                       F.col("std").alias("std_b"))
    return left.join(right, "budget").withColumn("delta", F.col("mean_b") - F.col("mean_a"))


def trace(models: Mapping[int, BoostedModel], rows: DataFrame, target: str = "y",
          fold: str = "fold") -> DataFrame:
    """Gradient sum over the training rows before each tree, and sum of the tree's leaf
    values, per class: (fold, tree_id, class_id, gradient_sum, leaf_sum). A row trains the models of all other
    folds; gradients of all stages come from one pass over the rows.
    """
    spark: SparkSession = rows.sparkSession
    parts, leaf_rows, staged = [], [], rows
    for f, model in models.items():
        staged, raws = model.stages(staged, f"_stage_{f}")
        for t, round_ in enumerate(model.trees):
            for k, tree in enumerate(round_):
                g = model.task.gradient(target, raws[t], k)
                parts += [F.lit(f), F.lit(t), F.lit(k), F.when(F.col(fold) != f, g)]
                leaf_rows.append((f, t, k, float(sum(n.prediction for n in tree.leaves))))
    place = ["fold", "tree_id", "class_id"]
    sums = (staged.select(F.stack(F.lit(len(parts) // 4), *parts).alias(*place, "g"))
            .groupBy(*place).agg(F.sum("g").alias("gradient_sum")))
    leaves = spark.createDataFrame(leaf_rows, "fold int, tree_id int, class_id int, leaf_sum double")

    def shown(c, digits):
        v = F.when((F.col(c) < 0) & (F.col(c) >= -TINY), 0.0).otherwise(F.col(c))
        return F.round(v, digits).alias(c)

    return sums.join(leaves, place).select(
        *place, shown("gradient_sum", TRACE_GRADIENT_DIGITS),
        shown("leaf_sum", TRACE_LEAF_DIGITS))


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows that differ between two tables, null-safely; keys found on one side only differ."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols], F.lit(1).alias("_in_b"))
    differs = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    for c in cols:
        differs = differs | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return left.join(right, list(keys), "full").where(differs).drop("_in_a", "_in_b")


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
                   n: int = 10) -> tuple[int, DataFrame]:
    """Number of mismatching rows, and the first n of them by key."""
    diff = materialize(mismatches(a, b, keys, cols))
    return diff.count(), diff.orderBy(*keys).limit(n)
