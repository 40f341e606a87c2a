"""Leaf values per node, as grouped aggregates, and routing of rows to children."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import clamp
from quietgrove.functions.draws import fresh_seed, laplace, uniform
from quietgrove.spec import Feature

SMALL_DENOMINATOR = 1e-150  # fixed value: below it a Newton step is taken as 0
# A level's split table is broadcast up to this many nodes, whatever the size of the rows.
BROADCAST_NODES = 1 << 20


def route(df: DataFrame, splits: DataFrame, features: Sequence[Feature], node: str = "node_id",
          by: Sequence[str] = ()) -> DataFrame:
    """Move rows to the child of their node's split (feature_idx, value, category); rows of
    nodes without a split stay."""
    keys = [*by, node]
    table = splits.select(*keys, "feature_idx", "value", "category")
    if table.count() <= BROADCAST_NODES:
        table = F.broadcast(table)
    cases = []
    for f in features:
        col = text.name(f.name)
        test = f"{col} = category" if f.text else f"{col} {'=' if f.is_cat else '<'} value"
        cases.append((f"feature_idx = {f.index}", test))
    left = text.case(cases)
    n = text.name(node)
    child = f"CASE WHEN feature_idx IS NULL THEN {n} WHEN {left} THEN 2 * {n} + 1 ELSE 2 * {n} + 2 END"
    joined = df.join(table, keys, "left").withColumn(node, F.expr(f"CAST({child} AS bigint)"))
    return joined.select(*df.columns)


def leaf_values(df: DataFrame, l2_lambda: float, by: Sequence[str] = ("node_id",),
                grad: str = "grad", clip: Optional[float] = None) -> DataFrame:
    """Rows and value -sum(g) / (n + lambda) per node, optionally clipped to +-clip."""
    value = -F.sum(grad) / (F.count(F.lit(1)) + F.lit(float(l2_lambda)))
    if clip is not None:
        value = clamp(value, -float(clip), float(clip))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), value.alias("leaf_value"))


def clip_bound(l2_threshold: float, learning_rate: float, tree_index: int) -> float:
    """Geometrically shrinking bound on leaf values."""
    return l2_threshold * (1 - learning_rate) ** tree_index


def leaf_values_private(df: DataFrame, l2_lambda: float, budget: float, delta_v: float,
                        seed=None, by: Sequence[str] = ("node_id",), grad: str = "grad",
                        clip: Optional[float] = None) -> DataFrame:
    """Leaf values with Laplace noise of scale delta_v / (budget / 2), where ``budget`` is
    the tree's. The noise is a function of the seed and the node."""
    seed = fresh_seed(seed)
    exact = leaf_values(df, l2_lambda, by, grad, clip)
    noise = laplace(uniform(f"{seed}|1", *by), uniform(f"{seed}|2", *by), delta_v / (budget / 2))
    return exact.withColumn("leaf_value", F.col("leaf_value") + noise)


def leaf_values_multiclass(df: DataFrame, n_classes: int, l2_lambda: float,
                           by: Sequence[str] = ("node_id", "class_id"), grad: str = "grad",
                           y: str = "y") -> DataFrame:
    """One Newton step per node and class; ``y`` is the 0/1 target of the class."""
    target = F.col(y) + F.col(grad)
    curvature = F.sum(target * (F.lit(1.0) - target))
    step = -F.sum(grad) * F.lit((n_classes - 1) / n_classes) / (curvature + F.lit(float(l2_lambda)))
    value = F.when(F.abs(curvature) < SMALL_DENOMINATOR, F.lit(0.0)).otherwise(step)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), value.alias("leaf_value"))
