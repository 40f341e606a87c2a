"""Training tasks. A task is three Column builders, so a user-defined loss stays inside
code generation: ``init`` (aggregates for the start score), ``gradient`` and ``score``."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions.columns import as_col, floor_to, sigmoid

GRADIENT_DIGITS = 15


class Task:
    """Interface of a task with ``n_classes`` raw scores per row."""

    n_classes = 1

    def init(self, df: DataFrame, y: str) -> list[float]:
        raise NotImplementedError

    def gradient(self, y, preds: Sequence, k: int = 0) -> Column:
        raise NotImplementedError

    def score(self, y, preds: Sequence) -> Column:
        """Aggregate to report; lower is better."""
        raise NotImplementedError

    def deviance(self, y, preds: Sequence) -> Column:
        """Aggregate that decides whether a tree is kept; lower is better."""
        raise NotImplementedError

    def hessian(self, y, preds: Sequence, k: int = 0) -> Column:
        return F.lit(1.0)


class Regression(Task):
    """Least squares."""

    def init_aggregate(self, y) -> Column:
        return F.avg(as_col(y).cast("double"))

    def init(self, df, y):
        return [df.agg(self.init_aggregate(y).alias("s")).first()["s"]]

    def gradient(self, y, preds, k=0):
        return as_col(preds[0]) - as_col(y)

    def score(self, y, preds):
        from quietgrove.functions.metrics import rmse
        return rmse(y, preds[0])

    def deviance(self, y, preds):
        return F.avg(F.pow(as_col(preds[0]) - as_col(y), F.lit(2.0)))


class Binary(Task):
    """Binomial deviance on labels 0 and 1."""

    def init_aggregate(self, y) -> Column:
        share = F.avg((as_col(y) == 1).cast("double"))
        smaller = F.least(share, F.lit(1.0) - share)
        return F.log(smaller / (F.lit(1.0) - smaller))

    def init(self, df, y):
        value = df.agg(self.init_aggregate(y).alias("s")).first()["s"]
        if value is None or math.isinf(value):
            raise ValueError("a binary target needs rows of both labels")
        return [value]

    def gradient(self, y, preds, k=0):
        return sigmoid(preds[0]) - as_col(y)

    def score(self, y, preds):
        from quietgrove.functions.metrics import error_rate
        return error_rate(y, (as_col(preds[0]) >= 0).cast("double"))

    def deviance(self, y, preds):
        p = as_col(preds[0])
        return F.lit(-2.0) * F.avg(as_col(y) * p - (F.greatest(p, F.lit(0.0))
                                                   + F.log1p(F.exp(-F.abs(p)))))


class Multiclass(Task):
    """Multinomial deviance on labels 0 .. K-1; one raw score per class."""

    def __init__(self, n_classes: int):
        self.n_classes = n_classes

    def init(self, df, y):
        counts = df.agg(*[F.avg((as_col(y) == k).cast("double")).alias(f"c{k}")
                          for k in range(self.n_classes)]).first()
        if any(not v for v in counts):
            raise ValueError("every class needs at least one row")
        return [math.log(v) for v in counts]

    def log_norm(self, preds) -> Column:
        cols = [as_col(p) for p in preds]
        top = F.greatest(*cols)
        total = F.exp(cols[0] - top)
        for c in cols[1:]:
            total = total + F.exp(c - top)
        return top + F.log(total)

    def probability(self, preds, k: int) -> Column:
        return F.exp(as_col(preds[k]) - self.log_norm(preds))

    def gradient(self, y, preds, k=0):
        return self.probability(preds, k) - (as_col(y) == k).cast("double")

    def hessian(self, y, preds, k=0):
        p = self.probability(preds, k)
        return p * (F.lit(1.0) - p)

    def score(self, y, preds):
        from quietgrove.functions.metrics import error_rate
        return error_rate(y, argmax_class(preds).cast("double"))

    def deviance(self, y, preds):
        own = F.lit(0.0)
        for k in range(self.n_classes):
            own = own + F.when(as_col(y) == k, as_col(preds[k])).otherwise(F.lit(0.0))
        return F.avg(self.log_norm(preds) - own)


def argmax_class(preds: Sequence) -> Column:
    """First class with the highest raw score, 0-based."""
    scores = F.array(*[as_col(p) for p in preds])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def task_of(name: str, n_classes: int = 1) -> Task:
    return {"regression": Regression, "binary": Binary}[name]() if name != "multiclass" \
        else Multiclass(n_classes)


def floored(gradient: Column, on: bool) -> Column:
    """Comparison runs cut gradients to a fixed number of decimals."""
    return floor_to(gradient, GRADIENT_DIGITS) if on else gradient
