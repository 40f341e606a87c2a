"""Cross-validation, budget and size sweeps, baselines."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from typing import Mapping, Optional, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.text import literal_array
from quietgrove.functions.columns import choose
from quietgrove.functions.losses import argmax_class
from quietgrove.functions.metrics import METRICS, score_summary
from quietgrove.operators.cleaning import Scaler, fit_scaler
from quietgrove.operators.splits import kfold
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.model import BoostedModel
from quietgrove.plans.walks import boosted
from quietgrove.scratch import Scratch, materialize
from quietgrove.sources.results import NAMED_SWEEP_SCHEMA
from quietgrove.sources.tables import take_first
from quietgrove.spec import ModelParams

# Budgets and named configurations of the usual sweep.
BUDGETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1, 1.5, 2, 2.5, 3, 4, 5, 6, 7, 8, 9, 10)
CONFIGS = {
    "Vanilla": dict(nb_trees=50, max_depth=6, learning_rate=0.1, leaf_clipping=False,
                    privacy_budget=0.0),
    "DFS": dict(nb_trees=50, max_depth=6, learning_rate=0.1, leaf_clipping=True),
    "BFS": dict(nb_trees=50, max_depth=6, learning_rate=0.1, growth="best_first", max_leaves=28,
                min_samples_split=50),
    "3-trees": dict(nb_trees=50, max_depth=6, learning_rate=0.1, growth="sibling"),
}
SAMPLE_SIZES = (300, 5000, 15000, 25000, 50000, 75000, 100000)
SMALLEST_SIZE = 300  # shown, but left out of the mean over sizes


class Columns:
    """Names of the columns a model is trained on."""

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                 target: str = "y", row_id: str = "row_id",
                 order: Optional[Sequence[str]] = None):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.target, self.row_id, self.order = target, row_id, order

    def trainer(self, params: ModelParams) -> PrivateBoostedTrees:
        return PrivateBoostedTrees(params, self.numeric, self.categorical, self.target,
                                   self.row_id, self.order)

    def slim(self, df: DataFrame, *extra: str) -> DataFrame:
        names = [self.row_id, *extra, *self.numeric, *self.categorical, self.target]
        return df.select(*dict.fromkeys(names))


def _fold_scalers(df: DataFrame, y: str, folds: Sequence[int], bounds) -> dict[int, Scaler]:
    """Target scaler of each fold's training rows, from one small table of extremes."""
    if bounds is not None:
        return {f: fit_scaler(df, y, bounds=bounds) for f in folds}
    parts = {r["fold"]: (r["lo"], r["hi"]) for r in df.groupBy("fold").agg(
        F.min(y).alias("lo"), F.max(y).alias("hi")).collect()}
    out = {}
    for f in folds:
        rest = [v for g, v in parts.items() if g != f]
        lo, hi = min(v[0] for v in rest), max(v[1] for v in rest)
        out[f] = Scaler(float(lo), float(hi), -1.0, 1.0, lo < -1 or hi > 1)
    return out


def _predict_folds(df: DataFrame, models: Mapping[int, BoostedModel],
                   scalers: Optional[Mapping[int, Scaler]]) -> DataFrame:
    """Score each row with the model that has not seen its fold, in one pass."""
    first = next(iter(models.values()))
    p = first.params
    names = [f"_raw_{k}" for k in range(len(first.init))]
    rounds = max(len(m.trees) for m in models.values())
    totals = {}
    for k, name in enumerate(names):
        start = text.case([(f"fold = {f}", text.literal(float(m.init[k]))) for f, m in models.items()])
        totals[name] = (start, [[(f"fold = {f}", m.trees[t][k]) for f, m in models.items()
                                 if t < len(m.trees)] for t in range(rounds)])
    return _labelled(boosted(df, totals, p.learning_rate), names, p.task, scalers)


def _labelled(scored: DataFrame, names: Sequence[str], task: str, scalers: Optional[Mapping[int, Scaler]]
              ) -> DataFrame:
    """``p``, the prediction in units of the target, in place of raw scores."""
    raws = [F.col(n) for n in names]
    if scalers is not None:
        raws = [choose([(F.col("fold") == f, s.inverse(r)) for f, s in scalers.items()]) for r in raws]
    if task == "regression":
        label = raws[0]
    elif task == "binary":
        label = (raws[0] >= 0).cast("double")
    else:
        label = argmax_class(raws).cast("double")
    return scored.withColumn("p", label).drop(*names)


def stored_folds(scratch: Scratch, df: DataFrame, k: int, columns: Columns, shuffle: bool = True, seed=None
                 ) -> DataFrame:
    """Rows with their fold. Stored first, so that the search for the fold limits scans ids only."""
    slim = scratch.save(columns.slim(df))
    folded = scratch.save(kfold(slim, k, columns.row_id, shuffle, seed), spread=True)
    scratch.release(slim)
    return folded


def budget_scores(folded: DataFrame, params: ModelParams, budgets: Sequence[float], columns: Columns,
                  metric: Optional[str] = None, scale: Optional[bool] = None, bounds=None) -> DataFrame:
    """Score per budget and fold, (budget, fold, n, score), of models that are trained and applied
    together: neither jobs nor stored rows grow with the budgets."""
    scale = params.task == "regression" if scale is None else scale
    folds = sorted(r[0] for r in folded.select("fold").distinct().collect())
    scalers = _fold_scalers(folded, columns.target, folds, bounds) if scale else {}
    targets = {f: s.forward for f, s in scalers.items() if s.required}
    models = columns.trainer(params).fit_budgets(folded, budgets, "fold", targets,
                                                 any(s.required and s.exact for s in scalers.values()))
    spread = folded.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(len(budgets) - 1))))
    place = {f: i for i, f in enumerate(folds)}
    at = text.case([(f"fold = {f}", str(i * len(budgets))) for f, i in place.items()])
    spread = spread.withColumn("_model", F.expr(f"{at} + _b"))
    listed = [models[f, float(b)] for f in folds for b in budgets]
    names = [f"_raw_{c}" for c in range(len(listed[0].init))]
    totals = {}
    for c, name in enumerate(names):
        start = f"get({literal_array([float(m.init[c]) for m in listed], 'double')}, _model)"
        totals[name] = (start, [[(f"_model = {i}", m.trees[t][c]) for i, m in enumerate(listed)]
                                for t in range(len(listed[0].trees))])
    scored = boosted(spread, totals, params.learning_rate, "_model")
    scored = _labelled(scored, names, params.task, scalers or None)
    listed_budgets = F.get(F.expr(literal_array([float(b) for b in budgets], "double")), F.col("_b"))
    measure = METRICS[metric or default_metric(params.task)]
    return scored.withColumn("y", F.col(columns.target).cast("double")).groupBy("_b", "fold").agg(
        F.count(F.lit(1)).alias("n"), measure("y", "p").alias("score")).select(
        listed_budgets.alias("budget"), "fold", "n", "score")


def cross_predict(df: DataFrame, params: ModelParams, k: int, columns: Columns,
                  shuffle: bool = True, seed=None, scale: Optional[bool] = None, bounds=None,
                  parallel_folds: int = 5, folded: Optional[DataFrame] = None) -> DataFrame:
    """Out-of-fold predictions: row id, fold, y, p.

    Without a budget all folds are trained together, as a key of every job. With a budget
    each fold has row allotments of its own, so folds run side by side from driver threads.
    ``scale`` (default: regression with a budget) trains on targets scaled to [-1, 1] and
    scales predictions back. ``folded`` are rows that were stored with their folds before.
    """
    spark = df.sparkSession
    scale = (params.private and params.task == "regression") if scale is None else scale
    with Scratch(spark) as scratch:
        folded = folded or stored_folds(scratch, df, k, columns, shuffle, seed)
        folds = list(range(k))
        scalers = _fold_scalers(folded, columns.target, folds, bounds) if scale else None
        trainer = columns.trainer(params)
        if not params.private and not params.reject:
            targets = {f: (s.scale, s.min_) for f, s in scalers.items() if s.required} \
                if scalers else None
            if targets:
                targets = {f: targets.get(f, (1.0, 0.0)) for f in folds}
            models = trainer.fit_folds(folded, "fold", targets)
        else:
            def one(f):
                train = folded.where(F.col("fold") != f).drop("fold")
                if scalers is not None:
                    train = train.withColumn(columns.target,
                                             scalers[f].forward(F.col(columns.target)))
                exact = scalers is not None and scalers[f].required and scalers[f].exact
                return f, trainer.fit(train, exact_scaling=exact)
            with ThreadPoolExecutor(min(parallel_folds, k)) as pool:
                models = dict(pool.map(inheritable_thread_target(spark)(one), folds))
        scored = _predict_folds(folded, models, scalers).select(
            columns.row_id, "fold", F.col(columns.target).cast("double").alias("y"), "p")
        return materialize(scored)


def default_metric(task: str) -> str:
    return "rmse" if task == "regression" else "error_rate"


def cross_validate(df: DataFrame, params: ModelParams, k: int, columns: Columns,
                   metric: Optional[str] = None, **options) -> DataFrame:
    """Score per fold: (fold, n, score)."""
    scored = cross_predict(df, params, k, columns, **options)
    measure = METRICS[metric or default_metric(params.task)]
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n"),
                                      measure("y", "p").alias("score"))


def sweep(df: DataFrame, budgets: Sequence[float], configs: Mapping[str, Mapping],
          columns: Columns, base: ModelParams, k: int = 5, dataset: str = "data",
          metric: Optional[str] = None, shuffle: bool = True, seed=None, scale: Optional[bool] = None,
          bounds=None, **options) -> DataFrame:
    """Cross-validated score for each budget and configuration, one result row each.

    Rows and folds are stored once. The budgets of a configuration are trained together, unless what a
    tree trains on depends on the budget (gradient filtering, rejection, private scaling).
    """
    spark = df.sparkSession
    out = None
    with Scratch(spark) as scratch:
        folded = stored_folds(scratch, df, k, columns, shuffle, seed)
        n = folded.count()
        for name, changes in configs.items():
            plain = changes.get("privacy_budget") == 0.0
            params = base.with_(**{**changes, "privacy_budget": 0.0 if plain else float(max(budgets))})
            apart = params.gradient_filtering or params.reject or params.scaling or params.private_init
            if plain or apart:
                scores = None
                for budget in [0.0] if plain else budgets:
                    own = params.with_(privacy_budget=float(budget))
                    one = cross_validate(df, own, k, columns, metric, seed=seed, scale=scale, bounds=bounds,
                                         folded=folded, **options).withColumn("budget", F.lit(float(budget)))
                    scores = one if scores is None else scores.unionByName(one)
            else:
                scores = budget_scores(folded, params, budgets, columns, metric, scale, bounds)
            one = materialize(score_summary(scores, by=("budget",)).select(
                F.lit(name).alias("config"), F.lit(dataset).alias("dataset"),
                F.lit(n).cast("bigint").alias("nb_samples"),
                F.lit(params.nb_trees).alias("nb_trees"), F.lit(params.private).alias("use_dp"),
                F.col("budget").alias("privacy_budget"), "mean", "std",
                F.lit(params.leaf_clipping).alias("glc"),
                F.lit(bool(params.gradient_filtering)).alias("gdf")))
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], NAMED_SWEEP_SCHEMA)


def complexity_scores(df: DataFrame, sizes: Sequence[int], targets: Sequence[str],
                      columns: Columns, params: ModelParams, k: int = 3, **options) -> DataFrame:
    """Percentage error by sample size and target: (n, label, fold, score).

    The largest sample is cut from the table and stored; the smaller ones are its first rows, so ``df``
    is not computed again for each size and target.
    """
    if params.private:
        raise ValueError("the size sweep runs without a budget")
    key, out = columns.row_id, None
    names = [key, *columns.numeric, *columns.categorical, *targets]
    with Scratch(df.sparkSession) as scratch:
        whole = scratch.save(df.select(*dict.fromkeys(names)))
        stored, rest = {}, whole
        for n in sorted(set(sizes), reverse=True):
            stored[n] = rest = scratch.save(take_first(rest, n, key))
        scratch.release(whole)
        for target in targets:
            named = Columns(columns.numeric, columns.categorical, target, key, columns.order)
            for n in sizes:
                folds = cross_validate(stored[n], params, k, named, "mape", scale=True, **options)
                one = folds.select(F.lit(n).alias("n"), F.lit(target).alias("label"), "fold", "score")
                out = one if out is None else out.unionByName(one)
    return out


def complexity_sweep(scores: DataFrame, skip: int = SMALLEST_SIZE) -> DataFrame:
    """Mean over the sample sizes of each target's score; the smallest size is left out."""
    per_size = score_summary(scores, by=("label", "n"), halve_std=True)
    return per_size.where(F.col("n") != skip).groupBy("label").agg(
        F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def baseline_scores(df: DataFrame, task: str, y: str = "y", metric: Optional[str] = None
                    ) -> DataFrame:
    """Score of the constant prediction: the mean, or the most frequent class."""
    if task == "regression":
        constant = float(df.agg(F.avg(F.col(y).cast("double"))).first()[0])
    else:
        top = df.groupBy(y).count().orderBy(F.desc("count"), y).first()
        constant = float(top[0])
    name = metric or default_metric(task)
    scored = df.select(F.col(y).cast("double").alias("y"), F.lit(constant).alias("p"))
    return scored.agg(F.lit(name).alias("metric"), F.lit(constant).alias("prediction"),
                      METRICS[name]("y", "p").alias("score"))


# The search space of the baseline models.
BASELINE_GRID = {
    "trees": (1, *range(10, 101, 10)), "depth": tuple(range(2, 7)),
    "learning_rate": tuple(i / 100 for i in range(1, 100))}


def baseline_grid(df: DataFrame, grid: Mapping[str, Sequence], columns: Columns, k: int = 5,
                  seed: int = 0, parallelism: int = 4) -> tuple[DataFrame, str]:
    """Grid search over Spark's own boosted trees and random forest, by cross-validated RMSE
    on the target scaled to [-1, 1]. Returns all scores and the best settings as JSON."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    y = columns.target
    scaler = fit_scaler(df, y)
    types = dict(df.dtypes)
    texts = [c for c in columns.categorical if types[c] == "string"]
    plain = [*columns.numeric, *[c for c in columns.categorical if c not in texts]]
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in texts]
    stages.append(VectorAssembler(inputCols=[*plain, *[f"_{c}" for c in texts]],
                                  outputCol="features"))
    ready = Pipeline(stages=stages).fit(df).transform(df).select(
        "features", scaler.forward(F.col(y).cast("double")).alias("label"))
    ready = materialize(ready)
    sizes = df.agg(*[F.countDistinct(c) for c in texts]).first() if texts else []
    most = 2 + max([32, *sizes])
    gbt = GBTRegressor(seed=seed, maxBins=int(most))
    forest = RandomForestRegressor(seed=seed, maxBins=int(most))
    jobs = {
        "GBTRegressor": (gbt, ParamGridBuilder().addGrid(gbt.maxDepth, list(grid["depth"]))
                         .addGrid(gbt.maxIter, list(grid["trees"]))
                         .addGrid(gbt.stepSize, list(grid["learning_rate"])).build()),
        "RandomForestRegressor": (forest, ParamGridBuilder()
                                  .addGrid(forest.maxDepth, list(grid["depth"]))
                                  .addGrid(forest.numTrees, list(grid["trees"])).build())}
    rows, best = [], {}
    for name, (learner, space) in jobs.items():
        fitted = CrossValidator(estimator=learner, estimatorParamMaps=space, numFolds=k,
                                evaluator=RegressionEvaluator(metricName="rmse"), seed=seed,
                                parallelism=parallelism).fit(ready)
        scored = [({p.name: v for p, v in m.items()}, s)
                  for m, s in zip(space, fitted.avgMetrics)]
        best[name] = min(scored, key=lambda x: x[1])[0]
        for settings, score in scored:
            rows.append((name, int(settings["maxDepth"]),
                         int(settings.get("maxIter", settings.get("numTrees"))),
                         float(settings["stepSize"]) if "stepSize" in settings else None,
                         float(score)))
    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame(
        rows, "model string, depth int, trees int, learning_rate double, rmse double")
    return table, json.dumps(best, indent=2)
