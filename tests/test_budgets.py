"""Models of several folds and budgets that are trained together."""

import pytest
from pyspark.sql import functions as F

from quietgrove.catalog import fixtures as fx
from quietgrove.operators.splits import kfold
from quietgrove.plans import coding, evaluation
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.growth import Grower
from quietgrove.scratch import materialize
from quietgrove.spec import ModelParams

COLUMNS = evaluation.Columns(fx.NUMERIC, fx.CATEGORICAL)


def trees_of(model):
    return [[(i, n.n, n.split and (n.split.feature.name, n.split.value, n.split.category),
              None if n.split else round(n.prediction, 9)) for i, n in sorted(t.nodes.items())]
            for (t,) in model.trees]


@pytest.mark.parametrize("extra", [{}, {"growth": "sibling"}, {"growth": "best_first", "max_leaves": 5},
                                   {"trees_per_ensemble": 2, "balance_partition": False, "learning_rate": 0.4}])
def test_shared_training_equals_training_alone(planted, extra):
    params = ModelParams(**{**dict(nb_trees=3, max_depth=2, seed="b", privacy_budget=1.0), **extra})
    folded = materialize(kfold(planted.where("row_id % 3 > 0"), 2, "row_id", True, "f"))
    shift = {0: lambda y: y * 0.5 + 0.1}
    found = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit_budgets(
        folded, [2.0, 30.0], "fold", shift)
    assert set(found) == {(0, 2.0), (0, 30.0), (1, 2.0), (1, 30.0)}
    for (f, budget), model in found.items():
        rows = folded.where(F.col("fold") != f).drop("fold")
        if f in shift:
            rows = rows.withColumn("y", shift[f](F.col("y")))
        alone = PrivateBoostedTrees(params.with_(privacy_budget=budget), fx.NUMERIC, fx.CATEGORICAL).fit(rows)
        assert trees_of(model) == trees_of(alone)
        assert model.init == pytest.approx(alone.init) and model.ledger.spent == pytest.approx(alone.ledger.spent)
    assert trees_of(found[0, 2.0]) != trees_of(found[0, 30.0])


def test_sweep_equals_one_run_per_budget(spark, planted, monkeypatch):
    rows = planted.where("row_id % 4 > 0")
    base = ModelParams(seed="w", nb_trees=2, max_depth=2)
    configs = {"plain": dict(privacy_budget=0.0), "private": {}, "filtered": dict(gradient_filtering=True)}
    budgets = (1.0, 4.0, 60.0)
    got = {(r["config"], r["privacy_budget"]): r for r in evaluation.sweep(
        rows, budgets, configs, COLUMNS, base, 2, "d", seed="w").collect()}
    assert set(got) == {("plain", 0.0), *((c, b) for c in ("private", "filtered") for b in budgets)}
    for (config, budget), r in got.items():
        params = base.with_(**{**configs[config], "privacy_budget": budget})
        folds = evaluation.cross_validate(rows, params, 2, COLUMNS, seed="w").collect()
        scores = [f["score"] for f in folds]
        assert r["mean"] == pytest.approx(sum(scores) / 2, rel=1e-9)
        assert r["nb_samples"] == rows.count() and r["use_dp"] == (budget > 0)


def test_jobs_do_not_grow_with_budgets(spark, planted):
    folded = materialize(kfold(planted.where("row_id % 3 = 0"), 2, "row_id", True, "f"))
    trainer = PrivateBoostedTrees(ModelParams(nb_trees=2, max_depth=2, seed="j"), fx.NUMERIC, fx.CATEGORICAL)
    tracker, counts = spark.sparkContext.statusTracker(), []
    for budgets in ([2.0], [float(b) for b in range(1, 13)]):
        group = f"budgets-{len(budgets)}"
        spark.sparkContext.setJobGroup(group, group)
        assert len(trainer.fit_budgets(folded, budgets)) == 2 * len(budgets)
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert counts[1] <= 1.2 * counts[0]


def test_rows_that_depend_on_the_budget_are_not_shared(planted):
    trainer = PrivateBoostedTrees(ModelParams(gradient_filtering=True, privacy_budget=1.0), fx.NUMERIC)
    with pytest.raises(ValueError):
        trainer.fit_budgets(planted.withColumn("fold", F.lit(0)), [1.0])
    with pytest.raises(ValueError):
        PrivateBoostedTrees(ModelParams(), fx.NUMERIC).fit_budgets(planted.withColumn("fold", F.lit(0)), [0.0])


@pytest.mark.parametrize("extra", [{"growth": "best_first", "max_leaves": 5}, {"argmax_splits": True},
                                   {"growth": "sibling", "task": "multiclass", "n_classes": 3}, {"min_samples_split": 10 ** 6}])
def test_nodes_shared_by_budgets_equal_nodes_of_their_own(planted, extra, monkeypatch):
    rows = planted.where("row_id % 3 = 0")
    if "task" in extra:
        rows = rows.withColumn("y", (F.floor(F.col("row_id") / 6) % 3).cast("double"))
    else:
        monkeypatch.setattr(coding, "DICTIONARY_ROWS", 4)  # two features keep their text
    folded = materialize(rows.withColumn("fold", (F.col("row_id") % 2).cast("int")))
    params = ModelParams(**{**dict(nb_trees=1, max_depth=3, seed="n"), **extra})
    budgets = [1.0, 8.0, 20.0, 40.0, 41.0]
    found = []
    for limit in (Grower.SHARED_ROWS, 0):
        monkeypatch.setattr(Grower, "SHARED_ROWS", limit)
        models = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit_budgets(folded, budgets)
        found.append({k: [[(i, n.n, n.split and (n.split.feature.name, n.split.value, n.split.category),
                            None if n.split else pytest.approx(n.prediction, rel=1e-7)) for i, n in sorted(t.nodes.items())]
                          for t in m.trees[0]] for k, m in models.items()})
    assert len(found[0]) == 10 and found[0] == found[1]


def test_first_tree_reads_rows_once_for_all_budgets(planted, monkeypatch):
    folded = materialize(planted.where("row_id % 3 = 0").withColumn("fold", (F.col("row_id") % 2).cast("int")))
    given, grow = [], Grower.grow
    monkeypatch.setattr(Grower, "grow", lambda self, rows, *more: given.append(rows.count()) or grow(self, rows, *more))
    PrivateBoostedTrees(ModelParams(nb_trees=1, max_depth=1, seed="j"), fx.NUMERIC, fx.CATEGORICAL).fit_budgets(
        folded, [float(b) for b in range(1, 13)])
    assert given == [folded.count()]


def test_size_sweep_computes_its_rows_once(spark, planted):
    seen = spark.sparkContext.accumulator(0)

    def passed(i):
        seen.add(1)
        return i

    rows = materialize(planted.where("row_id % 3 = 0").withColumn(
        "row_id", F.when(F.col("row_id") % 7 > 0, F.col("row_id"))))
    counted = rows.withColumn("row_id", F.udf(passed, "bigint")("row_id"))
    params = ModelParams(nb_trees=1, max_depth=1)
    got = {(r["n"], r["fold"]): r["score"] for r in evaluation.complexity_scores(
        counted, (60, 150), ["y"], COLUMNS, params, 2, seed="c").collect()}
    assert seen.value == rows.count()
    alone = rows.where("row_id IS NOT NULL").orderBy("row_id").limit(60)
    for r in evaluation.cross_validate(materialize(alone), params, 2, COLUMNS, "mape", scale=True, seed="c").collect():
        assert got[60, r["fold"]] == pytest.approx(r["score"])
    assert len(got) == 4
