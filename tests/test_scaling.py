"""Private feature scaling inside training."""

import pytest
from pyspark.sql import functions as F

from quietgrove.catalog import fixtures as fx
from quietgrove.plans import evaluation, privacy
from quietgrove.plans import trees as tree_module
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.model import BoostedModel
from quietgrove.spec import FeatureScaling, Grid, ModelParams

GRID = Grid(0.0, 1.0, 0.05)


def scaled_params(**more):
    base = dict(nb_trees=2, max_depth=3, learning_rate=0.5, privacy_budget=40.0, seed="s", candidates="grid",
                grid=GRID, scaling=FeatureScaling(4.0, {"c_acctbal": -1000.0, "c_nationkey": 0.0},
                                                  {"c_acctbal": 10000.0, "c_nationkey": 24.0}))
    return ModelParams(**{**base, **more})


def fit(df, **more):
    return PrivateBoostedTrees(scaled_params(**more), fx.NUMERIC, fx.CATEGORICAL).fit(df)


@pytest.mark.parametrize("growth", ["level", "best_first", "sibling"])
def test_splits_lie_on_the_grid_and_scaling_is_paid_for(spark, planted, growth):
    model = fit(planted, growth=growth)
    points = {GRID.lo + i * GRID.step for i in range(GRID.size)}
    used = [n.split for (t,) in model.trees for n in t.nodes.values() if n.split and not n.split.feature.is_cat]
    assert used and all(s.value in points for s in used)
    ledger = model.ledger.check()
    assert [e for e in ledger.entries if e[0].startswith("scaling")] == [
        ("scaling of c_acctbal", 2.0), ("scaling of c_nationkey", 2.0)]
    assert ledger.spent == pytest.approx(4.0 + privacy.path_spend(model.params)) and ledger.budget == 40.0
    assert ledger.spent <= 40.0 + 1e-9
    assert ledger.unpaid == ["start score"]
    bounds = {r["column"]: r for r in model.scaling_table(spark).collect()}
    assert set(bounds) == set(fx.NUMERIC) and all(r["lower"] < r["upper"] for r in bounds.values())


def test_scoring_maps_raw_columns(spark, planted, monkeypatch):
    model = fit(planted)
    scored = model.transform(planted)
    assert scored.select(*planted.columns).exceptAll(planted).count() == 0
    # by hand: the same trees over columns that were mapped beforehand
    maps = {f.name: f.scaled for f in model.features if f.scaled}
    mapped = planted.withColumns({
        c: (F.greatest(F.lit(m.lower), F.least(F.col(c).cast("double"), F.lit(m.upper))) - m.lower)
        / (m.upper - m.lower) * (m.hi - m.lo) + m.lo for c, m in maps.items()})
    plain = [f.__class__(f.index, f.name, f.is_cat, f.text) for f in model.features]
    nodes = model.node_table(spark)
    over = BoostedModel.from_table(nodes, model.params, plain, model.init).transform(mapped)
    keep = ["row_id", "prediction"]
    assert scored.select(keep).exceptAll(over.select(keep)).count() == 0
    again = BoostedModel.from_table(nodes, model.params, model.features, model.init).transform(planted)
    assert scored.select(keep).exceptAll(again.select(keep)).count() == 0
    monkeypatch.setattr(tree_module, "COMPILED_NODES", 1)
    assert model.transform(planted).select(keep).exceptAll(scored.select(keep)).count() == 0
    gone = planted.withColumn("c_acctbal", F.lit(None).cast("double")).limit(5)
    assert model.transform(gone).where("prediction IS NULL").count() == 0


def test_scaled_folds_and_missing_values(planted):
    some = planted.withColumn("c_acctbal", F.when(F.col("row_id") % 5 > 0, F.col("c_acctbal")))
    model = fit(some)
    assert sum(t.nodes[0].n for (t,) in model.trees) <= some.dropna().count()
    out = evaluation.cross_validate(planted, scaled_params(nb_trees=1, max_depth=2, privacy_budget=400.0), 2,
                                    evaluation.Columns(fx.NUMERIC, fx.CATEGORICAL), seed="s").collect()
    assert len(out) == 2 and all(r["score"] < 5 for r in out)
    empty = planted.withColumn("c_nationkey", F.lit(None).cast("int"))
    assert fit(empty).trees == []


def test_scaling_needs_a_budget_and_a_grid():
    for wrong in (dict(privacy_budget=0.0), dict(candidates="distinct"), dict(privacy_budget=4.0)):
        with pytest.raises(ValueError):
            scaled_params(**wrong)
