import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from quietgrove.catalog import fixtures as fx
from quietgrove.operators import leaves
from quietgrove.plans import growth, privacy, reports
from quietgrove.plans import trees as tree_module
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.model import BoostedModel
from quietgrove.spec import Grid, ModelParams

FEATURES = [*fx.NUMERIC, *fx.CATEGORICAL]
CATS = [False, False, True, True, True]


def train(df, **params):
    return PrivateBoostedTrees(ModelParams(**params), fx.NUMERIC, fx.CATEGORICAL).fit(df)


def rmse(model, df):
    scored = model.transform(df)
    return math.sqrt(scored.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2.0))).first()[0])


@pytest.fixture(scope="module")
def sample(planted):
    df = planted.where("row_id % 4 = 0").withColumn("fold", (F.col("row_id") % 3).cast("int"))
    pdf = df.orderBy("row_id").toPandas()
    return df, pdf, [pdf[f].to_numpy() for f in FEATURES]


def test_plain_boosting_equals_the_row_by_row_trainer(sample):
    df, pdf, cols = sample
    want, _ = oracle.boost(cols, CATS, pdf["y"].to_numpy(), 2, 3, 0.5, 0.1)
    model = train(df, nb_trees=2, max_depth=3, learning_rate=0.5, refresh_every=1)
    got = model.transform(df).orderBy("row_id").toPandas()["prediction"].to_numpy()
    assert np.allclose(got, want, atol=1e-9)


def test_folds_in_one_job_equal_separate_fits_and_their_trace(sample):
    df, pdf, cols = sample
    models = PrivateBoostedTrees(ModelParams(nb_trees=2, max_depth=1, learning_rate=0.5),
                                 fx.NUMERIC, fx.CATEGORICAL).fit_folds(df)
    shown = {(r["fold"], r["tree_id"]): r for r in reports.trace(models, df).collect()}
    for fold in range(3):
        keep = (pdf["fold"] != fold).to_numpy()
        _, trace = oracle.boost([c[keep] for c in cols], CATS, pdf["y"].to_numpy()[keep],
                                2, 1, 0.5, 0.1)
        for t, (gradient_sum, leaf_sum) in enumerate(trace):
            assert shown[fold, t]["gradient_sum"] == pytest.approx(gradient_sum, abs=1e-7)
            assert shown[fold, t]["leaf_sum"] == pytest.approx(leaf_sum, abs=1e-9)


def test_sibling_growth_equals_the_row_by_row_trainer(spark, sf):
    df = fx.gradients(spark, sf).where("row_id % 5 = 0")
    pdf = df.toPandas()
    _, want = oracle.grow([pdf[f].to_numpy() for f in FEATURES], CATS, pdf["grad"].to_numpy(),
                          3, 0.1, sibling=True)
    tree = growth.fit_tree(df, ModelParams(max_depth=3, growth="sibling"), fx.features(df))
    got = {i: n.split.gain for i, n in tree.nodes.items() if n.split}
    assert {i: pytest.approx(s[0], rel=1e-9) for i, s in want.items()} == got


def test_best_first_stops_at_the_leaf_limit(planted):
    free = train(planted, nb_trees=1, max_depth=3, growth="best_first")
    few = train(planted, nb_trees=1, max_depth=5, growth="best_first", max_leaves=4)
    assert len(few.trees[0][0].leaves) < len(train(planted, nb_trees=1, max_depth=5).trees[0][0].leaves)
    root = few.trees[0][0].nodes[0]
    assert root.split is not None and root.n == planted.count()
    assert all(n.prediction is not None for n in free.trees[0][0].leaves)


def test_walked_trees_equal_compiled_ones(planted, monkeypatch):
    model = train(planted, nb_trees=2, max_depth=5)
    compiled = model.transform(planted).select("row_id", "prediction").orderBy("row_id").collect()
    monkeypatch.setattr(tree_module, "COMPILED_NODES", 1)
    walked = model.transform(planted).select("row_id", "prediction").orderBy("row_id").collect()
    assert compiled == walked


def test_deep_trees_do_not_depend_on_stored_levels(spark, planted, monkeypatch):
    """Rows stored from the second level on, and one winner per node, give the same trees."""
    noise = planted.withColumn("y", (F.xxhash64("row_id") % 1000) / 1000.0)
    multi = planted.withColumn("y", (F.col("row_id") % 3).cast("double"))
    runs = [(noise, dict(nb_trees=1, max_depth=6)), (noise, dict(nb_trees=1, max_depth=5, growth="sibling")),
            (noise, dict(nb_trees=1, max_depth=5, growth="best_first", max_leaves=9)),
            (noise, dict(nb_trees=2, max_depth=5, privacy_budget=50.0, seed="d")),
            (multi, dict(nb_trees=1, max_depth=4, task="multiclass", n_classes=3))]

    def nodes(df, params):
        # floored gains: equal ones do not depend on the order of sums
        table = train(df, floor_digits=True, **params).node_table(spark).toPandas()
        table[["gain", "prediction"]] = table[["gain", "prediction"]].round(8)
        return table.astype(str).values.tolist()

    want = [nodes(*run) for run in runs]
    monkeypatch.setattr(growth.Grower, "WALKED_LEAVES", 1)
    monkeypatch.setattr(growth.Grower, "COLLECTED_ROWS", 0)
    for run, table in zip(runs, want):
        assert nodes(*run) == table


def test_a_deep_tree_stays_small_in_the_plan(spark, monkeypatch):
    """Depth 15 on 20,000 distinct values: one level's text stays below 1 MB."""
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), (F.xxhash64("id") % 100_000).cast("double").alias("a"),
                                      F.col("id").cast("double").alias("b"), (F.col("id") / 1000.0).alias("y"))
    texts = []
    steps = growth.Layout.steps
    monkeypatch.setattr(growth.Layout, "steps", lambda self, *a: texts.append(
        sum(map(len, steps(self, *a))) // max(1, self.depth)) or steps(self, *a))
    params = ModelParams(nb_trees=1, max_depth=15, learning_rate=1.0, l2_lambda=0.0)
    model = PrivateBoostedTrees(params, ["a", "b"]).fit(rows)
    tree = model.trees[0][0]
    assert tree.depth == 15 and len(tree.nodes) > 10_000 and max(texts) < 1_000_000
    scored = model.transform(rows).agg(F.avg(F.pow(F.col("prediction") - F.col("y"), 2.0))).first()[0]
    leaves_of = {n.node_id: n for n in tree.leaves}
    assert sum(n.n for n in tree.leaves) == 20_000
    paths = model.decision_path(rows, 0).groupBy(F.element_at("path", -1).alias("leaf")).count().collect()
    assert {r["leaf"]: r["count"] for r in paths} == {i: n.n for i, n in leaves_of.items()}
    plain = rows.agg(F.var_pop("y")).first()[0]
    assert scored < 0.001 * plain


def test_small_nodes_and_constant_targets_stay_leaves(planted):
    n = planted.count()
    assert train(planted, nb_trees=1, min_samples_split=n + 1).trees[0][0].nodes[0].split is None
    flat = train(planted.withColumn("y", F.lit(2.0)), nb_trees=1, max_depth=2)
    assert flat.init == [2.0] and len(flat.trees[0][0].nodes) == 1
    assert flat.trees[0][0].nodes[0].n == n


def test_node_table_round_trip_and_stats(spark, planted):
    model = train(planted, nb_trees=2, max_depth=2)
    again = BoostedModel.from_table(model.node_table(spark), model.params, model.features, model.init)
    assert again.transform(planted).exceptAll(model.transform(planted)).count() == 0
    counted = {(r["tree_id"], r["node_id"]): r["n"] for r in model.node_stats(planted).collect()}
    for t, (tree,) in enumerate(model.trees):
        for i, node in tree.nodes.items():
            assert counted[t, i] == node.n


def test_signal_is_learned(planted):
    base = planted.agg(F.stddev_pop("y")).first()[0]
    assert rmse(train(planted, nb_trees=4, max_depth=2, learning_rate=0.5), planted) < 0.5 * base


@pytest.mark.parametrize("extra", [
    {}, {"gradient_filtering": True, "leaf_clipping": False}, {"growth": "sibling"},
    {"candidates": "grid", "grid": Grid(0, 10000, 1000)}, {"balance_partition": False},
    {"trees_per_ensemble": 1}])
def test_private_training_keeps_its_promises(planted, extra):
    params = dict(nb_trees=2, max_depth=2, privacy_budget=3.0, seed="t", **extra)
    model = train(planted, **params)
    assert model.ledger.spent <= 3.0 + 1e-9
    used = sum(t[0].nodes[0].n for t in model.trees)
    pools = math.ceil(2 / params.get("trees_per_ensemble", 2))
    assert used <= planted.count() * pools
    if not extra:
        assert used == planted.count()  # disjoint rows, none left over
        again = train(planted, **params)
        assert [n.prediction for t in model.trees for n in t[0].leaves] == \
            [n.prediction for t in again.trees for n in t[0].leaves]
        other = train(planted, **{**params, "seed": "u"})
        assert [n.prediction for t in model.trees for n in t[0].leaves] != \
            [n.prediction for t in other.trees for n in t[0].leaves]


def test_private_start_score_is_paid_for(planted):
    model = train(planted, nb_trees=1, max_depth=1, privacy_budget=2.0, private_init=0.5, seed="s")
    assert "start score" not in model.ledger.unpaid
    assert model.ledger.spent == pytest.approx(2.0)


def test_rejection_needs_no_budget_and_stops(planted):
    with pytest.raises(ValueError):
        ModelParams(reject=True, privacy_budget=1.0)
    noise = planted.withColumn("y", (F.xxhash64("row_id") % 1000) / 1000.0)
    model = train(noise, nb_trees=6, max_depth=4, learning_rate=1.0, reject=True, seed="r")
    assert len(model.trees) < 6


def test_ledgers_never_exceed_the_budget():
    for growth_order in ("level", "best_first", "sibling"):
        for decay in (False, True):
            for depth in (1, 3, 6, 15):
                for classes, mode in ((1, "sequential"), (3, "sequential")):
                    for per in (None, 7):
                        p = ModelParams(nb_trees=20, max_depth=depth, use_decay=decay,
                                        growth=growth_order, privacy_budget=2.5,
                                        task="multiclass" if classes > 1 else "regression",
                                        n_classes=classes, multiclass_budget=mode,
                                        trees_per_ensemble=per)
                        privacy.training_ledger(p).check()
    with pytest.raises(ValueError):
        privacy.Ledger(1.0, [("x", 1.5)]).check()


def test_sensitivities():
    p = ModelParams(l2_threshold=2.0, l2_lambda=0.1, learning_rate=0.1)
    assert privacy.delta_g(p) == 12.0
    assert privacy.delta_v(p, 0) == pytest.approx(2.0 / 1.1)
    assert privacy.delta_v(p, 30) == pytest.approx(4.0 * 0.9 ** 30)
    free = p.with_(gradient_filtering=True, leaf_clipping=False)
    assert privacy.delta_v(free, 30) == pytest.approx(2.0 / 1.1)
    decay = ModelParams(use_decay=True, max_depth=6)
    assert privacy.node_budget(decay, 1.0, 0) == pytest.approx(1 / (2 * 2 ** 7 + 4))
    assert privacy.node_budget(decay, 1.0, 2) == pytest.approx(1 / 16)


def test_laplace_noise_moments(spark):
    df = spark.range(20000).withColumnRenamed("id", "node_id").withColumn("grad", F.lit(0.0))
    noisy = leaves.leaf_values_private(df, 0.1, 2.0, 3.0, "m")  # scale 3
    r = noisy.agg(F.avg("leaf_value").alias("m"), F.var_pop("leaf_value").alias("v")).first()
    assert abs(r["m"]) < 0.12 and r["v"] == pytest.approx(18.0, rel=0.08)


def test_multiclass_and_labels(spark, sf):
    df = fx.multi(spark, sf).withColumn("y", F.when(F.col("c_acctbal") < 2000, 0.0).when(
        F.col("c_nationkey") < 12, 1.0).otherwise(2.0))
    params = ModelParams(task="multiclass", n_classes=3, nb_trees=2, max_depth=2, learning_rate=0.5)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.MULTI_CATEGORICAL).fit(df)
    labelled = model.predict_label(df)
    assert labelled.where("label = y").count() == df.count()
    proba = model.predict_proba(df).select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
                                           .alias("s"))
    assert proba.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-12
    dp = PrivateBoostedTrees(params.with_(privacy_budget=3.0, seed="k"), fx.NUMERIC,
                             fx.MULTI_CATEGORICAL).fit(df)
    assert dp.ledger.spent <= 3.0 + 1e-9
