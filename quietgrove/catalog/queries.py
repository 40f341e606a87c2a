"""One query per operator, over whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.catalog import fixtures as fx
from quietgrove.functions import losses, metrics
from quietgrove.functions.columns import clamp
from quietgrove.operators import cleaning, histogram, leaves, quantile, ranking, risk, selection
from quietgrove.operators import splits
from quietgrove.plans import evaluation, files, growth, privacy, reports
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.model import BoostedModel
from quietgrove.plans.trees import nodes_frame
from quietgrove.scratch import Scratch
from quietgrove.sources import presets, results, tables
from quietgrove.spec import FeatureScaling, Grid, ModelParams, TableSpec

SEED = "7"
LAMBDA = 0.1
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rd(col, digits=6):
    """Rounded, and never a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rounded(df: DataFrame, cols, digits=6) -> DataFrame:
    return df.withColumns({c: rd(c, digits) for c in cols})


def _csv(df: DataFrame, sep=",", header=False) -> str:
    """Write a delimited copy to the shared folder; returns its path."""
    path = f"{Scratch(df.sparkSession).path}/csv"
    df.write.option("sep", sep).option("header", header).csv(path)
    return path


# -- sources and sinks ---------------------------------------------------------------------

@query
def a1_load_table(spark, d):
    cols = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    spec = TableSpec("orders", cols, target="o_totalprice", numeric=("o_custkey",),
                     categorical=("o_orderstatus", "o_orderpriority"), row_id="o_orderkey")
    path = _csv(fx.table(spark, d, "orders").select(*cols))
    loaded = tables.load_table(spark, path, spec)
    return loaded.withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query
def a2_preset_regression(spark, d):
    r = fx.reg(spark, d)
    shaped = r.select("o_orderstatus", "c_acctbal", "c_nationkey", "y",
                      (F.col("y") / 2).alias("w1"), (F.col("y") / 4).alias("w2"),
                      (F.col("y") / 8).alias("w3"), (F.col("y") / 16).alias("w4"), "row_id")
    loaded = tables.load_table(spark, _csv(shaped), presets.SPECS["abalone"])
    return loaded.toDF(*[c.replace(" ", "_") for c in loaded.columns])


@query
def a2_preset_binary(spark, d):
    r = fx.missing(spark, d)
    marks = [((F.col("row_id") + i) % 10 + 1).cast("string").alias(f"m{i}") for i in range(8)]
    bare = F.when(F.col("o_orderpriority") == "?", "?").otherwise(
        (F.col("row_id") % 7).cast("string"))
    shaped = r.select("row_id", *marks[:5], bare.alias("bare"), *marks[5:],
                      F.when(F.col("c_acctbal") < 2000, 4).otherwise(2).alias("cls"))
    loaded = tables.load_table(spark, _csv(shaped), presets.SPECS["bcw"])
    return loaded.toDF(*[c.replace(" ", "_") for c in loaded.columns])


@query
def a2_file_to_model_binary(spark, d):
    """A file shaped like the census table: missing markers, text labels, more of the first label."""
    r = fx.missing(spark, d)

    def part(i, k):
        return F.concat(F.lit(f"p{i}_"), ((F.col("row_id") * (i + 3)) % k).cast("string"))

    shaped = r.select(
        F.col("c_nationkey"), part(0, 5), F.col("row_id"), part(1, 7), F.col("row_id") % 11, F.col("c_mktsegment"),
        F.col("o_orderpriority"), part(2, 13), part(3, 17), part(4, 19), F.floor("c_acctbal"), F.col("row_id") % 23,
        F.col("row_id") % 29, F.col("o_orderstatus"),
        F.when((F.col("c_acctbal") < 7000) | (F.col("o_orderpriority") == "1-URGENT"), ">50K").otherwise("<=50K"))
    params = ModelParams(task="binary", nb_trees=2, max_depth=2, learning_rate=0.5)
    model, rows = files.train_file(spark, _csv(shaped), presets.SPECS["adult"], params)
    return rounded(model.transform(rows).select("age", "capital_gain", "occupation", "income", "prediction"),
                   ["prediction"])


@query
def a2_file_to_model_wide(spark, d):
    """A file with 90 numeric columns and the target first."""
    e = fx.table(spark, d, "embeddings")

    def entry(i):
        return F.col("embedding")[i].cast("double")

    shaped = e.select(F.col("label") + 1990, *[F.floor(entry(i) * 1000) for i in range(64)],
                      *[F.floor(entry(i) * entry(i + 1) * 100000) for i in range(26)])
    params = ModelParams(nb_trees=1, max_depth=2, learning_rate=0.5)
    model, rows = files.train_file(spark, _csv(shaped), presets.SPECS["yearMSD"], params)
    return rounded(model.transform(rows).select("year", "audio_1", "audio_90", "prediction"), ["prediction"])


@query
def a3_read_tabs(spark, d):
    spec = TableSpec("customer", ("id", "name", "nation", "balance", "segment"), target="balance",
                     categorical=("nation", "segment"), row_id="id", sep="\t", header=True)
    return tables.load_table(spark, _csv(fx.table(spark, d, "customer"), "\t", True), spec)


@query
def a4_append_tables(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_acctbal").alias("balance"),
                                              F.col("c_custkey").alias("id"))
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"),
                                              F.col("s_acctbal").alias("balance"))
    return tables.append_tables(c, s)


@query
def a5_take_first(spark, d):
    return tables.take_first(fx.reg(spark, d), 12_000, "row_id")


@query
def a6_sample_n(spark, d):
    return tables.sample_n(fx.missing(spark, d), 700, SEED)


@query
def a7_write_results(spark, d):
    means = reports.mean_scores(fx.scored(spark, d), "rmse", ("dataset", "config", "budget"))
    path = f"{Scratch(spark).path}/results"
    results.write_results(rounded(means, ["mean", "std"], 4), path)
    return results.read_results(spark, path, means.schema)


# -- projection, filter, cleaning, encoding ------------------------------------------------

@query
def b1_drop_columns(spark, d):
    return cleaning.drop_columns(fx.reg(spark, d), ["c_nationkey", "c_mktsegment"])


@query
def b2_drop_missing(spark, d):
    return cleaning.drop_missing(fx.missing(spark, d), "?")


@query
def b3a_label_encode_sorted(spark, d):
    return cleaning.label_encode(fx.reg(spark, d), fx.CATEGORICAL, "sorted")


@query
def b3b_label_encode_first_seen(spark, d):
    return cleaning.label_encode(fx.reg(spark, d), fx.CATEGORICAL, "first_seen", "row_id")


@query
def b4_map_values(spark, d):
    r = cleaning.map_values(fx.reg(spark, d), "o_orderstatus", {"F": 1, "O": 2}, 3)
    return cleaning.map_values(r, "o_orderpriority", {"1-URGENT": 1}, -1)


@query
def b5_minority_positive(spark, d):
    return cleaning.minority_positive(fx.binary(spark, d), "y")


@query
def b6_quantile_bin(spark, d):
    r = fx.reg(spark, d)
    plain = cleaning.quantile_bin(r, "y", 4, "row_id")
    return cleaning.quantile_bin(plain, "c_acctbal", 2, "row_id", True, "signed_bin").select(
        "row_id", "y", "bin", "signed_bin")


@query
def b7_select_target(spark, d):
    both = risk.potential_cost(risk.loss_probability(fx.company(spark, d)))
    kept = both.select("row_id", "company_size", risk.LOSS, risk.COST)
    return rounded(cleaning.select_target(kept, "cost", presets.OBJECTIVES), ["y"], 2)


@query
def b8_scale_target(spark, d):
    scaled, _ = cleaning.scale_target(fx.reg(spark, d), "y")
    return rounded(scaled.select("row_id", "y"), ["y"], 9)


@query
def b9_unscale(spark, d):
    scaled, scaler = cleaning.scale_target(fx.reg(spark, d), "y")
    moved = scaled.select("row_id", (F.col("y") * 0.5).alias("p"))
    return rounded(cleaning.unscale(moved, "p", scaler), ["p"], 4)


@query
def b10_clamp(spark, d):
    return fx.reg(spark, d).select("row_id", clamp("c_acctbal", 0.0, 5000.0).alias("clamped"))


@query
def b11_scale_features_private(spark, d):
    r = fx.reg(spark, d)
    scaled = quantile.scale_features_private(r, ["c_acctbal", "y"], 90.0, 4.0, (0.0, 10.0),
                                             -2000.0, 600000.0, SEED)
    return rounded(scaled.select("row_id", "c_acctbal", "y"), ["c_acctbal", "y"], 5)


# -- ordering, splits, sampling ------------------------------------------------------------

@query
def c0_global_rank(spark, d):
    return ranking.global_rank(fx.reg(spark, d).select("row_id", "y"), ["y", "row_id"])


@query
def c1_train_test_split(spark, d):
    return splits.train_test_split(fx.reg(spark, d).select("row_id", "y"), 0.7, "row_id", False)


@query
def c2_kfold(spark, d):
    r = fx.reg(spark, d).select("row_id", "y")
    plain = splits.kfold(r, 7, "row_id", False).withColumnRenamed("fold", "block")
    return splits.kfold(plain, 7, "row_id", True, SEED)


@query
def c3_shuffle(spark, d):
    return splits.shuffle(fx.reg(spark, d).select("row_id", "y"), SEED, position="position")


@query
def c4_subset(spark, d):
    ids = fx.table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_orderkey").alias("row_id"))
    return splits.subset(fx.reg(spark, d), ids)


@query
def c5_remove_rows(spark, d):
    ids = fx.table(spark, d, "lineitem").where("l_quantity > 45").select(
        F.col("l_orderkey").alias("row_id"))
    return splits.remove_rows(fx.reg(spark, d), ids)


@query
def c6_partition_balanced(spark, d):
    return splits.partition_balanced(fx.reg(spark, d).select("row_id", "y"), 7, SEED)


@query
def c7_partition_geometric(spark, d):
    return splits.partition_geometric(fx.reg(spark, d).select("row_id", "y"), 20, 0.2, SEED)


def _centred(spark, d):
    return fx.reg(spark, d).select("row_id", ((F.col("y") - 250000) / 200000).alias("grad"))


@query
def c8_gradient_filter_fill(spark, d):
    r = _centred(spark, d)
    return splits.gradient_filter(r, int(r.count() * 0.9), 0.9, SEED)


@query
def c9_gradient_filter_drop(spark, d):
    r = _centred(spark, d)
    return splits.gradient_filter(r, int(r.count() * 0.9), 0.9, SEED, mode="drop")


@query
def c10_gradient_filter_clip(spark, d):
    return splits.gradient_filter(_centred(spark, d), None, 0.9, mode="clip")


# -- losses --------------------------------------------------------------------------------

@query
def d1_regression_init(spark, d):
    return fx.reg(spark, d).agg(rd(losses.Regression().init_aggregate("y"), 4).alias("init"))


@query
def d2_binary_init(spark, d):
    flipped = cleaning.minority_positive(fx.binary(spark, d), "y")
    return flipped.agg(rd(losses.Binary().init_aggregate("y"), 9).alias("init"))


@query
def d3_multiclass_init(spark, d):
    init = losses.Multiclass(3).init(fx.multi(spark, d), "y")
    out = spark.createDataFrame(list(enumerate(init)), "class_id int, init double")
    return rounded(out, ["init"], 9)


@query
def d4_regression_gradient(spark, d):
    r = fx.reg(spark, d).withColumn("pred", F.col("c_acctbal") * 30)
    return rounded(r.select("row_id", losses.Regression().gradient("y", ["pred"]).alias("grad")),
                   ["grad"], 4)


@query
def d5_binary_gradient(spark, d):
    r = fx.binary(spark, d).withColumn("pred", F.col("n_chars") / 5000 - 1)
    return rounded(r.select("row_id", losses.Binary().gradient("y", ["pred"]).alias("grad")),
                   ["grad"], 9)


@query
def d6_multiclass_gradient(spark, d):
    r = fx.multi(spark, d).withColumns({
        "p0": F.col("c_acctbal") / 5000, "p1": F.col("c_nationkey") / 20,
        "p2": (F.col("row_id") % 5) / 4})
    task, preds = losses.Multiclass(3), ["p0", "p1", "p2"]
    grads = [task.gradient("y", preds, k).alias(f"g{k}") for k in range(3)]
    return rounded(r.select("row_id", *grads), ["g0", "g1", "g2"], 9)


# -- split search --------------------------------------------------------------------------

BY = ["node_id"]


def _gains(spark, d):
    r = fx.gradients(spark, d)
    f = fx.features(r)
    hist = histogram.candidates_distinct(r, f, BY)
    chunks = histogram.ValueChunks.measure(r, f)
    return histogram.split_gain(hist, f, LAMBDA, BY, chunks)


def _utilities(spark, d):
    return selection.utility(_gains(spark, d), 0.05, 3.0)


SIDES = ["g_left", "g_right", "gain"]


@query
def e1_candidates_distinct(spark, d):
    r = fx.gradients(spark, d)
    return rounded(histogram.candidates_distinct(r, fx.features(r), BY), ["g"])


@query
def e2_candidates_grid(spark, d):
    r = fx.gradients(spark, d)
    f = fx.features(r, fx.NUMERIC, [])
    hist = histogram.candidates_grid(r, f, Grid(0, 10000, 500), BY)
    return rounded(histogram.split_gain(hist, f, LAMBDA, BY), SIDES).drop("category")


@query
def e3_candidates_declared(spark, d):
    r = fx.gradients(spark, d)
    f = fx.features(r, [], ["o_orderpriority"])
    declared = {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NEVER"]}
    out = histogram.candidates_declared(r, f, declared, BY).where("category IS NOT NULL")
    return rounded(out, ["g"]).drop("value")


@query
def e4_split_gain_numeric(spark, d):
    return rounded(_gains(spark, d).where("feature_idx < 2"), SIDES).drop("category")


@query
def e5_split_gain_categorical(spark, d):
    return rounded(_gains(spark, d).where("feature_idx >= 2"), SIDES).drop("value")


@query
def e6_sibling_gain(spark, d):
    r = fx.gradients(spark, d).withColumn("parent_id", F.lit(0)).withColumn(
        "side", (F.col("node_id") - 1).cast("int"))
    return rounded(histogram.sibling_gain(r, fx.features(r), LAMBDA), SIDES)


@query
def e7_utility(spark, d):
    return rounded(_utilities(spark, d).select(*BY, *histogram.CANDIDATE, "utility"), ["utility"])


@query
def e8_split_probabilities(spark, d):
    u = _utilities(spark, d)
    p = selection.split_probabilities(u, BY)
    q = selection.split_probabilities(u.withColumn("utility", F.col("utility") - 0.5), BY,
                                      include_zero=True)
    keys = [*BY, *histogram.CANDIDATE]
    both = p.select(*keys, rd("probability", 9).alias("probability"), F.lit("positive").alias("norm"))
    return both.unionByName(q.select(*keys, rd("probability", 9).alias("probability"),
                                     F.lit("all").alias("norm")))


@query
def e9_exponential_mechanism(spark, d):
    drawn = selection.exponential_mechanism(_utilities(spark, d), BY, SEED)
    low = selection.exponential_mechanism(_utilities(spark, d), BY, SEED, reverse=True)
    keep = [*BY, *histogram.CANDIDATE, "n_left", "n_right", "utility"]
    out = drawn.select(*keep, F.lit("high").alias("prefers")).unionByName(
        low.select(*keep, F.lit("low").alias("prefers")))
    return rounded(out, ["utility"])


@query
def e10_split_cdf(spark, d):
    p = selection.split_probabilities(_utilities(spark, d), BY)
    return rounded(selection.split_cdf(p, BY).select(*BY, *histogram.CANDIDATE, "cdf"), ["cdf"], 9)


@query
def e11_best_split(spark, d):
    return rounded(selection.best_split(_gains(spark, d), BY), SIDES)


@query
def e12_log_sum_exp(spark, d):
    r = fx.reg(spark, d).withColumn("x", F.col("c_acctbal") / 3)
    return rounded(selection.log_sum_exp(r, ["o_orderpriority"], "x"), ["lse"], 8)


# -- trees ---------------------------------------------------------------------------------

NODES = ["node_id", "is_leaf", "feature", "split_value", "split_category", "gain", "n",
         "prediction"]


def _tree_frame(spark, tree) -> DataFrame:
    return rounded(nodes_frame(spark, [[tree]]).select(*NODES), ["gain", "prediction"])


@query
def f1_route(spark, d):
    r = fx.gradients(spark, d)
    best = selection.best_split(_gains(spark, d), BY)
    return leaves.route(r, best, fx.features(r)).select("row_id", "node_id")


@query
def f2_fit_tree(spark, d):
    r = fx.gradients(spark, d)
    return _tree_frame(spark, growth.fit_tree(r, ModelParams(max_depth=2), fx.features(r)))


@query
def f3_fit_tree_best_first(spark, d):
    r = fx.gradients(spark, d)
    params = ModelParams(max_depth=2, growth="best_first", max_leaves=3)
    return _tree_frame(spark, growth.fit_tree(r, params, fx.features(r)))


@query
def f3_best_first_limit(spark, d):
    """Room for so few leaves that growth stops in the middle of a level."""
    r = fx.gradients(spark, d)
    params = ModelParams(max_depth=3, growth="best_first", max_leaves=4,
                         min_samples_split=r.count() * 15 // 100)
    return _tree_frame(spark, growth.fit_tree(r, params, fx.features(r)))


@query
def f4_fit_tree_sibling(spark, d):
    r = fx.gradients(spark, d)
    params = ModelParams(max_depth=2, growth="sibling")
    return _tree_frame(spark, growth.fit_tree(r, params, fx.features(r)))


@query
def f5_leaf_values(spark, d):
    return rounded(leaves.leaf_values(fx.gradients(spark, d), LAMBDA), ["leaf_value"], 9)


@query
def f6_leaf_values_multiclass(spark, d):
    r = fx.multi(spark, d).withColumns({
        "p0": F.col("c_acctbal") / 5000, "p1": F.col("c_nationkey") / 20,
        "p2": (F.col("row_id") % 5) / 4, "node_id": (F.col("row_id") % 4).cast("int")})
    task, preds, parts = losses.Multiclass(3), ["p0", "p1", "p2"], []
    for k in range(3):
        parts += [F.lit(k), (F.col("y") == k).cast("double"), task.gradient("y", preds, k)]
    long = r.select("node_id", F.stack(F.lit(3), *parts).alias("class_id", "y", "grad"))
    return rounded(leaves.leaf_values_multiclass(long, 3, LAMBDA), ["leaf_value"], 8)


@query
def f7_leaf_values_clipped(spark, d):
    bound = leaves.clip_bound(0.2, 0.1, 3)
    return rounded(leaves.leaf_values(fx.gradients(spark, d), LAMBDA, ["c_nationkey"], clip=bound),
                   ["leaf_value"], 9)


@query
def f8_leaf_values_private(spark, d):
    params = ModelParams(privacy_budget=2.0)
    noisy = leaves.leaf_values_private(
        fx.gradients(spark, d), LAMBDA, privacy.tree_budget(params), privacy.delta_v(params, 3),
        SEED, ["c_nationkey"], clip=privacy.leaf_threshold(params, 3))
    return rounded(noisy, ["leaf_value"], 8)


# -- boosting and scoring ------------------------------------------------------------------

PLAIN = ModelParams(nb_trees=2, max_depth=2, learning_rate=0.5)


def _plain_model(spark, d, params=PLAIN) -> tuple[DataFrame, BoostedModel]:
    r = fx.planted(spark, d)
    return r, PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)


def _binary_model(spark, d):
    r = cleaning.minority_positive(fx.binary(spark, d), "y")
    params = ModelParams(task="binary", nb_trees=2, max_depth=1, learning_rate=0.5)
    return r, PrivateBoostedTrees(params, ["n_chars"], ["lang", "source"]).fit(r)


def _multi_model(spark, d):
    r = fx.multi(spark, d)
    params = ModelParams(task="multiclass", n_classes=3, nb_trees=2, max_depth=1,
                         learning_rate=0.5)
    return r, PrivateBoostedTrees(params, fx.NUMERIC, fx.MULTI_CATEGORICAL).fit(r)


@query
def f9_node_stats(spark, d):
    r, model = _plain_model(spark, d)
    return rounded(model.node_stats(r), ["gradient_sum", "leaf_value"], 6)


@query
def h1_private_boosting(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=2, max_depth=1, learning_rate=0.5, privacy_budget=4.0, seed=SEED)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    model.ledger.check()
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"], 7)


@query
def h1_private_grid_scaled(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=2, max_depth=2, learning_rate=0.5, privacy_budget=4.0, seed=SEED,
                         candidates="grid", grid=Grid(0.0, 1.0, 0.0625),
                         scaling=FeatureScaling(1.0, -1000.0, 10000.0))
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    model.ledger.check()
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"], 7)


@query
def h1_private_boosting_filtered(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=3, max_depth=2, privacy_budget=2.0, gradient_filtering=True,
                         leaf_clipping=False, l2_threshold=0.5, seed=SEED)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    model.ledger.check()
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"], 7)


@query
def h1_private_boosting_dropped(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=3, max_depth=2, privacy_budget=8.0, gradient_filtering="drop",
                         l2_threshold=0.4, learning_rate=0.3, seed=SEED)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    model.ledger.check()
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"], 7)


@query
def h5_private_rejection(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=4, max_depth=1, learning_rate=0.5, privacy_budget=24.0, reject=True,
                         early_stop=2, allow_private_rejection=True, seed=SEED)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    model.ledger.check()
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"], 7)


@query
def h2_plain_boosting(spark, d):
    r, model = _plain_model(spark, d)
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"])


@query
def h3_multiclass_boosting(spark, d):
    r, model = _multi_model(spark, d)
    raw = model.transform(r)
    return raw.select("row_id", *[rd(F.col("prediction")[k]).alias(f"raw{k}") for k in range(3)])


@query
def h4_ensemble_schedule(spark, d):
    r = fx.reg(spark, d).select("row_id")
    params = ModelParams(nb_trees=6, trees_per_ensemble=3, privacy_budget=3.0)
    plan = {}
    for s in privacy.schedule(params):
        plan.setdefault(s["ensemble_id"], []).append(s)
    out = None
    for e, trees in plan.items():
        alloted = splits.partition_balanced(r, len(trees), f"{SEED}|{e}").select(
            "row_id", F.lit(e).alias("ensemble_id"), "tree_id",
            F.lit(trees[0]["budget"]).alias("budget"))
        out = alloted if out is None else out.unionByName(alloted)
    return out


@query
def h5_tree_rejection(spark, d):
    r = fx.planted(spark, d)
    params = ModelParams(nb_trees=3, max_depth=1, learning_rate=0.5, reject=True, shuffle=False)
    model = PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(r)
    return rounded(model.transform(r).select("row_id", "prediction"), ["prediction"])


@query
def h6_transform(spark, d):
    r, model = _plain_model(spark, d)
    again = BoostedModel.from_table(model.node_table(spark), model.params, model.features,
                                    model.init)
    return rounded(again.transform(r, "p").select("row_id", "y", "p"), ["y", "p"])


@query
def h7_predict_label(spark, d):
    r, model = _binary_model(spark, d)
    return model.predict_label(r).select("row_id", "label")


@query
def h7_predict_label_multiclass(spark, d):
    r, model = _multi_model(spark, d)
    return model.predict_label(r).select("row_id", "label")


@query
def h8_predict_proba(spark, d):
    r, model = _binary_model(spark, d)
    p = model.predict_proba(r)
    return p.select("row_id", *[rd(F.col("probability")[k]).alias(f"p{k}") for k in range(2)])


@query
def h9_signed_label(spark, d):
    r, model = _plain_model(spark, d)
    out = model.predict_proba(model.predict_label(r, signed=True), signed=True)
    return out.select("row_id", "label",
                      *[rd(F.col("probability")[k]).alias(f"p{k}") for k in range(2)])


@query
def h10_decision_path(spark, d):
    r, model = _plain_model(spark, d)
    path = model.decision_path(r, 0)
    return path.select("row_id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


# -- private order statistics --------------------------------------------------------------

@query
def g1_quantile_weights(spark, d):
    e = fx.table(spark, d, "events")
    w = quantile.quantile_weights(e, ["value"], 95.0, 0.5, 0.0, 1000.0)
    return rounded(w, ["log_weight"], 7)


@query
def g1_dp_quantile_interval(spark, d):
    e = fx.table(spark, d, "events")
    return rounded(quantile.dp_quantile_interval(e, ["value"], 95.0, 0.5, 0.0, 1000.0, SEED),
                   ["lower", "upper"])


# -- metrics, cross-validation, sweeps -----------------------------------------------------

@query
def k1a_rmse(spark, d):
    return fx.scored(spark, d).groupBy("config", "budget").agg(
        rd(metrics.rmse("y", "p"), 4).alias("rmse"))


@query
def k1b_error_rate(spark, d):
    r = fx.binary(spark, d).withColumn("p", (F.col("n_chars") % 3 > 0).cast("double"))
    return r.groupBy("lang").agg(rd(metrics.error_rate("y", "p")).alias("error_rate"),
                                 rd(metrics.accuracy("y", "p")).alias("accuracy"))


@query
def k1c_mape(spark, d):
    r = fx.scored(spark, d).withColumn("y", F.when(F.col("row_id") % 1000 == 0, 0.0)
                                       .otherwise(F.col("y")))
    return r.groupBy("config", "budget").agg(rd(metrics.mape("y", "p"), 2).alias("mape"))


@query
def k1d_score_summary(spark, d):
    folds = reports.fold_scores(fx.scored(spark, d), "rmse", ("config", "budget"))
    full = metrics.score_summary(folds, by=("config", "budget"))
    half = metrics.score_summary(folds, by=("config", "budget"), halve_std=True).select(
        "config", "budget", F.col("std").alias("half_std"))
    return rounded(full.join(half, ["config", "budget"]), ["mean", "std", "half_std"], 4)


COLUMNS = evaluation.Columns(fx.NUMERIC, fx.CATEGORICAL)


@query
def k2_cross_validate(spark, d):
    params = ModelParams(nb_trees=1, max_depth=1, learning_rate=0.5)
    out = evaluation.cross_validate(fx.planted(spark, d), params, 3, COLUMNS, shuffle=False)
    return rounded(out, ["score"])


@query
def k2_cross_validate_private(spark, d):
    params = ModelParams(nb_trees=2, max_depth=2, privacy_budget=2.0, seed=SEED)
    out = evaluation.cross_validate(fx.planted(spark, d), params, 3, COLUMNS, seed=SEED)
    return rounded(out, ["score"], 7)


@query
def k3_sweep(spark, d):
    base = ModelParams(seed=SEED)
    configs = {n: {**c, "nb_trees": 1, "max_depth": 2} for n, c in evaluation.CONFIGS.items()}
    out = evaluation.sweep(fx.planted(spark, d), evaluation.BUDGETS, configs, COLUMNS, base, 2, "orders",
                           seed=SEED)
    return rounded(out, ["mean", "std"], 6)


@query
def k4_complexity_sweep(spark, d):
    scores = reports.fold_scores(fx.scored(spark, d).where("config = 'plain'"), "mape",
                                 ("label", "n"))
    return rounded(evaluation.complexity_sweep(scores), ["mean", "std"], 5)


@query
def k4_complexity_scores(spark, d):
    r = fx.planted(spark, d).withColumn("cost", F.col("y") * 1000 + 2000)
    params = ModelParams(nb_trees=1, max_depth=1)
    out = evaluation.complexity_scores(r, evaluation.SAMPLE_SIZES, ["cost"], COLUMNS, params, 3, seed=SEED)
    return rounded(out, ["score"], 5)


@query
def k5_baseline_scores(spark, d):
    out = evaluation.baseline_scores(fx.reg(spark, d), "regression").unionByName(
        evaluation.baseline_scores(fx.binary(spark, d), "binary"))
    return rounded(out, ["prediction", "score"], 3)


@query
def k6_baseline_grid(spark, d):
    grid = {"trees": (2,), "depth": (2, 3), "learning_rate": (0.1,)}
    return evaluation.baseline_grid(fx.planted(spark, d), grid, COLUMNS, 2)[0]


# -- reports -------------------------------------------------------------------------------

@query
def r1_result_series(spark, d):
    out = reports.result_series(fx.scored(spark, d), "rmse", fx.CONFIGS, "plain")
    return rounded(out, [c for c in out.columns if c != "budget"], 4)


@query
def r2_error_extent(spark, d):
    return rounded(reports.error_extent(fx.scored(spark, d), "rmse"), ["low", "high"], 4)


@query
def r3_histogram(spark, d):
    h = reports.histogram(fx.table(spark, d, "events"), "value", 40)
    return rounded(h, ["bin_lo", "bin_hi"])


@query
def r4_complexity_curve(spark, d):
    plain = fx.scored(spark, d).where("config = 'plain'")
    out = reports.complexity_curve(plain, ["loss", "cost"])
    return rounded(out, [c for c in out.columns if c != "n"], 5)


@query
def r5_compare_runs(spark, d):
    s = fx.scored(spark, d)
    out = reports.compare_runs(s.where("config = 'clip'"), s.where("config = 'both'"), "rmse")
    return rounded(out, ["mean_a", "std_a", "mean_b", "std_b", "delta"], 4)


@query
def r6_trace(spark, d):
    params = ModelParams(nb_trees=2, max_depth=1, learning_rate=0.5)
    folded = splits.kfold(fx.planted(spark, d), 3, "row_id", False)
    models = COLUMNS.trainer(params).fit_folds(folded)
    return rounded(reports.trace(models, folded), ["gradient_sum", "leaf_sum"], 6)


@query
def r7_compare_tables(spark, d):
    s = fx.scored(spark, d)
    a = s.where("config = 'clip' AND budget = 1.0 AND row_id % 13 <> 0")
    b = s.where("config = 'clip' AND budget = 1.0 AND row_id % 17 <> 0").withColumn(
        "p", F.when(F.col("row_id") % 19 == 0, F.col("p") + 1).otherwise(F.col("p")))
    count, first = reports.compare_tables(a, b, ["row_id"], ["p"], 50)
    return first.withColumn("mismatches", F.lit(count).cast("bigint"))


# -- risk ----------------------------------------------------------------------------------

@query
def s1_feature_probability(spark, d):
    from quietgrove.functions import risk_tables as rt
    return fx.company(spark, d).select(
        "row_id", *[risk.feature_probability(f, rt.FEATURE_GIVEN_LOSS).alias(f"{f}_loss")
                    for f in rt.FEATURE_GIVEN_LOSS],
        *[risk.feature_probability(f, rt.FEATURE_PROBABILITY).alias(f)
          for f in ("company_has_2FA", "company_has_IDS")])


@query
def s2_cpt_lookup(spark, d):
    out = fx.company(spark, d)
    for t in ("R2PS", "PDTI", "PWD", "SOC", "IPS", "THREAT", "IOC", "IR"):
        out = risk.cpt_lookup(out, t, f"p_{t.lower()}")
    return out.select("row_id", *[c for c in out.columns if c.startswith("p_")])


@query
def s3_loss_probability(spark, d):
    out = risk.loss_probability(fx.company(spark, d))
    return rounded(out.select("row_id", risk.LOSS), [risk.LOSS], 9)


@query
def s4_potential_cost(spark, d):
    return rounded(risk.potential_cost(fx.company(spark, d)).select("row_id", risk.COST),
                   [risk.COST], 2)


@query
def s5_loss_probability_old(spark, d):
    return risk.loss_probability(fx.company(spark, d), "old").select("row_id", risk.LOSS)


@query
def s6_potential_cost_old(spark, d):
    return risk.potential_cost(fx.company(spark, d), "old", SEED).select("row_id", risk.COST)


@query
def s7_profile_distribution(spark, d):
    return risk.profile_distribution(fx.company(spark, d), [
        "company_size", "company_has_antivirus", "company_has_patching_process",
        "company_trains_employees_against_social_engineering"])


@query
def s8_augment_rows(spark, d):
    both = risk.potential_cost(risk.loss_probability(fx.company(spark, d)))
    base = both.select("row_id", risk.LOSS, risk.COST)
    return risk.augment_rows(base, 3, seed=SEED)
