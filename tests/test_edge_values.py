"""Nulls, NaN, infinities, ties and limits: results must not depend on size or representation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quietgrove.catalog import fixtures as fx
from quietgrove.functions.columns import clamp, floor_to
from quietgrove.operators import cleaning, prefix, ranking
from quietgrove.operators.histogram import gain_sql
from quietgrove.plans import coding
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.evaluation import Columns, cross_validate
from quietgrove.plans.privacy import training_ledger
from quietgrove.sources import results, tables
from quietgrove.spec import Grid, ModelParams


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(clamp("v", 0.0, 5.0)).collect()] == [None, 0.0, 5.0]


def test_floor_of_large_numbers(spark):
    values = [4.995e10, -12345.5, 1.2345678901234, 1e300, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(floor_to(F.col("v"), 15)).collect()]
    assert got[0] == values[0] and got[1] == values[1] and got[3:] == values[3:]
    gains = df.where("v > 0 AND v < 1e200").selectExpr(gain_sql("v", "1", "0.0D", "1", 0.0, True)).collect()
    assert gains[0][0] == pytest.approx(values[0] ** 2) and gains[1][0] == 1.5241578753


def test_a_missing_value_is_no_category(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "`odd ``name` string")
    codes = cleaning.category_codes(df, ["odd `name"])
    assert {r["category"]: r["code"] for r in codes.collect()} == {"a": 0.0, "b": 1.0}


@pytest.mark.parametrize("direct", [20_000, 3])
def test_positions_among_any_doubles(spark, monkeypatch, direct):
    monkeypatch.setattr(ranking, "_DIRECT_ROWS", direct)
    rng = random.Random(1)
    values = [rng.uniform(-5, 5) for _ in range(60)] + [float("inf")] * 3 + [float("-inf")] * 2 \
        + [float("nan")] * 4 + [1.7e308, -1.7e308, 0.0, -0.0, 1e-300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    n, cuts = ranking.position_cuts(df, ["v", "i"], list(range(len(values))))
    order = sorted(range(n), key=lambda i: (values[i] != values[i], 0.0 if values[i] != values[i] else values[i], i))
    assert [c[1] for c in cuts] == order


@pytest.mark.parametrize("rows", [40, 12_000])
def test_first_rows_with_ties_and_nulls(spark, rows):
    df = spark.range(rows).select("id", F.when(F.col("id") % 4 > 0, F.floor(F.col("id") / 10)).alias("k"))
    want = [r["k"] for r in df.where("k IS NOT NULL").orderBy("k").limit(rows // 2).collect()]
    assert sorted(r["k"] for r in tables.take_first(df, rows // 2, "k").collect()) == want
    assert tables.take_first(df, 0, "k").count() == 0
    assert tables.take_first(df, rows, "k").count() == rows * 3 // 4
    assert tables.sample_n(df.withColumn("row_id", F.col("id")), rows // 2, "s").count() == rows // 2


def test_sweep_results_come_back(spark, tmp_path):
    row = ("clip", "d", 10, 5, True, 0.5, 0.41, 0.1, True, False)
    out = spark.createDataFrame([row], results.NAMED_SWEEP_SCHEMA)
    results.write_results(out, str(tmp_path / "s"))
    assert tuple(results.read_results(spark, str(tmp_path / "s")).first()) == row
    with pytest.raises(ValueError):
        results.write_results(out.withColumnRenamed("mean", "other"), str(tmp_path / "t"))
        results.read_results(spark, str(tmp_path / "t"))


def fit(df, **changes):
    params = ModelParams(**{**dict(nb_trees=1, max_depth=2, learning_rate=1.0, seed="s"), **changes})
    return PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(df)


@pytest.mark.parametrize("growth", ["levels", "sibling", "best_first"])
def test_grid_splits_stay_on_the_grid(spark, planted, growth):
    grown = {} if growth == "levels" else {"growth": growth}
    model = fit(planted, candidates="grid", grid=Grid(0.0, 50.0, 20.0), privacy_budget=2.0, **grown)
    nodes = [r for r in model.node_table(spark).collect() if not r["is_leaf"] and not r["is_cat"]]
    assert all(r["split_value"] % 20 == 0 for r in nodes)


def test_private_draws_do_not_depend_on_coding(spark, planted, monkeypatch):
    def trees():
        rows = fit(planted, privacy_budget=1.0, nb_trees=2).node_table(spark).orderBy("tree_id", "node_id")
        return [(r["tree_id"], r["node_id"], r["feature"], r["split_value"], r["split_category"]) for r in rows.collect()]

    coded = trees()
    monkeypatch.setattr(coding, "DICTIONARY_ROWS", 2)
    assert trees() == coded


def test_rows_without_a_feature_do_not_train(spark, planted):
    holes = planted.withColumn("c_acctbal", F.when(F.col("row_id") % 5 > 0, F.col("c_acctbal")))
    model = fit(holes)
    whole = holes.where("c_acctbal IS NOT NULL")
    root = model.node_table(spark).where("node_id = 0").first()
    assert root["n"] == whole.count()
    leaves = {r["node_id"]: r["n"] for r in model.node_table(spark).where("is_leaf").collect()}
    paths = model.decision_path(whole, 0).groupBy(F.element_at("path", -1).alias("leaf")).count().collect()
    assert {r["leaf"]: r["count"] for r in paths} == leaves


def test_exact_scaling_is_listed(monkeypatch, spark, planted):
    seen = []
    monkeypatch.setattr("quietgrove.plans.privacy.training_ledger", lambda p, **k: seen.append(k) or training_ledger(p, **k))
    wide = planted.withColumn("y", F.col("y") * 100)
    params = ModelParams(nb_trees=1, max_depth=1, privacy_budget=1.0, seed="s")
    cross_validate(wide, params, 2, Columns(fx.NUMERIC, fx.CATEGORICAL), seed="s")
    assert seen and all(k["exact_scaling"] for k in seen)
    assert "target minimum and maximum" in training_ledger(params, exact_scaling=True).unpaid
    assert math.isfinite(training_ledger(params).spent)
    assert training_ledger(params.with_(privacy_budget=5000.0)).budget == 1000.0
    assert training_ledger(params.with_(privacy_budget=5000.0, budget_cap=9e9)).check().budget == 5000.0


def test_chunk_limits_follow_distinct_values(spark):
    """Nine rows in ten have one value; chunks of the others still stay near the wanted size."""
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id") / 10).alias("v"))
    bounds = prefix.chunk_bounds(df, {"v": 4_000}, rows_per_chunk=500)["v"]
    assert len(bounds) == 8
    sizes = df.distinct().selectExpr(f"{prefix.chunk_of('v', bounds)} AS c").groupBy("c").count().collect()
    assert max(r["count"] for r in sizes) < 700
    empty = spark.sql(f"SELECT {prefix.chunk_of('CAST(NULL AS double)', bounds)}, {prefix.chunk_of('0.5D', [0.5, 1.0])}")
    assert tuple(empty.first()) == (0, 1)


def test_intermediate_tables_can_all_be_deleted(spark):
    import os
    from quietgrove import scratch
    kept = scratch.materialize(spark.range(5))
    folder = next(f for f in scratch._kept if kept.inputFiles()[0].split("file://")[-1].startswith(f))
    with scratch.Scratch(spark) as own:
        own.save(spark.range(3))
        assert own.path in scratch._kept
    assert own.path not in scratch._kept and not os.path.exists(own.path)
    others = scratch._kept - {folder}
    try:
        scratch._kept.difference_update(others)
        assert scratch.delete_all(spark) == 1 and not os.path.exists(folder) and not scratch._kept
    finally:
        scratch._kept.update(others)
