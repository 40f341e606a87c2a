import pytest
from pyspark.sql import functions as F

from quietgrove.operators import cleaning, quantile, risk
from quietgrove.plans import evaluation, reports
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.sources import presets, results, tables
from quietgrove.spec import ModelParams, TableSpec
from quietgrove.streaming.scoring import score_stream, write_scores


def test_presets_have_the_known_shapes():
    sizes = {n: len(s.columns) for n, s in presets.SPECS.items()}
    assert (sizes["abalone"], sizes["yearMSD"], sizes["adult"], sizes["bcw"]) == (9, 91, 15, 11)
    assert len(presets.SPECS["questionnaires"].features) == 41
    assert presets.SPECS["adult"].role("fnlwgt") == "drop"
    assert presets.SPECS["synthetic_A"].target == "company_suffers_a_loss"
    assert presets.synthetic("B", "cost").target == "cost_of_loss"
    with pytest.raises(ValueError):
        TableSpec("x", ("a",), target="b")


def test_missing_marker_in_a_dropped_column_drops_the_row(spark, tmp_path):
    line = ["39, State-gov, {}, Bachelors, 13, x, y, z, w, Male, 0, 0, 40, US, <=50K"]
    (tmp_path / "adult.data").write_text("\n".join(
        line[0].format(v) for v in ("77516", "?", "5")) + "\n")
    df = tables.load_table(spark, str(tmp_path / "adult.data"), presets.SPECS["adult"])
    assert df.count() == 2 and "fnlwgt" not in df.columns
    assert df.first()["workclass"] == "State-gov" and dict(df.dtypes)["age"] == "double"


def test_result_files_with_missing_trailing_fields(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "dataset,nb_samples,nb_trees,use_dp,privacy_budget,mean,std,glc,gdf\n"
        "abalone,4177,10,true,0.5,3.3,0.2\n")
    r = results.read_results(spark, str(tmp_path / "r.csv")).first()
    assert r["mean"] == 3.3 and r["glc"] is None
    out = results.read_results(spark, str(tmp_path / "r.csv"))
    results.write_results(out, str(tmp_path / "o"), "parquet")
    assert results.read_results(spark, str(tmp_path / "o"), format="parquet").count() == 1


def test_label_codes_for_huge_dictionaries_agree(spark, planted, monkeypatch):
    cols = ["o_orderstatus", "o_orderpriority"]
    for order in ("sorted", "first_seen"):
        small = cleaning.label_encode(planted, cols, order, "row_id")
        monkeypatch.setattr(cleaning, "BROADCAST_CATEGORIES", 1)
        large = cleaning.label_encode(planted, cols, order, "row_id")
        assert small.exceptAll(large).count() == 0 and large.count() == planted.count()
        monkeypatch.undo()


def test_take_first_and_sample_by_cut(spark, planted):
    top = planted.orderBy("row_id").limit(50)
    draw = tables.sample_n(planted, 50, "s")
    assert tables.take_first(planted, 50, "row_id").exceptAll(top).count() == 0
    again = tables.sample_n(planted, 50, "s")
    assert again.count() == 50 and again.exceptAll(draw).count() == 0
    assert tables.take_first(planted, 10 ** 6, "row_id").count() == planted.count()


def test_scaling_round_trip_and_public_bounds(spark):
    df = spark.createDataFrame([(-7.0,), (3.0,), (13.0,)], "y double")
    scaled, s = cleaning.scale_target(df, "y")
    assert sorted(r["y"] for r in scaled.collect()) == [-1.0, 0.0, 1.0]
    back = sorted(r["y"] for r in cleaning.unscale(scaled, "y", s).collect())
    assert back == pytest.approx([-7.0, 3.0, 13.0])
    inside, s = cleaning.scale_target(df.withColumn("y", F.col("y") / 100), "y")
    assert not s.required
    clipped, s = cleaning.scale_target(df, "y", bounds=(0, 10))
    assert not s.exact and min(r["y"] for r in clipped.collect()) == -1.0
    flat, _ = cleaning.scale_target(df.withColumn("y", F.lit(5.0)), "y")
    assert {r["y"] for r in flat.collect()} == {-1.0}


def test_quantiles_ignore_missing_values(spark):
    rows = [(float(v), float(v) if v % 4 == 1 else None) for v in range(1, 200, 2)]
    gappy = spark.createDataFrame(rows + [(None, None)] * 100, "a double, b double")
    args = (["a", "b"], 90.0, 20.0, 0.0, 200.0)
    got = {tuple(r) for r in quantile.quantile_weights(gappy, *args).collect()}
    for i, c in enumerate("ab"):
        whole = gappy.select(c).dropna()
        alone = quantile.quantile_weights(whole, [c], *args[1:]).collect()
        assert {(i, *r[1:]) for r in alone} == {r for r in got if r[0] == i}
    empty = gappy.withColumn("b", F.lit(None).cast("double"))
    assert {r["feature_idx"] for r in quantile.quantile_weights(empty, *args).collect()} == {0}


def test_quantile_weights_by_definition(spark):
    values = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = quantile.quantile_weights(df, ["v"], 80.0, 2.0, 0.0, 10.0).collect()
    import math
    padded = [0.0, *values, 10.0]
    for side, q in enumerate(quantile.bounds_of(80.0)):
        m = math.floor((len(values) - 1) * q + 1.5)
        want = {}
        for i in range(len(values) + 1):
            width = padded[i + 1] - padded[i]
            if width > 0:
                u = i + 1 - m if i < m else m - i
                want[i] = math.log(width) + 1.0 * u / 2
        got = {r["gap"]: r["log_weight"] for r in rows if r["side"] == side}
        assert got == {i: pytest.approx(w) for i, w in want.items()}
    drawn = quantile.dp_quantile_interval(df, ["v"], 80.0, 500.0, 0.0, 10.0, "s").first()
    assert 0.0 <= drawn["lower"] <= 2.0 and 5.0 <= drawn["upper"] <= 10.0


def test_private_feature_scaling_stays_inside(spark, planted):
    out = quantile.scale_features_private(planted, ["c_acctbal"], 90.0, 50.0, (0.0, 1.0),
                                          -2000.0, 12000.0, "s")
    r = out.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    assert r[0] == 0.0 and r[1] == 1.0


def test_complexity_and_baseline(spark, planted):
    cols = evaluation.Columns(["c_acctbal"], ["o_orderpriority"])
    p = ModelParams(nb_trees=1, max_depth=1, learning_rate=1.0)
    scores = evaluation.cross_validate(planted, p, 2, cols, seed="s")
    base = evaluation.baseline_scores(planted, "regression").first()["score"]
    assert max(r["score"] for r in scores.collect()) < base
    assert sum(r["n"] for r in scores.collect()) == planted.count()
    one = reports.histogram(planted, "c_acctbal", 7)
    assert one.agg(F.sum("n")).first()[0] == planted.count()
    count, _ = reports.compare_tables(planted, planted, ["row_id"], ["y"])
    assert count == 0


def test_augmented_targets_keep_mean_and_deviation(spark):
    df = spark.createDataFrame([(1, 0.2, 500.0)], "row_id bigint, company_suffers_a_loss double, "
                                                  "cost_of_loss double")
    r = risk.augment_rows(df, 20000, seed="a").agg(
        F.avg("cost_of_loss").alias("m"), F.stddev_pop("cost_of_loss").alias("s"),
        F.max("company_suffers_a_loss").alias("top")).first()
    assert r["m"] == pytest.approx(500, rel=0.01) and r["s"] == pytest.approx(75, rel=0.05)
    assert r["top"] <= 1.0


def test_streamed_scores_equal_batch_scores(spark, planted, tmp_path):
    model = PrivateBoostedTrees(ModelParams(nb_trees=2, max_depth=2), ["c_acctbal"],
                                ["o_orderpriority"]).fit(planted)
    source = str(tmp_path / "in")
    planted.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(planted.schema).parquet(source)
    query = write_scores(score_stream(model, stream).select("row_id", "prediction"),
                         str(tmp_path / "out"), "test")
    query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = model.transform(planted).select("row_id", "prediction")
    assert streamed.count() == planted.count() and streamed.exceptAll(batch).count() == 0
