import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import gain, goes_left
from quietgrove.catalog import fixtures as fx
from quietgrove.operators import histogram, selection
from quietgrove.spec import Feature, Grid

LAM = 0.1


@pytest.fixture(scope="module")
def data(spark, sf):
    df = fx.gradients(spark, sf).where("row_id % 5 = 0")
    pdf = df.toPandas()
    return df, pdf, fx.features(df)


def value_of(row):
    return row["value"] if row["value"] is not None else row["category"]


def chunks_for(features):
    return histogram.ValueChunks(features, {"c_acctbal": [0.0, 2000.0, 7000.0]},
                                 {"o_orderpriority": 2})


@pytest.mark.parametrize("chunked", [False, True])
def test_gains_equal_brute_force(data, chunked):
    df, pdf, features = data
    hist = histogram.candidates_distinct(df, features, ["node_id"])
    got = histogram.split_gain(hist, features, LAM, ["node_id"],
                               chunks_for(features) if chunked else None).collect()
    want = 0
    for node, part in pdf.groupby("node_id"):
        g = part["grad"].to_numpy()
        for f in features:
            col = part[f.name].to_numpy()
            for v in set(col):
                want += gain(g, goes_left(col, v, f.is_cat), LAM) is not None
    assert len(got) == want
    for r in got:
        part = pdf[pdf.node_id == r["node_id"]]
        f = features[r["feature_idx"]]
        left = goes_left(part[f.name].to_numpy(), value_of(r), f.is_cat)
        assert r["n_left"] == left.sum()
        assert r["gain"] == pytest.approx(gain(part["grad"].to_numpy(), left, LAM), rel=1e-9)


def test_sibling_gains_equal_brute_force(data):
    df, pdf, features = data
    both = df.withColumn("parent_id", F.lit(0)).withColumn("side", (F.col("node_id") - 1).cast("int"))
    for chunks in (None, chunks_for(features)):
        got = histogram.sibling_gain(both, features, LAM, chunks=chunks).collect()
        assert len({(r["side"], r["feature_idx"], value_of(r)) for r in got}) == len(got)
        for r in got:
            f = features[r["feature_idx"]]
            pooled = goes_left(pdf[f.name].to_numpy(), value_of(r), f.is_cat)
            assert r["gain"] == pytest.approx(gain(pdf["grad"].to_numpy(), pooled, LAM), rel=1e-9)
            own = pdf[pdf.node_id == r["side"] + 1]
            assert r["n_left"] == goes_left(own[f.name].to_numpy(), value_of(r), f.is_cat).sum()


def test_grid_points_compare_like_the_rows(spark):
    values = [i * 0.1 for i in range(-3, 14)] + [0.3, 0.7, 0.1 + 0.2, 0.35]
    df = spark.createDataFrame([(v, float(i % 3) - 1) for i, v in enumerate(values)],
                               "x double, grad double")
    grid = Grid(0.0, 1.0, 0.1)
    assert grid.size == 10
    f = [Feature(0, "x")]
    got = histogram.split_gain(histogram.candidates_grid(df, f, grid), f, LAM).collect()
    x = np.array(values)
    assert len(got) == 10
    for r in got:
        assert r["n_left"] == (x < r["value"]).sum()


def test_declared_categories_count_unknown_ones(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("zz", 2.0)], "c string, grad double")
    f = [Feature(0, "c", True, True)]
    hist = histogram.candidates_declared(df, f, {"c": ["a", "b", "never"]})
    got = {r["category"]: r for r in histogram.split_gain(hist, f, LAM).collect()}
    assert set(got) == {"a", "b"}  # "never" leaves one side empty
    assert got["a"]["n_right"] == 2 and got["a"]["g_right"] == pytest.approx(1.0)


def candidates(spark, utilities):
    return spark.createDataFrame(
        [(0, i, float(i), None, u) for i, u in enumerate(utilities)],
        "node_id int, feature_idx int, value double, category string, utility double")


def test_probabilities_and_cdf(spark):
    cands = candidates(spark, [1000.0, 1001.0, 0.0, -3.0])  # exp would overflow
    p = {r["feature_idx"]: r["probability"]
         for r in selection.split_probabilities(cands, ["node_id"]).collect()}
    z = 1 + math.e
    assert p[0] == pytest.approx(1 / z) and p[1] == pytest.approx(math.e / z)
    assert p[2] == p[3] == 0
    cdf = selection.split_cdf(selection.split_probabilities(cands, ["node_id"]), ["node_id"])
    assert max(r["cdf"] for r in cdf.collect()) == pytest.approx(1.0)
    none = candidates(spark, [0.0, -1.0])
    assert {r["probability"] for r in selection.split_probabilities(none).collect()} == {0.0}


def test_exponential_mechanism_follows_its_distribution(spark):
    utilities = [0.5, 1.0, 2.0, 0.0]
    n = 6000
    cands = candidates(spark, utilities).drop("node_id").withColumn(
        "node_id", F.explode(F.sequence(F.lit(1), F.lit(n))))
    drawn = Counter(r["feature_idx"] for r in
                    selection.exponential_mechanism(cands, ["node_id"], "s").collect())
    positive = [u for u in utilities if u > 0]
    total = sum(math.exp(u) for u in positive)
    chi2 = sum((drawn[i] - n * math.exp(u) / total) ** 2 / (n * math.exp(u) / total)
               for i, u in enumerate(positive))
    assert drawn[3] == 0 and chi2 < 13.8  # 0.999 quantile with two degrees of freedom
    low = Counter(r["feature_idx"] for r in selection.exponential_mechanism(
        cands, ["node_id"], "s", reverse=True).collect())
    assert low[0] > low[1] > low[2]


def test_argmax_ties_go_to_the_first_feature(spark):
    cands = candidates(spark, [2.0, 3.0, 3.0]).withColumnRenamed("utility", "gain")
    assert selection.best_split(cands, ["node_id"]).first()["feature_idx"] == 1
    assert selection.best_split(cands.withColumn("gain", F.lit(0.0))).count() == 0
