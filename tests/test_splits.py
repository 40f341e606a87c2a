import math

from pyspark.sql import functions as F

from quietgrove.operators import splits


def rows(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_id")


def counts(df, col):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


def test_fold_sizes(spark):
    assert counts(splits.kfold(rows(spark, 23), 5, "row_id", False), "fold") == {
        0: 5, 1: 5, 2: 5, 3: 4, 4: 4}
    assert splits.fold_starts(3, 5) == [1, 2, 3, 3]
    shuffled = splits.kfold(rows(spark, 23), 5, "row_id", True, "s")
    assert sorted(counts(shuffled, "fold").values()) == [4, 4, 5, 5, 5]


def test_split_sizes(spark):
    part = splits.train_test_split(rows(spark, 10), 0.75, "row_id", False)
    assert sorted(r["row_id"] for r in part.where("is_test").collect()) == [0, 1, 2]
    assert splits.train_test_split(rows(spark, 10), 1.0, "row_id").where("is_test").count() == 0
    assert splits.train_test_split(rows(spark, 10), 0.0, "row_id").where("is_test").count() == 10


def test_quotas():
    for n in (0, 1, 7, 100, 101):
        for trees in (1, 3, 10):
            q = splits.balanced_quotas(n, trees)
            assert sum(q) == n and max(q) - min(q) <= 1
    q = splits.geometric_quotas(1000, 10, 0.1)
    assert q[0] == int(1000 * 0.1 / (1 - 0.9 ** 10)) and sum(q) <= 1000
    assert q == sorted(q, reverse=True)
    assert splits.geometric_quotas(5, 50, 0.1) == []


def test_allotments_are_disjoint_and_exact(spark):
    df = rows(spark, 1000)
    got = counts(splits.partition_geometric(df, 8, 0.3, "x"), "tree_id")
    want = splits.geometric_quotas(1000, 8, 0.3)
    assert [got[t] for t in range(8)] == want
    assert got.get(None, 0) == 1000 - sum(want)
    assert len(counts(splits.partition_balanced(df, 4, "x"), "tree_id")) == 4


def test_gradient_filter_modes(spark):
    df = rows(spark, 100).withColumn("grad", (F.col("row_id") - 50) / 25.0)
    inside = 51  # |g| <= 1
    few = splits.gradient_filter(df, 30, 1.0, "x")
    assert few.count() == 30 and few.where("abs(grad) > 1").count() == 0
    many = splits.gradient_filter(df, 70, 1.0, "x")
    assert many.count() == 70
    assert many.where("abs(grad) = 1").count() == 70 - inside + 2
    flagged = splits.gradient_filter(df, 70, 1.0, "x", keep_all=True)
    assert flagged.count() == 100
    assert flagged.where("not selected").agg(F.max(F.abs("grad"))).first()[0] > 1
    dropped = splits.gradient_filter(df, 100, 1.0, "x", mode="drop")
    assert dropped.count() == inside
    assert splits.gradient_filter(df, 0, 1.0, "x").count() == 0


def test_draws_do_not_depend_on_partitioning(spark):
    df = rows(spark, 200)
    a = splits.kfold(df.repartition(7), 4, "row_id", True, "s")
    b = splits.kfold(df.coalesce(1), 4, "row_id", True, "s")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    c = splits.kfold(df, 4, "row_id", True, "other")
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, c.collect()))


def test_ceil_follows_floats(spark):
    n = splits.train_test_split(rows(spark, 1500), 0.7, "row_id", False).where("is_test").count()
    assert n == math.ceil((1 - 0.7) * 1500)
