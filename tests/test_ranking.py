import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietgrove.operators import ranking
from quietgrove.operators.prefix import chunk_of, running_sums
from quietgrove.operators.ranking import global_rank, position_cuts


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id bigint, v double")


def test_positions_match_a_sort(spark):
    values = [random.Random(i).choice([0.0, -5.5, 3.25, 1e9, i * 0.1]) for i in range(500)]
    df = frame(spark, values)
    ranked = {r["row_id"]: r["position"] for r in global_rank(df, ["v", "row_id"]).collect()}
    order = sorted((v, i) for i, v in enumerate(values))
    assert [ranked[i] for _, i in order] == list(range(500))


def test_cuts_narrow_through_hot_keys(spark, monkeypatch):
    # A third of the rows share one value; tiny limits force many narrowing passes.
    monkeypatch.setattr(ranking, "_DIRECT_ROWS", 3)
    monkeypatch.setattr(ranking, "_BUCKETS", 4)
    values = [7.0 if i % 3 == 0 else float((i * 37) % 101) / 7 for i in range(600)]
    order = sorted((v, i) for i, v in enumerate(values))
    wanted = [0, 1, 150, 299, 300, 301, 450, 598, 599]
    n, cuts = position_cuts(frame(spark, values), ["v", "row_id"], wanted)
    assert n == 600 and cuts == [order[p] for p in wanted]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-2 ** 62, 2 ** 62), min_size=1, max_size=40), st.data())
def test_cuts_of_any_longs(spark, keys, data):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i bigint")
    at = data.draw(st.integers(0, len(keys) - 1))
    limit, ranking._DIRECT_ROWS = ranking._DIRECT_ROWS, 2
    try:
        _, cuts = position_cuts(df, ["k", "i"], [at])
    finally:
        ranking._DIRECT_ROWS = limit
    assert cuts == [sorted((k, i) for i, k in enumerate(keys))[at]]


def test_text_keys_and_errors(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("qwertyuiop")], "k string, i bigint")
    _, cuts = position_cuts(df, ["k", "i"], [0, 9])
    assert [c[0] for c in cuts] == ["e", "y"]
    with pytest.raises(ValueError):
        position_cuts(df, ["i"], [10])
    with pytest.raises(ValueError):
        position_cuts(df.withColumn("z", F.lit(None).cast("bigint")), ["z"], [0])


def test_chunked_running_sums_equal_plain_ones(spark):
    df = spark.createDataFrame([(i % 2, float(i * 13 % 50), i % 5) for i in range(200)],
                               "grp int, v double, n bigint")
    df = df.groupBy("grp", "v").agg(F.sum("n").alias("n"))
    plain = running_sums(df, ["grp"], ["v"], ["n"], next_of="v")
    cut = running_sums(df, ["grp"], ["v"], ["n"], chunk_of("v", [3.0, 11.0, 40.0]), next_of="v")
    key = lambda d: sorted(tuple(r) for r in d.select(
        "grp", "v", "n", "before_n", "total_n", F.coalesce("next_v", F.lit(-1.0))).collect())
    assert key(plain) == key(cut)


def cuts_equal_a_sort(spark, monkeypatch, rows, schema, keys, order):
    monkeypatch.setattr(ranking, "_DIRECT_ROWS", 3)
    monkeypatch.setattr(ranking, "_cuts_by_rank", None)
    df = spark.createDataFrame(rows, schema).repartition(3)
    want = sorted((tuple(r[order.index(k)] if k in order else r[0] for k in keys) for r in rows),
                  key=lambda t: tuple(v.encode() if isinstance(v, str) else v for v in t))
    at = sorted({0, 1, len(rows) // 3, len(rows) // 2, len(rows) - 2, len(rows) - 1} - {-1})
    n, cuts = position_cuts(df, keys, at)
    assert n == len(rows) and cuts == [want[p] for p in at]


def test_texts_are_searched_by_their_bytes(spark, monkeypatch):
    rng = random.Random(3)
    words = ["", "a", "a\0", "aa", "ab", "abcdef", "abcdefg", "abcdef\0", "é", "zz", "日本語", "😀", "\uffff", "A" * 239,
             "A" * 240]
    rows = [(i, rng.choice(words) + rng.choice(["", "x", "1"])[:240 - 239]) for i in range(400)]
    rows = [(i, w[:240]) for i, w in rows if len(w.encode()) <= 240]
    cuts_equal_a_sort(spark, monkeypatch, rows, "i int, w string", ["w", "i"], ["i", "w"])


def test_decimals_are_searched_as_whole_numbers(spark, monkeypatch):
    from decimal import Decimal
    rng = random.Random(4)
    for kind, digits, scale in (("decimal(18,2)", 18, 2), ("decimal(38,18)", 38, 18), ("decimal(36,0)", 36, 0),
                                ("decimal(5,5)", 5, 5), ("decimal(30,10)", 30, 10)):
        numbers = [Decimal(0)] + [Decimal(s * rng.randrange(10 ** rng.randint(1, digits))).scaleb(-scale, ranking._EXACT)
                                  for _ in range(60) for s in (1, -1)]
        edge = Decimal(10 ** digits - 1).scaleb(-scale, ranking._EXACT)
        rows = [(i, rng.choice([*numbers, edge, edge.copy_negate()])) for i in range(300)]
        cuts_equal_a_sort(spark, monkeypatch, rows, f"i int, v {kind}", ["v", "i"], ["i", "v"])


def test_folds_and_bins_on_text_and_decimal_ids(spark, monkeypatch):
    from quietgrove.operators import cleaning, splits
    from quietgrove.sources.tables import take_first
    monkeypatch.setattr(ranking, "_DIRECT_ROWS", 3)
    rows = [(i, f"id-{i * 7919 % 1000:04d}", i / 8) for i in range(300)]
    df = spark.createDataFrame(rows, "n int, k string, v double").withColumns(
        {"d": F.col("v").cast("decimal(20,3)")})
    want = {k: p * 3 // 300 for p, k in enumerate(sorted(k for _, k, _ in rows))}
    ranked = [r for r in splits.kfold(df, 3, "k", False).collect()]
    assert {r["k"]: r["fold"] for r in ranked} == want
    assert {r["k"] for r in take_first(df, 7, "k").collect()} == set(sorted(want)[:7])
    assert {r["n"] for r in take_first(df, 7, "d").collect()} == set(range(7))
    by_decimal = {r["n"]: r["bin"] for r in cleaning.quantile_bin(df, "d", 4, "k").collect()}
    assert by_decimal == {r["n"]: r["bin"] for r in cleaning.quantile_bin(df, "v", 4, "n").collect()}
    # longer texts are ranked
    long = df.withColumn("k", F.concat(F.lit("x" * 300), "k"))
    assert {r["n"]: r["fold"] for r in splits.kfold(long, 3, "k", False).collect()} == {
        r["n"]: r["fold"] for r in ranked}


def test_cdf_in_chunks_equals_one_window(spark):
    from quietgrove.operators import selection
    rows = [(n, f, None if f == 2 else float(v * 7 % 101), f"c{v * 31 % 97:03d}é" if f == 2 else None, 1 / 512)
            for n in (0, 1) for f in range(3) for v in range(97)]
    cands = spark.createDataFrame(rows, "node_id int, feature_idx int, value double, category string, probability double")
    whole = {tuple(r) for r in selection.split_cdf(cands, ["node_id"]).collect()}
    cut = selection.split_cdf(cands, ["node_id"], rows_per_chunk=20)
    assert {tuple(r) for r in cut.collect()} == whole and len(whole) == len(rows)
    assert "struct" in selection._cdf_chunk(cands, 20) and selection._cdf_chunk(cands, 10 ** 6) == "feature_idx"
