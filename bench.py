"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)

``train_*_per_tree`` are seconds per tree at depth 6, the figure published for
single-process trainers; the others are whole queries, with every result row computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
TREES = 3
CATALOG = ("b3a_label_encode_sorted", "b6_quantile_bin", "c0_global_rank", "c2_kfold",
           "c7_partition_geometric", "c8_gradient_filter_fill", "e4_split_gain_numeric",
           "e9_exponential_mechanism", "f2_fit_tree", "g1_dp_quantile_interval",
           "h1_private_boosting", "h2_plain_boosting", "h3_multiclass_boosting",
           "k2_cross_validate", "r1_result_series", "s4_potential_cost", "s8_augment_rows")


def session() -> SparkSession:
    return (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
            .config("spark.sql.shuffle.partitions", str(CPUS))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false").getOrCreate())


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from quietgrove.catalog import fixtures as fx
    from quietgrove.catalog.queries import QUERIES
    from quietgrove.operators.splits import kfold
    from quietgrove.plans.boosting import PrivateBoostedTrees
    from quietgrove.plans.evaluation import BUDGETS
    from quietgrove.plans.model import BoostedModel
    from quietgrove.sources.tables import take_first
    from quietgrove.spec import Grid, ModelParams

    rows = fx.planted(spark, SF_DIR)
    n = rows.count()
    base = dict(nb_trees=TREES, max_depth=6, learning_rate=0.1, seed="bench")

    def train(**changes):
        params = ModelParams(**{**base, **changes})
        return PrivateBoostedTrees(params, fx.NUMERIC, fx.CATEGORICAL).fit(rows)

    train(nb_trees=1)  # warm-up
    seconds = {}

    def timed(name, run, divide=1):
        began = time.time()
        out = run()
        seconds[name] = round((time.time() - began) / divide, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        return out

    model = timed("train_plain_per_tree", lambda: train(), TREES)
    timed("train_private_per_tree", lambda: train(privacy_budget=1.0), TREES)
    timed("train_private_filtered_per_tree",
          lambda: train(privacy_budget=1.0, gradient_filtering=True), TREES)
    timed("train_private_sibling_per_tree",
          lambda: train(privacy_budget=1.0, growth="sibling"), TREES)
    timed("train_private_grid_per_tree",
          lambda: train(privacy_budget=1.0, candidates="grid", grid=Grid(0.0, 10_000.0, 100.0)), TREES)
    small = take_first(rows, 5_000, "row_id")
    few = ModelParams(**{**base, "nb_trees": 5})

    def on_small(**changes):
        return PrivateBoostedTrees(few.with_(**changes), fx.NUMERIC, fx.CATEGORICAL).fit(small)

    timed("train_plain_5000_rows_per_tree", on_small, 5)
    timed("train_private_5000_rows_per_tree", lambda: on_small(privacy_budget=1.0), 5)
    timed("train_private_sibling_5000_rows_per_tree",
          lambda: on_small(privacy_budget=1.0, growth="sibling"), 5)
    wide = fx.wide(spark, SF_DIR)
    columns = [c for c in wide.columns if c.startswith("f_")]
    timed("train_private_wide_per_tree", lambda: PrivateBoostedTrees(
        few.with_(privacy_budget=1.0), columns, target="label", row_id="vec_id").fit(wide), 5)
    folded = kfold(small, 2, "row_id", seed="bench")
    timed("train_private_21_budgets", lambda: PrivateBoostedTrees(
        few.with_(nb_trees=1), fx.NUMERIC, fx.CATEGORICAL).fit_budgets(folded, BUDGETS))
    many = BoostedModel(model.params, model.features, model.init, model.trees * (50 // TREES + 1))
    timed("score_51_trees", lambda: consume(many.transform(rows)))
    timed("score", lambda: consume(model.transform(rows)))
    for name in CATALOG:
        timed(name, lambda: consume(QUERIES[name](spark, SF_DIR)))
    print(json.dumps({"metric": "sum of headline query times", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
                      "training_rows": n, "cpus": CPUS}))


if __name__ == "__main__":
    main()
