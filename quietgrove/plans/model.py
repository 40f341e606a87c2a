"""A trained ensemble. Scoring is stateless column arithmetic, so it needs no shuffle and
works the same on a streaming DataFrame."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import sigmoid
from quietgrove.functions.losses import argmax_class, task_of
from quietgrove.plans.privacy import Ledger
from quietgrove.plans.trees import (Node, Split, Tree, ancestors,
                                     nodes_frame)
from quietgrove.plans.walks import Lookup, boosted, looked_up
from quietgrove.spec import Feature, ModelParams


class BoostedModel:
    def __init__(self, params: ModelParams, features: Sequence[Feature], init: Sequence[float],
                 trees: Optional[list[list[Tree]]] = None, ledger: Optional[Ledger] = None):
        self.params, self.features, self.init = params, list(features), list(init)
        self.trees = trees if trees is not None else []
        self.ledger = ledger
        self.rejected = 0  # trees that were grown but not kept
        self.task = task_of(params.task, params.n_classes)

    # -- scoring -------------------------------------------------------------------------

    def with_raw(self, df: DataFrame, names: Sequence[str], rounds: Optional[int] = None) -> DataFrame:
        """Raw score per class after the first ``rounds`` rounds (all by default), as columns."""
        used = self.trees if rounds is None else self.trees[:rounds]
        return boosted(df, {name: (text.literal(float(s)), [[(None, r[k])] for r in used])
                            for k, (name, s) in enumerate(zip(names, self.init))},
                       self.params.learning_rate)

    def stages(self, df: DataFrame, prefix: str = "_stage") -> tuple[DataFrame, list[list[str]]]:
        """Raw scores before each round and after the last one, as columns. Each stage adds
        one round to the stage before it."""
        eta = self.params.learning_rate
        classes = range(len(self.init))
        names = [[f"{prefix}_{t}_{k}" for k in classes] for t in range(len(self.trees) + 1)]
        out = df.withColumns({names[0][k]: F.lit(float(self.init[k])) for k in classes})
        for t, round_ in enumerate(self.trees):
            out = boosted(out, {names[t + 1][k]: (names[t][k], [[(None, round_[k])]])
                                for k in classes}, eta)
        return out, names

    def _raw(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        names = [f"_raw_{k}" for k in range(len(self.init))]
        return self.with_raw(df, names), [F.col(n) for n in names]

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Raw prediction: a double, or an array with one score per class."""
        scored, raw = self._raw(df)
        out = scored.withColumn(name, raw[0] if len(raw) == 1 else F.array(*raw))
        return out.drop(*[f"_raw_{k}" for k in range(len(raw))])

    def predict_label(self, df: DataFrame, name: str = "label", signed: bool = False
                      ) -> DataFrame:
        """Class label. ``signed`` reads a regression on targets -1 and 1 as its sign."""
        scored, raw = self._raw(df)
        if signed:
            label = F.when(raw[0] >= 0, F.lit(1)).otherwise(F.lit(-1))
        elif self.params.task == "binary":
            label = (raw[0] >= 0).cast("int")  # sigmoid >= 1/2
        elif self.params.task == "multiclass":
            label = argmax_class(raw)
        else:
            raise ValueError("labels are not defined for regression")
        return scored.withColumn(name, label).drop(*[f"_raw_{k}" for k in range(len(raw))])

    def predict_proba(self, df: DataFrame, name: str = "probability", signed: bool = False
                      ) -> DataFrame:
        """Probability per class, as an array."""
        scored, raw = self._raw(df)
        if signed:
            p = sigmoid(F.abs(raw[0]))
            proba = F.when(raw[0] >= 0, F.array(F.lit(1.0) - p, p)).otherwise(
                F.array(p, F.lit(1.0) - p))
        elif self.params.task == "binary":
            p = sigmoid(raw[0])
            proba = F.array(F.lit(1.0) - p, p)
        elif self.params.task == "multiclass":
            proba = F.array(*[self.task.probability(raw, k) for k in range(len(raw))])
        else:
            raise ValueError("probabilities are not defined for regression")
        return scored.withColumn(name, proba).drop(*[f"_raw_{k}" for k in range(len(raw))])

    def decision_path(self, df: DataFrame, tree_id: int, class_id: int = 0,
                      name: str = "path") -> DataFrame:
        """Node ids from the root to the row's leaf. Node ids encode their ancestors, so the
        path is arithmetic on the leaf id."""
        found = looked_up(df, [leaf_of("_leaf", self.trees[tree_id][class_id])])
        return found.withColumn(name, ancestors(F.col("_leaf"))).drop("_leaf")

    # -- tables --------------------------------------------------------------------------

    def scaling_table(self, spark: SparkSession) -> DataFrame:
        """Private bounds of the scaled features: (column, lower, upper, lo, hi)."""
        return spark.createDataFrame(
            [(f.name, f.scaled.lower, f.scaled.upper, f.scaled.lo, f.scaled.hi)
             for f in self.features if f.scaled],
            "column string, lower double, upper double, lo double, hi double")

    def node_table(self, spark: SparkSession) -> DataFrame:
        return nodes_frame(spark, self.trees)

    def node_stats(self, df: DataFrame, target: str = "y") -> DataFrame:
        """Rows, gradient sum and would-be leaf value of every node on the rows' paths.

        Rows are first counted per leaf (partial aggregation); only those few sums are
        spread over the ancestors.
        """
        parts = []
        staged, raws = self.stages(df)
        staged = looked_up(staged, [leaf_of(f"_leaf_{t}_{k}", tree) for t, round_ in enumerate(self.trees)
                                    for k, tree in enumerate(round_)])
        for t, round_ in enumerate(self.trees):
            for k in range(len(round_)):
                parts += [F.lit(t), F.lit(k), F.col(f"_leaf_{t}_{k}"),
                          self.task.gradient(target, raws[t], k)]
        names = ["tree_id", "class_id", "leaf_id", "grad"]
        leaves = (staged.select(F.stack(F.lit(len(parts) // 4), *parts).alias(*names))
                  .groupBy(*names[:3]).agg(F.count(F.lit(1)).alias("n"), F.sum("grad").alias("g")))
        spread = leaves.select("tree_id", "class_id", "n", "g",
                               F.explode(ancestors(F.col("leaf_id"))).alias("node_id"))
        lam = F.lit(self.params.l2_lambda)
        value = F.when(F.col("node_id") == 0, F.lit(0.0)).otherwise(
            -F.col("gradient_sum") / (F.col("n") + lam))
        return (spread.groupBy("tree_id", "class_id", "node_id")
                .agg(F.sum("n").alias("n"), F.sum("g").alias("gradient_sum"))
                .withColumn("leaf_value", value))

    @classmethod
    def from_table(cls, nodes: DataFrame, params: ModelParams, features: Sequence[Feature],
                   init: Sequence[float]) -> "BoostedModel":
        """Rebuild a model from its node table (small: one row per tree node)."""
        by_name = {f.name: f for f in features}
        trees: dict = {}
        for r in nodes.collect():
            node = Node(r["node_id"], r["n"], prediction=r["prediction"])
            if not r["is_leaf"]:
                node.split = Split(by_name[r["feature"]], r["split_value"], r["split_category"],
                                   r["gain"])
            trees.setdefault((r["tree_id"], r["class_id"]), Tree()).nodes[r["node_id"]] = node
        rounds = 1 + max((t for t, _ in trees), default=-1)
        return cls(params, features, init,
                   [[trees[t, k] for k in range(len(init))] for t in range(rounds)])


def leaf_of(name: str, tree: Tree) -> Lookup:
    return Lookup(name, [(None, tree)], lambda n: n.node_id, "bigint")
