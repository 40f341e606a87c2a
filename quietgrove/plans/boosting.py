"""Boosted training, with and without a privacy budget."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce
from typing import Callable, Mapping, Optional, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.columns import choose, clamp
from quietgrove.functions.draws import draw_key, driver_laplace, fresh_seed
from quietgrove.functions.losses import Task, floored, task_of
from quietgrove.operators.histogram import ValueChunks
from quietgrove.operators.quantile import apply_scaling, fit_scaling
from quietgrove.operators.splits import (allot, balanced_quotas, geometric_quotas,
                                         gradient_filter, mark_first)
from quietgrove.plans import privacy
from quietgrove.plans.coding import TrainingTable
from quietgrove.plans.growth import Grower
from quietgrove.plans.model import BoostedModel
from quietgrove.plans.walks import boosted
from quietgrove.scratch import Scratch
from quietgrove.spec import ModelParams, Scaled, feature_list

# Gradients of a round are kept in memory for its levels up to this many rows; beyond, they
# are cheaper to compute again than to store.
SMALL_ROWS = 3_000_000


class PrivateBoostedTrees:
    """Trainer. ``task`` may be a user-defined ``losses.Task``; otherwise it follows
    ``params.task``."""

    def __init__(self, params: ModelParams, numeric: Sequence[str] = (),
                 categorical: Sequence[str] = (), target: str = "y", row_id: str = "row_id",
                 order: Optional[Sequence[str]] = None, task: Optional[Task] = None):
        self.params, self.target, self.row_id = params, target, row_id
        self.numeric, self.categorical, self.order = list(numeric), list(categorical), order
        self.task = task or task_of(params.task, params.n_classes)

    # -- public --------------------------------------------------------------------------

    def fit(self, df: DataFrame, exact_scaling: bool = False) -> BoostedModel:
        """Train one ensemble. ``exact_scaling`` says that the target was scaled by its own
        minimum and maximum, which the ledger then lists as unpaid."""
        spark = df.sparkSession
        features = feature_list(df, self.numeric, self.categorical, self.order)
        seed = fresh_seed(self.params.seed)
        with Scratch(spark) as scratch:
            base, holdout, extra = df.withColumn("model", F.lit(0)), None, []
            if self.params.reject:
                base = mark_first(base, lambda n: math.ceil(self.params.validation * n),
                                  self.row_id, self.params.shuffle, f"{seed}|validation")
                extra = ["is_test"]
            slim, scaled = self._slim(base, features, *extra), {}
            if self.params.scaling:
                slim, scaled = self._scaled(scratch.save(slim), seed)
            table = TrainingTable(slim, features, scratch)
            base, coder = table.rows, table.coder
            if self.params.reject:
                holdout = base.where("is_test").drop("is_test")
                base = base.where("NOT is_test").drop("is_test")
            init, params = self._start(base, seed)
            params = params.with_(categories=coder.categories(params.categories))
            run = _Run(self, params, table, seed, scratch, {0: init})
            rounds = run.private(base, holdout) if params.private else \
                run.plain(base, holdout)
        trees = [[coder.decode(t, scaled) for t in r[0]] for r in rounds]
        features = [replace(f, scaled=scaled.get(f.name)) for f in features]
        model = BoostedModel(self.params, features, init, trees)
        model.task = self.task
        if self.params.private:
            model.ledger = privacy.training_ledger(
                self.params, scaled=list(scaled), exact_scaling=exact_scaling, rejected=run.rejected).check()
        model.rejected = sum(run.rejected)
        return model

    def fit_folds(self, df: DataFrame, fold: str = "fold", targets: Optional[dict] = None
                  ) -> dict[int, BoostedModel]:
        """Train one model per fold on the rows outside it, without a budget.

        All folds share every job: a row takes part once per model, keyed by ``model``.
        ``targets`` optionally maps a fold to (factor, shift) applied to the target.
        """
        if self.params.private or self.params.reject:
            raise ValueError("packed folds are for training without budget and rejection")
        spark = df.sparkSession
        features = feature_list(df, self.numeric, self.categorical, self.order)
        with Scratch(spark) as scratch:
            table = TrainingTable(self._slim(df, features, fold), features, scratch)
            narrow, coder = table.rows, table.coder
            folds = sorted(r[0] for r in narrow.select(fold).distinct().collect())
            models = F.explode(F.filter(F.array(*[F.lit(f) for f in folds]),
                                        lambda m: m != F.col(fold)))
            base = narrow.withColumn("model", models).drop(fold)
            if targets:
                base = base.withColumn(self.target, choose(
                    [(F.col("model") == m, F.col(self.target) * F.lit(float(a)) + F.lit(float(b)))
                     for m, (a, b) in targets.items()]))
            init = {f: self.task.init(base.where(F.col("model") == f), self.target)
                    for f in folds}
            params = self.params.with_(categories=coder.categories(self.params.categories))
            run = _Run(self, params, table, fresh_seed(params.seed), scratch, init)
            rounds = run.plain(base, None)
        out = {f: BoostedModel(self.params, features, init[f],
                               [[coder.decode(t) for t in r[f]] for r in rounds])
               for f in folds}
        for model in out.values():
            model.task = self.task
        return out

    def fit_budgets(self, df: DataFrame, budgets: Sequence[float], fold: str = "fold",
                    targets: Optional[Mapping[int, Callable[[Column], Column]]] = None,
                    exact_scaling: bool = False) -> dict[tuple[int, float], BoostedModel]:
        """Train a private model per (fold, budget) on the rows outside the fold.

        The models equal those of ``fit`` on each fold's rows with each budget. They share every job:
        rows are stored once, their allotment to trees once per fold, and a row takes part in a
        tree once per budget, keyed by ``model``; in the first tree, once per node that budgets do not share. ``targets`` maps a fold to what is done to its target.
        """
        p = self.params.with_(privacy_budget=float(max(budgets)))
        if not min(budgets) > 0:
            raise ValueError("every budget has to be above zero")
        if p.reject or p.gradient_filtering or p.scaling or p.private_init:
            raise ValueError("rows that depend on the budget cannot be shared")
        spark, seed = df.sparkSession, fresh_seed(p.seed)
        features = feature_list(df, self.numeric, self.categorical, self.order)
        with Scratch(spark) as scratch:
            table = TrainingTable(self._slim(df, features, fold), features, scratch)
            base, coder = table.rows, table.coder
            folds = sorted(r[0] for r in base.select(fold).distinct().collect())
            groups = []
            for f in folds:
                rows = base.where(F.col(fold) != f).drop(fold)
                change = (targets or {}).get(f)
                groups.append(rows if change is None else rows.withColumn(self.target, change(F.col(self.target))))
            starts = [self.task.init(g, self.target) for g in groups]
            keys = [(f, float(b)) for f in folds for b in budgets]
            init = {m: starts[m // len(budgets)] for m in range(len(keys))}
            shared = p.with_(categories=coder.categories(p.categories))
            run = _Run(self, shared, table, seed, scratch, init, [b for _, b in keys])
            rounds = run.private_groups(base, groups, len(budgets))
        out = {}
        for m, (f, budget) in enumerate(keys):
            params = self.params.with_(privacy_budget=budget)
            out[f, budget] = BoostedModel(params, features, init[m],
                                          [[coder.decode(t) for t in r[m]] for r in rounds],
                                          privacy.training_ledger(params, exact_scaling=exact_scaling).check())
            out[f, budget].task = self.task
        return out

    # -- helpers -------------------------------------------------------------------------

    def _slim(self, df: DataFrame, features, *extra: str) -> DataFrame:
        """Only what training reads; written once, so that levels scan narrow columns."""
        ids = [self.row_id] if self.row_id in df.columns else []
        if not ids and (self.params.private or self.params.reject):
            raise ValueError(f"row id column {self.row_id} is missing")
        more = [c for c in ("model",) if c in df.columns]
        return df.select(*dict.fromkeys([*ids, *more, *extra, *[f.name for f in features]]),
                         F.col(self.target).cast("double").alias(self.target))

    def _scaled(self, rows: DataFrame, seed: str) -> tuple[DataFrame, dict[str, Scaled]]:
        """Numeric features on the grid's range, by private bounds of the rows that train."""
        s, grid = self.params.scaling, self.params.grid
        own = rows.where("NOT is_test") if self.params.reject else rows
        maps = fit_scaling(own, self.numeric, s.percentile, s.budget / max(1, len(self.numeric)),
                           (grid.lo, grid.hi), {c: s.limits(c) for c in self.numeric},
                           f"{seed}|scaling") if self.numeric else {}
        return apply_scaling(rows, maps), maps

    def _start(self, base: DataFrame, seed: str) -> tuple[list[float], ModelParams]:
        """Start scores; exact unless a part of the budget is set aside for them."""
        p = self.params
        if not (p.private and p.private_init):
            return self.task.init(base, self.target), p
        if p.task != "regression":
            raise ValueError("a private start score is available for regression")
        # Mean of targets clipped to the threshold; one row moves it by at most 2 l2 / n.
        row = base.agg(F.avg(clamp(self.target, -p.l2_threshold, p.l2_threshold)).alias("m"),
                       F.count(F.lit(1)).alias("n")).first()
        noise = driver_laplace(2 * p.l2_threshold / row["n"] / p.private_init, seed, "init")
        return [row["m"] + noise], p.with_(privacy_budget=p.privacy_budget - p.private_init,
                                           private_init=None)


class _Run:
    """State of one training run."""

    def __init__(self, trainer, params, table, seed, scratch, init, budgets=None):
        self.trainer, self.params, self.table = trainer, params, table
        self.features = table.coder.features
        self.seed, self.scratch, self.init = seed, scratch, init
        self.task, self.target = trainer.task, trainer.target
        self.models = sorted(init)
        self.classes = range(len(init[self.models[0]]))
        self.pred = [f"_pred_{k}" for k in self.classes]
        # one budget per model, if the models 0, 1, ... only differ in these and their rows
        self.by_model = budgets and [params.with_(privacy_budget=b) for b in budgets]
        self.which = "CAST(model AS int)" if self.models == list(range(len(init))) and len(init) > 1 else None
        self.rejected: list[int] = []  # rejected trees by ensemble

    # -- columns -------------------------------------------------------------------------

    def _by_model(self, value) -> str:
        if len(self.models) == 1:
            return value(self.models[0])
        return text.case([(f"model = {m}", value(m)) for m in self.models])

    def start(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.expr(self._by_model(lambda m, k=k: text.literal(float(self.init[m][k]))))
            for k, c in enumerate(self.pred)})

    def advance(self, df: DataFrame, rounds) -> DataFrame:
        """Stored scores plus the given rounds."""
        if not rounds:
            return df
        one = len(self.models) == 1
        return boosted(df, {c: (c, [[(None if one else f"model = {m}", r[m][k]) for m in self.models]
                                    for r in rounds]) for k, c in enumerate(self.pred)},
                       self.params.learning_rate, self.which)

    def gradients(self, df: DataFrame, rounds, bound: Optional[float] = None) -> DataFrame:
        """Features with one gradient (and, for several classes, curvature) per class."""
        scored = self.advance(df, rounds)
        cols = []
        for k in self.classes:
            g = floored(self.task.gradient(self.target, self.pred, k), self.params.floor_digits)
            g = g if bound is None else clamp(g, -float(bound), float(bound))
            cols.append(g.alias(f"g_{k}"))
            if len(self.classes) > 1:
                cols.append(self.task.hessian(self.target, self.pred, k).alias(f"h_{k}"))
        return scored.select("model", *[f.name for f in self.features], *cols)

    def grower(self, df: DataFrame) -> Grower:
        # Data-independent grids are small; distinct values may be many.
        chunks = ValueChunks.measure(df, self.features, self.table.counts) \
            if self.params.candidates == "distinct" else None
        self.small = self.table.n * max(1, len(self.models) - 1) <= SMALL_ROWS
        return Grower(self.params, self.features, self.seed, chunks, self.table.coder.words,
                      self.scratch, self.by_model)

    def round_of(self, trees: dict) -> dict:
        return {m: [trees[m, k] for k in self.classes] for m in self.models}

    # -- without a budget ----------------------------------------------------------------

    def plain(self, base: DataFrame, holdout: Optional[DataFrame]) -> list[dict]:
        """All rows in every round. Scores are stored with the rows every few rounds, which
        bounds both the lineage and the size of the score expressions."""
        grower, judge = self.grower(base), self._judge(holdout)
        current, rounds, pending = self.start(base), [], []
        for t in range(self.params.nb_trees):
            rows = self.gradients(current, pending)
            if self.small:
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            grown = self.round_of(grower.grow(rows, self.models, t))
            if self.small:
                rows.unpersist()
            if judge and not judge.accepts(grown):
                # The next attempts would grow this very tree again until patience ends.
                self.rejected.append(min(self.params.early_stop, self.params.nb_trees - t))
                break
            rounds.append(grown)
            pending.append(grown)
            if len(pending) >= self.params.refresh_every and t + 1 < self.params.nb_trees:
                following = self.scratch.save(self.advance(current, pending))
                self.scratch.release(current)
                current, pending = following, []
        return rounds

    # -- with a budget -------------------------------------------------------------------

    def private(self, base: DataFrame, holdout: Optional[DataFrame]) -> list[dict]:
        """Every tree of an ensemble trains on rows of its own; ensembles start afresh. Rows of a
        rejected tree go back; training ends after ``early_stop`` rejections."""
        grower, judge, rounds = self.grower(base), self._judge(holdout), []
        filtering = self.params.gradient_filtering and len(self.classes) == 1
        grow = self._pool_rows if filtering or judge else self._allotted_rows
        per, total = self.params.per_ensemble, self.params.nb_trees
        for first in range(0, total, per):
            trees = range(first, min(first + per, total))
            self.rejected.append(0)
            for t, rows in grow(base, trees, per, rounds):
                rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
                grown = self.round_of(grower.grow(rows, self.models, t))
                rows.unpersist()
                if not judge or judge.accepts(grown):
                    rounds.append(grown)
                    continue
                self.rejected[-1] += 1
                if sum(self.rejected) >= self.params.early_stop:
                    return rounds
        return rounds

    def private_groups(self, base: DataFrame, groups: Sequence[DataFrame], budgets: int) -> list[dict]:
        """One run for several groups of rows (folds) and budgets: model ``g * budgets + b``."""
        p, grower, rounds = self.params, self.grower(base), []
        for first in range(0, p.nb_trees, p.per_ensemble):
            trees = range(first, min(first + p.per_ensemble, p.nb_trees))
            parts, sizes = [], []
            for g, rows in enumerate(groups):
                allotted, own = allot(rows, self._quotas(p.per_ensemble), self.trainer.row_id, p.shuffle,
                                      f"{self.seed}|rows|{first}")
                parts.append(allotted.where("tree_id IS NOT NULL").withColumn("_group", F.lit(g)))
                sizes.append(own)
            stored = self.scratch.save(reduce(DataFrame.unionByName, parts).hint("rebalance", "tree_id"), ["tree_id"])
            for i, t in enumerate(trees):
                # groups are folds, so they run out of rows together up to a row
                if any(i >= len(own) or own[i] == 0 for own in sizes):
                    break
                part = stored.where(F.col("tree_id") == i).withColumn("model", F.col("_group") * budgets)
                # Before the first tree the budgets of a group have the same scores and share its rows.
                shared = 1 if rounds else budgets
                if rounds:
                    part = part.withColumn("model", F.explode(F.sequence("model", F.col("model") + F.lit(budgets - 1))))
                rows = self.gradients(self.start(part), rounds, p.l2_threshold).persist(StorageLevel.MEMORY_AND_DISK)
                rounds.append(self.round_of(grower.grow(rows, self.models, t, shared)))
                rows.unpersist()
            self.scratch.release(stored)
        return rounds

    def _quotas(self, per: int):
        p = self.params
        if p.balance_partition:
            return lambda n: balanced_quotas(n, per)
        return lambda n: geometric_quotas(n, per, p.learning_rate)

    def _allotted_rows(self, base, trees, per, rounds):
        """Rows drawn in advance and stored by tree, so that a tree reads only its files."""
        p = self.params
        allotted, sizes = allot(base, self._quotas(per), self.trainer.row_id, p.shuffle,
                                f"{self.seed}|rows|{trees[0]}")
        # The rebalance keeps the files of each tree few and evenly sized.
        stored = self.scratch.save(
            allotted.where(F.col("tree_id").isNotNull()).hint("rebalance", "tree_id"),
            ["tree_id"])
        for i, t in enumerate(trees):
            if i >= len(sizes) or sizes[i] == 0:
                return
            part = self.start(stored.where(F.col("tree_id") == i))
            yield t, self.gradients(part, rounds, p.l2_threshold)

    def _pool_rows(self, base, trees, per, rounds):
        """Rows taken from a pool tree by tree, where they cannot be fixed in advance: with gradient
        filtering they depend on the current gradients, with rejection on what became of earlier
        trees.

        The pool is its stored rows less those that satisfy the cuts of later trees. It is stored
        again, with current scores, only every ``refresh_every`` trees.
        """
        p, key = self.params, self.trainer.row_id
        mode = "take" if p.reject else "drop" if p.gradient_filtering == "drop" else "fill"
        pool, stored, since = self.start(base), None, 0
        unused = base.count()
        shares = None if p.balance_partition else geometric_quotas(unused, per, p.learning_rate)
        g = floored(self.task.gradient(self.target, self.pred), p.floor_digits)
        for i, t in enumerate(trees):
            quota = unused // (per - i) if shares is None else \
                min(unused, shares[i]) if i < len(shares) else 0
            if quota == 0:
                return
            draw = draw_key(f"{self.seed}|rows|{t}", key) if p.shuffle else F.lit(0)
            flagged = gradient_filter(pool.withColumns({"g_0": g, "_place": draw}), quota, p.l2_threshold,
                                      grad="g_0", key=key, mode=mode, keep_all=True, order=["_place", key])
            chosen, known = flagged.where("selected"), len(rounds)
            if mode == "take":
                yield t, self.gradients(chosen, [], p.l2_threshold)
            else:
                yield t, chosen.select("model", *[f.name for f in self.features], "g_0")
            if len(rounds) == known:
                continue
            grown = rounds[-1]
            unused -= grown[self.models[0]][0].nodes[0].n if mode == "drop" else quota
            # The row number pins the filter: pushed down, it would carry copies of the scores.
            left = flagged.withColumn("_row", F.monotonically_increasing_id()).where("NOT selected AND _row >= 0")
            pool, since = self.advance(left.drop("selected", "g_0", "_place", "_row"), [grown]), since + 1
            if since >= p.refresh_every and i + 1 < len(trees):
                last, stored, since = stored, self.scratch.save(pool), 0
                pool = stored
                if last is not None:
                    self.scratch.release(last)

    # -- rejection -----------------------------------------------------------------------

    def _judge(self, holdout: Optional[DataFrame]):
        return None if holdout is None else _Judge(self, holdout)


class _Judge:
    """Accepts a round only if it lowers the deviance of the hold-out rows."""

    def __init__(self, run: _Run, holdout: DataFrame):
        self.run, self.pending = run, []
        self.current = run.scratch.save(run.start(holdout))
        self.best = float("inf")

    def accepts(self, grown: dict) -> bool:
        run = self.run
        trial = run.advance(self.current, [*self.pending, grown])
        score = trial.agg(run.task.deviance(run.target, run.pred).alias("s")).first()["s"]
        if score >= self.best:
            return False
        self.best = score
        self.pending.append(grown)
        if len(self.pending) >= run.params.refresh_every:
            self.current, self.pending = run.scratch.save(
                run.advance(self.current, self.pending)), []
        return True
