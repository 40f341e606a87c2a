"""Growing the trees of one boosting round.

All nodes of a level, of all classes and of all models (folds) share one histogram job; the
driver only sees a few rows per node. Rows find their node by walking the trees from the root; once
a level has many open nodes, they are stored with their place among these and walk one step a level. Child counts and gradient sums come with the chosen
split, so leaves need no job of their own.

Models that only differ in their budget share rows as long as their trees agree: a node that several of
them reached by the same splits has one histogram, and only the choice of its split is made per budget.

Input rows carry the features, ``model`` and, per class k, ``g_k`` (and ``h_k``).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.functions.text import literal_array
from quietgrove.functions.draws import driver_laplace, fresh_seed
from quietgrove.operators.histogram import (ValueChunks, candidates_declared,
                                            candidates_distinct, candidates_grid,
                                            candidates_packed_grid,
                                            pooled_siblings, sibling_gain_of,
                                            sibling_histogram, split_gain)
from quietgrove.operators.leaves import SMALL_DENOMINATOR
from quietgrove.operators.selection import (best_by_budget, best_per_feature, best_per_node, utility,
                                            with_noise)
from quietgrove.plans import privacy
from quietgrove.plans.coding import TrainingTable
from quietgrove.plans.trees import Node, Split, Tree
from quietgrove.plans.walks import Layout, Lookup, looked_up
from quietgrove.scratch import Scratch
from quietgrove.spec import Feature, ModelParams



@dataclass
class Anchor:
    """Rows stored with their place (``_at``) in a list of open nodes, each given as (unit, node id)."""

    rows: DataFrame
    nodes: list[tuple[tuple[int, int], int]]


class Grower:
    #: Open nodes of a level from which rows are stored with their node.
    WALKED_LEAVES = 512
    #: Winners by node and feature that the driver takes; beyond, they are reduced to one per node.
    COLLECTED_ROWS = 4_096
    #: Categories that a draw looks up in a list; more of them are joined.
    LISTED_WORDS = 256
    #: Winners by node and budget up to which the models of a level share their nodes.
    SHARED_ROWS = 65_536

    def __init__(self, params: ModelParams, features: Sequence[Feature], seed: str,
                 chunks: Optional[ValueChunks] = None,
                 words: Optional[Mapping[str, Sequence[str]]] = None,
                 scratch: Optional[Scratch] = None,
                 by_model: Optional[Sequence[ModelParams]] = None):
        self.params, self.features, self.seed, self.chunks = params, features, seed, chunks
        self.words = words or {}
        # Without text features a row's features travel as one array, in feature order.
        whole = [f.index for f in features] == list(range(len(features)))
        self.packed = "_x" if whole and not any(f.text for f in features) else None
        # A constant class would only get in the way of sort orders, so one class has no key.
        self.unit = ["model", "class_id"] if params.n_classes > 1 else ["model"]
        self.by_index = {f.index: f for f in features}
        self.scratch = scratch
        # Models 0, 1, ... that only differ in their budgets; each draws as if it were alone.
        self.by_model = by_model
        # So many consecutive models have the same rows, which carry the first of them.
        self.shared = 1
        self.anchor: Optional[Anchor] = None

    # -- one job per level ---------------------------------------------------------------

    def _routed(self, rows: DataFrame, trees: dict, active: dict, whole: bool = False) -> DataFrame:
        """Features, class_id, node_id, grad (and hess) of the rows in active nodes. ``whole`` starts
        at the roots even if rows are stored further down."""
        here = {m for m, _ in active} if self.shared > 1 else {m for m, _ in trees}
        if not self.packed:
            rows = self._spread(rows, here)
            everywhere = all(n.node_id in active.get(u, ()) for u, t in trees.items()
                             for n in t.leaves if u[0] in here)
            routed = self._routed_by_text(rows, trees, active)
            return routed if everywhere else routed.where("node_id IS NOT NULL")
        keep = [*self.unit, "grad", *(["hess"] if self.params.n_classes > 1 else []), "_x"]
        if self.anchor and not whole:
            start, place = self.anchor.rows, "_at"
            roots = [(trees[u], i) for u, i in self.anchor.nodes]
        else:
            start, roots, place = self._spread(self._start(rows, keep), here), [], []
            for u in sorted(trees):
                place.append((unit_sql(self.unit, *u), str(len(roots))))
                roots.append((trees[u], 0))
            place = "CAST(model AS int)" if self.by_model and len(self.unit) == 1 else \
                place[0][1] if len(place) == 1 else text.case(place)
        units = [u for u, _ in self.anchor.nodes] if self.anchor and not whole else sorted(trees)
        layout = Layout.of(roots)
        steps = layout.steps(place, "_x", lambda n: n.split.value, lambda n: n.split.feature.index, "_a")
        wanted = [n.split is None and n.node_id in active.get(units[r], ())
                  for n, r in zip(layout.nodes, layout.root)]
        if not whole and self.scratch and self.shared == 1 and sum(wanted) > self.WALKED_LEAVES:
            return self._anchored(start, keep, layout, steps, wanted, units)
        ids = literal_array([n.node_id if w else -1 for n, w in zip(layout.nodes, wanted)], "bigint")
        routed = start.selectExpr(*keep, *steps, f"nullif(get({ids}, _a{layout.depth}), -1L) AS node_id")
        if all(w for w, n, r in zip(wanted, layout.nodes, layout.root) if n.split is None and units[r][0] in here):
            return routed.select(*keep, "node_id")
        # The row number pins the filter above the walk: pushed below, it would be copied into
        # every step.
        pinned = routed.selectExpr(*keep, "node_id", "monotonically_increasing_id() AS _row")
        return pinned.where("node_id IS NOT NULL AND _row >= 0").drop("_row")

    def _spread(self, rows: DataFrame, models: set) -> DataFrame:
        """Rows that models share, once for each of ``models``."""
        if self.shared == 1 or all(m % self.shared == 0 for m in models):
            return rows
        listed = [[str(m) for m in sorted(models) if m // self.shared == g] for g in range(max(models) // self.shared + 1)]
        arrays = ", ".join(f"CAST(array({', '.join(own)}) AS array<int>)" for own in listed)
        others = text.names([c for c in rows.columns if c != "model"])
        return rows.selectExpr(f"explode(get(array({arrays}), CAST(model DIV {self.shared} AS int))) AS model", *others)

    def _owners(self, trees: dict, active: dict) -> dict:
        """The models of which one does the work of each active node: {(unit, node id): units}. These
        reached the node with the same rows by the same splits."""
        found: dict = {}
        for u in sorted(active):
            for node_id in sorted(active[u]):
                splits, above = [], node_id
                while above:
                    above = (above - 1) // 2
                    s = trees[u].nodes[above].split
                    splits.append((s.feature.index, s.value, s.category))
                found.setdefault((u[0] // self.shared, u[1], node_id, tuple(splits)), []).append(u)
        return {(units[0], key[2]): units for key, units in found.items()}

    def _start(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows with their features as one array, once per class."""
        values = ", ".join(f"CAST({text.name(f.name)} AS double)" for f in self.features)
        if self.params.n_classes == 1:
            return rows.selectExpr("model", "g_0 AS grad", f"array({values}) AS _x")
        parts = ", ".join(f"{k}, g_{k}, h_{k}" for k in range(self.params.n_classes))
        return rows.selectExpr("model", f"array({values}) AS _x", f"stack({self.params.n_classes}, {parts}) "
                               "AS (class_id, grad, hess)").select(*keep)

    def _anchored(self, start: DataFrame, keep: Sequence[str], layout: Layout, steps: Sequence[str],
                  wanted: Sequence[bool], units: Sequence[tuple]) -> DataFrame:
        """A deep level: rows are stored with their place among the open nodes, so the next level
        walks one step from there, and rows of finished leaves are left behind."""
        order = [p for p, w in enumerate(wanted) if w]
        rank = {p: i for i, p in enumerate(order)}
        places = literal_array([rank.get(p, -1) for p in range(len(wanted))], "int")
        placed = start.selectExpr(*keep, *steps, f"get({places}, _a{layout.depth}) AS _at",
                                  "monotonically_increasing_id() AS _row")
        stored = self.scratch.save(placed.where("_at >= 0 AND _row >= 0").select(*keep, "_at"))
        nodes = [(units[layout.root[p]], layout.nodes[p].node_id) for p in order]
        self._release()
        self.anchor = Anchor(stored, nodes)
        ids = literal_array([i for _, i in nodes], "bigint")
        return stored.selectExpr(*keep, f"get({ids}, _at) AS node_id")

    def _release(self) -> None:
        if self.anchor:
            self.scratch.release(self.anchor.rows)
        self.anchor = None

    def _is_unit(self, model: int, class_id: int) -> str:
        return unit_sql(self.unit, model, class_id)

    def _routed_by_text(self, rows: DataFrame, trees: dict, active: dict) -> DataFrame:
        models = sorted({m for m, _ in trees})
        classes = range(self.params.n_classes)

        one = len(models) == 1
        wanted = {id(trees[u].nodes[i]) for u, nodes in active.items() for i in nodes}
        lookups = [Lookup(f"_node_{k}", [
            (None if one else f"model = {m}", trees[m, k]) for m in models],
            lambda n: n.node_id if id(n) in wanted else None, "bigint") for k in classes]
        names = text.names([f.name for f in self.features])
        found = looked_up(rows, lookups)
        if self.params.n_classes == 1:
            return found.selectExpr("model", "_node_0 AS node_id", "g_0 AS grad", *names)
        parts = ", ".join(f"{k}, _node_{k}, g_{k}, h_{k}" for k in classes)
        return found.selectExpr("model", *names, f"stack({len(classes)}, {parts}) "
                                "AS (class_id, node_id, grad, hess)")

    def _histogram(self, work: DataFrame, by: Sequence[str], hess: Optional[str]) -> DataFrame:
        p = self.params
        if p.candidates == "distinct":
            return candidates_distinct(work, self.features, by, "grad", hess, self.packed)
        if self.packed and not self._declared():
            return candidates_packed_grid(work, self.features, p.grid, self.packed, by, "grad", hess)
        if self.packed:
            work = work.select("*", *[F.get("_x", F.lit(f.index)).alias(f.name)
                                      for f in self.features]).drop("_x")
        numeric = [f for f in self.features if not f.is_cat]
        declared = self._declared()
        rest = [f for f in self.features if f.is_cat and f.name not in p.categories]
        parts = []
        if numeric:
            parts.append(candidates_grid(work, numeric, p.grid, by, "grad", hess))
        if declared:
            parts.append(candidates_declared(work, declared, p.categories, by, "grad", hess))
        if rest:
            parts.append(candidates_distinct(work, rest, by, "grad", hess))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _declared(self) -> list[Feature]:
        return [f for f in self.features if f.is_cat and f.name in self.params.categories]

    def _sibling_histogram(self, work: DataFrame) -> DataFrame:
        """Like ``_histogram``, for pairs of siblings: only features whose candidates come from
        the rows have to occur in a child to be its candidate."""
        p = self.params
        fixed = [f for f in self.features if p.candidates != "distinct"
                 and (not f.is_cat or f.name in p.categories)]
        rest = [f for f in self.features if f not in fixed]
        if not fixed:
            return sibling_histogram(work, rest, by=self.unit, packed=self.packed)
        if self.packed and not self._declared():
            out = pooled_siblings(self._histogram(work, [*self.unit, "parent_id", "side"], None), by=self.unit)
            free = f"feature_idx IN ({', '.join(str(f.index) for f in fixed)})"
            return out.withColumns({f"in{s}": F.expr(f"{free} OR n{s} > 0") for s in (0, 1)})
        if self.packed:
            work = work.select("*", *[F.get("_x", F.lit(f.index)).alias(f.name)
                                      for f in self.features]).drop("_x")
        whole, self.features, packed, self.packed = self.features, fixed, self.packed, None
        try:
            hist = self._histogram(work, [*self.unit, "parent_id", "side"], None)
        finally:
            self.features, self.packed = whole, packed
        out = pooled_siblings(hist, by=self.unit)
        return out.unionByName(sibling_histogram(work, rest, by=self.unit)) if rest else out

    def candidates(self, rows: DataFrame, trees: dict, active: dict, depth: int) -> DataFrame:
        """All split candidates of the active nodes with their gains."""
        p = self.params
        if p.growth == "sibling" and depth > 0:
            both = {u: {c for n in ns for c in Node((n - 1) // 2).children}
                    for u, ns in active.items()}
            parent = F.floor((F.col("node_id") - 1) / 2).cast("bigint")
            work = self._routed(rows, trees, both).withColumn("parent_id", parent).withColumn(
                "side", F.when(F.col("node_id") == 2 * parent + 1, 0).otherwise(1))
            gains = sibling_gain_of(self._sibling_histogram(work), self.features, p.l2_lambda,
                                    by=self.unit, chunks=self.chunks, floor_digits=p.floor_digits)
            node = F.col("parent_id") * 2 + 1 + F.col("side")
            gains = gains.withColumn("node_id", node).drop("parent_id", "side")
            if any(active[u] != both[u] for u in active):
                gains = gains.where(" OR ".join(
                    f"({self._is_unit(m, k)} AND node_id IN ({', '.join(map(str, sorted(ns)))}))"
                    for (m, k), ns in active.items()))
            return gains
        hess = "hess" if p.n_classes > 1 else None
        by = [*self.unit, "node_id"]
        hist = self._histogram(self._routed(rows, trees, active), by, hess)
        return split_gain(hist, self.features, p.l2_lambda, by, self.chunks, p.floor_digits)

    def _draw_keys(self, cands: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
        """Candidates and what their draws depend on. Codes of text features are looked up, so
        that a draw is the same whether a feature is coded or kept as text."""
        keys = ["0" if self.by_model and c == "model" else text.name(c) for c in [*by, "feature_idx"]]
        if not self.words:
            return cands, [*keys, "value", "category"]
        if sum(map(len, self.words.values())) <= self.LISTED_WORDS:
            listed = [(f"feature_idx = {f.index}", f"get(array({', '.join(map(text.literal, self.words[f.name]))}), "
                       "CAST(value AS int))") for f in self.features if self.words.get(f.name)]
            word = text.case(listed, "CAST(NULL AS string)")
            return cands, [*keys, f"CASE WHEN {word} IS NULL THEN value END", f"coalesce(category, {word})"]
        words = cands.sparkSession.createDataFrame(
            [(f.index, float(i), w) for f in self.features for i, w in enumerate(self.words.get(f.name, ()))],
            "_f int, _v double, _word string")
        joined = cands.join(F.broadcast(words), (F.col("feature_idx") == F.col("_f"))
                            & (F.col("value") == F.col("_v")), "left").drop("_f", "_v")
        return joined, [*keys, "CASE WHEN _word IS NULL THEN value END", "coalesce(category, _word)"]

    def splits(self, rows: DataFrame, trees: dict, active: dict, depth: int, tree_index: int
               ) -> dict:
        """The chosen split of every active node that has one."""
        p, by = self.params, [*self.unit, "node_id"]
        owners = self._owners(trees, active) if self.shared > 1 else {}
        share = 0 < len(owners) * self.shared <= self.SHARED_ROWS
        cands = self.candidates(rows, trees, _by_unit(owners) if share else active, depth)
        noisy = p.private and not p.argmax_splits
        seed = f"{self.seed}|split|{tree_index}"
        if noisy:
            shares = [privacy.node_budget(q, privacy.tree_budget(q), depth) for q in self.by_model or [p]]
        if noisy and share:
            cands, keys = self._draw_keys(cands, by)
            found = best_by_budget(cands, by, shares[:self.shared], privacy.delta_g(p), seed, keys)
            by, wide = [*by, "budget"], len(owners) * self.shared
        else:
            if noisy:
                budget = shares[0] if not self.by_model else \
                    f"get({literal_array(shares, 'double')}, CAST(model AS int))"
                cands, keys = self._draw_keys(utility(cands, budget, privacy.delta_g(p)), by)
                cands = with_noise(cands, by, seed, keys=keys).drop("_word")
            found, wide = best_per_feature(cands, by, noisy), len(owners) if share else sum(map(len, active.values()))
        if wide * len(self.features) > self.COLLECTED_ROWS:
            found = best_per_node(found, by, noisy)
        best: dict = {}
        for row in found.collect():
            c = row.asDict()
            unit = c["model"], c.get("class_id", 0)
            c["_order"] = (-c["noisy" if noisy else "gain"], c["feature_idx"])
            for u in owners[unit, c["node_id"]] if share else [unit]:
                if noisy and share and u[0] % self.shared != c["budget"]:
                    continue
                place = u, c["node_id"]
                if place not in best or c["_order"] < best[place]["_order"]:
                    best[place] = c
        return best

    # -- growth orders -------------------------------------------------------------------

    def grow(self, rows: DataFrame, models: Sequence[int], tree_index: int, shared: int = 1) -> dict:
        """One tree per (model, class). ``shared`` consecutive models each have the same rows, which are
        given once, with the first of them as their model."""
        self.shared = shared
        units = [(m, k) for m in models for k in range(self.params.n_classes)]
        trees = {u: Tree({0: Node(0)}) for u in units}
        if self.params.growth == "best_first":
            self._grow_best_first(rows, trees, tree_index)
        else:
            self._grow_levels(rows, trees, tree_index)
        self._release()
        self._complete(rows, trees)
        for u, tree in trees.items():
            self._predict(u, tree, tree_index)
        return trees

    def _open(self, node: Node, chosen: dict) -> bool:
        """Give the root its totals; True if the node holds enough rows to be split."""
        if node.node_id == 0:
            for m in ("n", "g", "h"):
                if f"{m}_left" in chosen:
                    setattr(node, m, chosen[f"{m}_left"] + chosen[f"{m}_right"])
        return node.n >= self.params.min_samples_split

    def _commit(self, tree: Tree, node: Node, chosen: dict) -> None:
        node.split = Split(self.by_index[chosen["feature_idx"]], chosen["value"],
                           chosen["category"], chosen["gain"])
        for child, side in zip(node.children, ("left", "right")):
            tree.nodes[child] = Node(child, chosen[f"n_{side}"], chosen[f"g_{side}"],
                                     chosen.get(f"h_{side}", 0.0))

    def _grow_levels(self, rows, trees, tree_index) -> None:
        active = {u: {0} for u in trees}
        for depth in range(self.params.max_depth):
            if not active:
                return
            chosen = self.splits(rows, trees, active, depth, tree_index)
            following: dict = {}
            for (u, node_id), c in chosen.items():
                tree = trees[u]
                node = tree.nodes[node_id]
                if not self._open(node, c):
                    continue
                self._commit(tree, node, c)
                large = {i for i in node.children
                         if tree.nodes[i].n >= self.params.min_samples_split}
                if large:
                    following.setdefault(u, set()).update(large)
            active = following

    def _grow_best_first(self, rows, trees, tree_index) -> None:
        """Leaves are expanded first in, first out, the sibling with the higher gain first,
        until ``max_leaves`` is reached. A node whose children cannot both be split again
        becomes a leaf. The queue holds one level at a time, so each level is one job."""
        p = self.params
        found = self.splits(rows, trees, {u: {0} for u in trees}, 0, tree_index)
        queue = {u: deque() for u in trees}
        count = {u: 0 for u in trees}
        stopped: set = set()
        for (u, _), c in found.items():
            self._open(trees[u].nodes[0], c)
            queue[u].append((0, c))
        for depth in range(p.max_depth + 1):
            trial = {u: Tree(dict(t.nodes)) for u, t in trees.items()}
            active: dict = {}
            for u, waiting in queue.items():
                for node_id, c in waiting:
                    node = trees[u].nodes[node_id]
                    if u in stopped or depth == p.max_depth or node.n < p.min_samples_split:
                        continue
                    trial[u].nodes[node_id] = Node(node_id, node.n, node.g, node.h)
                    self._commit(trial[u], trial[u].nodes[node_id], c)
                    active.setdefault(u, set()).update(node.children)
            found = self.splits(rows, trial, active, depth + 1, tree_index) if active else {}
            for u in queue:
                level, queue[u] = queue[u], deque()
                while level and u not in stopped:
                    node_id, c = level.popleft()
                    node = trees[u].nodes[node_id]
                    below = [found.get((u, i)) for i in node.children]
                    if node_id not in {(i - 1) // 2 for i in active.get(u, ())} or None in below:
                        count[u] += 1
                        if p.max_leaves and count[u] + len(level) + len(queue[u]) >= p.max_leaves:
                            stopped.add(u)
                        continue
                    self._commit(trees[u], node, c)
                    pair = list(zip(node.children, below))
                    if pair[0][1]["gain"] < pair[1][1]["gain"]:
                        pair.reverse()
                    queue[u].extend(pair)

    # -- leaves --------------------------------------------------------------------------

    def _complete(self, rows, trees) -> None:
        """Sums that no split delivered: roots without a split, and the second-order sums of
        sibling growth."""
        multi = self.params.n_classes > 1
        missing = {u for u, t in trees.items() if t.nodes[0].split is None
                   or (multi and self.params.growth == "sibling")}
        if not missing:
            return
        active = {u: {n.node_id for n in trees[u].leaves} for u in missing}
        only = {u: trees[u] if u in missing else Tree({0: Node(0)}) for u in trees}
        sums = [F.count(F.lit(1)).alias("n"), F.sum("grad").alias("g")]
        if multi:
            sums.append(F.sum("hess").alias("h"))
        owners = self._owners(only, active) if self.shared > 1 else {}
        routed = self._routed(rows, only, _by_unit(owners) or active, whole=True)
        for r in (row.asDict() for row in routed.groupBy(*self.unit, "node_id").agg(*sums).collect()):
            unit = r["model"], r.get("class_id", 0)
            for u in owners.get((unit, r["node_id"]), [unit]):
                node = trees[u].nodes[r["node_id"]]
                node.n, node.g = r["n"], r["g"]
                node.h = r["h"] if multi else 0.0

    def _predict(self, unit, tree: Tree, tree_index: int) -> None:
        p = self.params
        for leaf in tree.leaves:
            value = leaf_value(leaf.n, leaf.g, p.l2_lambda, leaf.h, p.n_classes)
            if p.private:
                if privacy.clips_leaves(p):
                    bound = privacy.leaf_threshold(p, tree_index)
                    value = max(-bound, min(bound, value))
                if p.noise:
                    own, model = (self.by_model[unit[0]], 0) if self.by_model else (p, unit[0])
                    value += driver_laplace(privacy.laplace_scale(own, tree_index), self.seed,
                                            "leaf", tree_index, model, unit[1], leaf.node_id)
            leaf.prediction = value


def leaf_value(n: int, g: float, l2_lambda: float, h: float = 0.0, n_classes: int = 1) -> float:
    if n == 0:
        return 0.0
    if n_classes > 1:
        if abs(h) < SMALL_DENOMINATOR:
            return 0.0
        return -g * (n_classes - 1) / n_classes / (h + l2_lambda)
    return -g / (n + l2_lambda)


def _by_unit(places) -> dict:
    """{unit: node ids} of (unit, node id) pairs."""
    out: dict = {}
    for u, node_id in places:
        out.setdefault(u, set()).add(node_id)
    return out


def unit_sql(unit: Sequence[str], model: int, class_id: int) -> str:
    return " AND ".join(f"{c} = {v}" for c, v in zip(unit, (model, class_id)))


def unit_sql(unit: Sequence[str], model: int, class_id: int) -> str:
    return " AND ".join(f"{c} = {v}" for c, v in zip(unit, (model, class_id)))


def fit_tree(df: DataFrame, params: ModelParams, features: Sequence[Feature],
             grad: str = "grad", tree_index: int = 0) -> Tree:
    """One tree on given gradients. The growth order follows ``params.growth``."""
    with Scratch(df.sparkSession) as scratch:
        names = [f.name for f in features]
        table = TrainingTable(df.select(F.lit(0).alias("model"), *names,
                                        F.col(grad).alias("g_0")), features, scratch)
        rows, coder = table.rows, table.coder
        chunks = ValueChunks.measure(rows, coder.features, table.counts) \
            if params.candidates == "distinct" else None
        grower = Grower(params.with_(categories=coder.categories(params.categories)),
                        coder.features, fresh_seed(params.seed), chunks, coder.words, scratch)
        return coder.decode(grower.grow(rows, [0], tree_index)[0, 0])
