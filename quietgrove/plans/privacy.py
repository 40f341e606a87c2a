"""Privacy arithmetic: sensitivities, budget shares, noise scales and the spend ledger."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Optional, Sequence

from quietgrove.spec import ModelParams


def delta_g(params: ModelParams) -> float:
    """Sensitivity of the gain."""
    return 3.0 * params.l2_threshold ** 2


def leaf_threshold(params: ModelParams, tree_index: int) -> float:
    """Geometric bound on leaf values."""
    return params.l2_threshold * math.pow(1 - params.learning_rate, tree_index)


def clips_leaves(params: ModelParams) -> bool:
    """Clipping may only be off while gradient filtering bounds the leaves instead."""
    return params.leaf_clipping or not params.gradient_filtering or params.n_classes > 1


def delta_v(params: ModelParams, tree_index: int) -> float:
    """Sensitivity of a leaf value."""
    bound = params.l2_threshold / (1 + params.l2_lambda)
    if not clips_leaves(params):
        return bound
    return min(bound, 2 * leaf_threshold(params, tree_index))


def ensemble_count(params: ModelParams) -> int:
    return math.ceil(params.nb_trees / params.per_ensemble)


def training_budget(params: ModelParams) -> float:
    """What is left for trees after feature scaling."""
    spent = params.scaling.budget if params.scaling else 0.0
    return min(params.privacy_budget, params.budget_cap) - spent


def tree_budget(params: ModelParams) -> float:
    """Budget of one tree: its ensemble's share, divided among the K trees of a round."""
    share = training_budget(params) / ensemble_count(params)
    if params.n_classes > 1:
        share /= 2 if params.multiclass_budget == "halved" else params.n_classes
    if params.reject:
        # rows of a rejected tree go back, so each of them may be read this often
        share /= params.early_stop + 1
    return share


def split_levels(params: ModelParams) -> int:
    """Levels on which splits are chosen; best-first growth also asks the deepest children
    whether they could be split."""
    return params.max_depth + (1 if params.growth == "best_first" else 0)


def node_budget(params: ModelParams, budget: float, depth: int) -> float:
    """Budget of the split choice in one node."""
    if not params.use_decay:
        share = budget / (2 * split_levels(params))
    elif depth == 0:
        share = budget / (2 * math.pow(2, params.max_depth + 1) + 2 * math.pow(2, 1))
    else:
        share = budget / (2 * math.pow(2, depth + 1))
    if params.growth == "sibling" and depth > 0:
        share /= 2
    return share


def laplace_scale(params: ModelParams, tree_index: int) -> float:
    return delta_v(params, tree_index) / (tree_budget(params) / 2)


def path_spend(params: ModelParams) -> float:
    """Budget that one row can be charged by one tree: the nodes on a root-to-leaf path
    and the leaf. Nodes of one level hold disjoint rows; a sibling-pooled node reads its
    sibling's rows too, so each row pays twice there."""
    budget = tree_budget(params)
    nodes = sum(node_budget(params, budget, d) * (2 if params.growth == "sibling" and d else 1)
                for d in range(split_levels(params)))
    return nodes + budget / 2


@dataclass
class Ledger:
    """What a training run spent, and what it read without paying."""

    budget: float
    entries: list[tuple[str, float]] = field(default_factory=list)
    unpaid: list[str] = field(default_factory=list)

    def charge(self, what: str, epsilon: float) -> None:
        if epsilon < 0:
            raise ValueError("a charge cannot be negative")
        self.entries.append((what, epsilon))

    @property
    def spent(self) -> float:
        return sum(e for _, e in self.entries)

    def check(self) -> "Ledger":
        if self.spent > self.budget * (1 + 1e-9):
            raise ValueError(f"spent {self.spent} of a budget of {self.budget}")
        return self


def training_ledger(params: ModelParams, scaled: Sequence[str] = (),
                    exact_scaling: bool = False, total: Optional[float] = None,
                    rejected: Sequence[int] = ()) -> Ledger:
    """Ledger of one training run.

    Every scaled column reads all rows, so its share of the scaling budget adds to the rest.
    Trees of one ensemble use disjoint rows (parallel composition: the largest spend counts,
    and it is the same for all); ensembles, and the K trees of a round, add up. ``rejected``
    counts the rejected trees of each ensemble: a row may have been in all of them, so each adds up.
    """
    used = min(params.privacy_budget, params.budget_cap)
    ledger = Ledger(total if total is not None else used)
    for c in scaled:
        ledger.charge(f"scaling of {c}", params.scaling.budget / len(scaled))
    init = params.private_init or 0.0
    if init:
        ledger.charge("start score", init)
        params = params.with_(privacy_budget=params.privacy_budget - init, private_init=None)
    else:
        ledger.unpaid.append("start score")
    per_round = params.n_classes if params.multiclass_budget == "sequential" else \
        min(params.n_classes, 2)
    for e in range(ensemble_count(params)):
        ledger.charge(f"ensemble {e}", path_spend(params) * per_round)
        for i in range(rejected[e] if e < len(rejected) else 0):
            ledger.charge(f"ensemble {e}, rejected tree {i}", path_spend(params) * per_round)
    if params.n_classes > 2 and params.multiclass_budget == "halved":
        ledger.unpaid.append("rows shared by more than two trees of a round")
    if exact_scaling:
        ledger.unpaid.append("target minimum and maximum")
    if params.candidates == "distinct":
        ledger.unpaid.append("split values taken from the rows")
    if params.reject:
        ledger.unpaid.append("hold-out scores of rejected trees")
    return ledger


def schedule(params: ModelParams) -> list[dict]:
    """One row per tree: ensemble, index in it, budget, sensitivities, noise scale."""
    out = []
    for t in range(params.nb_trees):
        out.append({
            "tree_id": t, "ensemble_id": t // params.per_ensemble,
            "tree_in_ensemble": t % params.per_ensemble, "budget": tree_budget(params),
            "delta_g": delta_g(params), "delta_v": delta_v(params, t),
            "laplace_scale": laplace_scale(params, t)})
    return out
