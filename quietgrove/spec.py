"""Declarations: which columns play which role, and how an ensemble is trained."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Mapping, Optional, Sequence, Union

from quietgrove.functions import text

NUMERIC = "numeric"
CATEGORICAL = "categorical"
TARGET = "target"
DROP = "drop"


@dataclass(frozen=True)
class TableSpec:
    """Column roles of one input table, by name and in file order.

    A column that is neither a feature, the target nor an id is dropped.
    """

    name: str
    columns: tuple[str, ...]
    target: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    row_id: Optional[str] = None
    task: str = "regression"
    format: str = "csv"
    sep: str = ","
    header: bool = False
    missing: str = "?"

    def __post_init__(self):
        roles = [*self.numeric, *self.categorical, self.target]
        unknown = [c for c in roles if c not in self.columns]
        if unknown:
            raise ValueError(f"{self.name}: roles given to unknown columns {unknown}")
        if len(set(roles)) != len(roles):
            raise ValueError(f"{self.name}: a column has two roles")

    def role(self, column: str) -> str:
        if column == self.target:
            return TARGET
        if column in self.numeric:
            return NUMERIC
        return CATEGORICAL if column in self.categorical else DROP

    @property
    def features(self) -> tuple[str, ...]:
        """Features in file order, which is also the tie order of split search."""
        return tuple(c for c in self.columns if c in self.numeric or c in self.categorical)


@dataclass(frozen=True)
class Scaled:
    """A fitted map of a column: clipped to [lower, upper], then stretched onto [lo, hi].
    Without a width all values become ``lo``."""

    lower: float
    upper: float
    lo: float
    hi: float

    def sql(self, column: str) -> str:
        """The mapped column as SQL text; null stays null."""
        a, b, lo, hi = (text.literal(float(v)) for v in (self.lower, self.upper, self.lo, self.hi))
        width = text.literal(float((self.upper - self.lower) or 1.0))
        stretch = text.literal(float(self.hi - self.lo))
        clipped = f"greatest({a}, least(CAST({column} AS double), {b}))"
        return f"CASE WHEN {column} IS NOT NULL THEN ({clipped} - {a}) / {width} * {stretch} + {lo} END"


@dataclass(frozen=True)
class Feature:
    """One model input. ``text`` marks a categorical column kept as a string; ``scaled`` is the
    map that a column goes through before it is compared with a split."""

    index: int
    name: str
    is_cat: bool = False
    text: bool = False
    scaled: Optional[Scaled] = None

    def sql(self) -> str:
        """The value that splits are compared with."""
        column = text.name(self.name)
        return f"({self.scaled.sql(column)})" if self.scaled else column


@dataclass(frozen=True)
class Grid:
    """Data-independent split points lo, lo + step, ... below hi."""

    lo: float
    hi: float
    step: float

    @property
    def size(self) -> int:
        # The small tolerance keeps (1 - 0) / 0.1 at 10 points.
        return int(math.floor((self.hi - self.lo) / self.step + 1e-9))


@dataclass(frozen=True)
class FeatureScaling:
    """Private scaling of the numeric features onto the grid before training.

    ``budget`` is taken from the privacy budget and divided evenly among the columns. ``lo`` and
    ``hi`` are public limits of the values, for all columns or by name; the bounds found inside
    hold the central ``percentile`` percent of a column.
    """

    budget: float
    lo: Union[float, Mapping[str, float]]
    hi: Union[float, Mapping[str, float]]
    percentile: float = 95.0

    def limits(self, column: str) -> tuple[float, float]:
        return tuple(float(v[column] if isinstance(v, Mapping) else v) for v in (self.lo, self.hi))


@dataclass(frozen=True)
class ModelParams:
    """Everything the trainer needs to know besides the data."""

    task: str = "regression"  # regression | binary | multiclass
    n_classes: int = 1  # number of trees per round; > 1 for multiclass only
    nb_trees: int = 50
    max_depth: int = 6
    learning_rate: float = 0.1
    min_samples_split: int = 2
    l2_lambda: float = 0.1
    l2_threshold: float = 1.0
    privacy_budget: float = 0.0  # 0 turns every private step off
    budget_cap: float = 1000.0  # a larger budget is used only up to here; the ledger shows it
    gradient_filtering: Union[bool, str] = False  # True or "fill": only rows that need no
    # clipping while there are enough; "drop": rows that need it are left to later trees
    leaf_clipping: bool = True
    balance_partition: bool = True
    use_decay: bool = False
    growth: str = "level"  # level | best_first | sibling
    max_leaves: Optional[int] = None
    trees_per_ensemble: Optional[int] = None
    candidates: str = "distinct"  # distinct | grid
    grid: Optional[Grid] = None
    categories: dict = field(default_factory=dict)  # declared categories by feature
    multiclass_budget: str = "sequential"  # sequential (/K) | halved (/2)
    shuffle: bool = True  # random row allotment; False takes rows by id
    argmax_splits: bool = False  # with a budget: no random choice (for comparison runs)
    noise: bool = True  # with a budget: False leaves the Laplace noise out
    floor_digits: bool = False  # floor gradients to 1e-15 and gains to 1e-10
    reject: bool = False
    validation: float = 0.3
    early_stop: int = 5  # rejected trees after which training ends
    allow_private_rejection: bool = False
    private_init: Optional[float] = None  # budget for a noisy init score
    scaling: Optional[FeatureScaling] = None  # with a budget and grid candidates
    seed: Optional[str] = None
    refresh_every: int = 6

    def __post_init__(self):
        if self.task not in ("regression", "binary", "multiclass"):
            raise ValueError(f"unknown task {self.task}")
        if self.growth not in ("level", "best_first", "sibling"):
            raise ValueError(f"unknown growth {self.growth}")
        if self.task == "multiclass" and self.n_classes < 2:
            raise ValueError("multiclass needs n_classes >= 2")
        if self.candidates == "grid" and self.grid is None:
            raise ValueError("candidates='grid' needs a grid")
        if self.gradient_filtering not in (False, True, "fill", "drop"):
            raise ValueError(f"unknown gradient filtering {self.gradient_filtering}")
        if self.reject and self.early_stop < 1:
            raise ValueError("early_stop must be at least 1")
        if self.scaling and not (self.private and self.candidates == "grid"):
            raise ValueError("private feature scaling needs a budget and grid candidates")
        if self.scaling and not 0 < self.scaling.budget < min(self.privacy_budget, self.budget_cap):
            raise ValueError("the budget of feature scaling must be a part of the privacy budget")
        if self.reject and self.private and not self.allow_private_rejection:
            raise ValueError(
                "tree rejection reads hold-out scores without paying for them; "
                "set allow_private_rejection=True to run it with a budget anyway"
            )

    @property
    def private(self) -> bool:
        return self.privacy_budget > 0

    @property
    def per_ensemble(self) -> int:
        return self.trees_per_ensemble or self.nb_trees

    def with_(self, **changes) -> "ModelParams":
        return replace(self, **changes)


def feature_list(df, numeric: Sequence[str], categorical: Sequence[str],
                 order: Optional[Sequence[str]] = None) -> list[Feature]:
    """Number the features; a string categorical is kept as text."""
    types = dict(df.dtypes)
    names = list(order) if order else [*numeric, *categorical]
    out = []
    for i, name in enumerate(names):
        is_cat = name in set(categorical)
        out.append(Feature(i, name, is_cat, is_cat and types[name] == "string"))
    return out
