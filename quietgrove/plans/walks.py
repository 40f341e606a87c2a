"""Rows walk down trees through literal arrays, one step per level.

All nodes of the trees lie in shared arrays, the two children of a node side by side. A step
reads the feature, value and left child of the node that a row is at; each step is an alias that
refers to the step before. Code generation turns this into a few array reads per level whose code
depends on the depth only, so it is reused from tree to tree and does not grow with the nodes.

An array is written as one string that is split and cast. Spark folds that into a literal while
planning, and its parser sees a single token, however many nodes there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame

from quietgrove.functions import text
from quietgrove.functions.text import literal_array
from quietgrove.plans.trees import Node, Tree
from quietgrove.spec import Feature


@dataclass
class Layout:
    """Nodes in breadth-first order. The roots come first, in the order given."""

    nodes: list[Node] = field(default_factory=list)
    root: list[int] = field(default_factory=list)  # which root a node lies below
    left: list[int] = field(default_factory=list)  # place of the left child, -1 at a leaf
    depth: int = 0

    @classmethod
    def of(cls, roots: Sequence[tuple[Tree, int]]) -> "Layout":
        out = cls()
        level = [(tree, tree.nodes[i], r) for r, (tree, i) in enumerate(roots)]
        out.nodes = [n for _, n, _ in level]
        out.root = [r for _, _, r in level]
        while True:
            below = []
            for tree, node, r in level:
                out.left.append(len(out.nodes) if node.split else -1)
                if node.split:
                    for child in node.children:
                        out.nodes.append(tree.nodes[child])
                        out.root.append(r)
                        below.append((tree, tree.nodes[child], r))
            if not below:
                return out
            level, out.depth = below, out.depth + 1

    def steps(self, start: str, x: str, number: Callable[[Node], float], place: Callable[[Node], int],
              prefix: str) -> list[str]:
        """SELECT list that leads from ``start`` to the alias ``{prefix}{depth}``. ``x`` is an array
        of numbers; ``place`` names a split's entry in it and ``number`` what it is compared with."""
        out = [f"{start} AS {prefix}0"]
        if not self.depth:
            return out
        inner = [n if n.split else None for n in self.nodes]
        flags = [bool(n and n.split.feature.is_cat) for n in inner]
        left = literal_array(self.left, "int")
        feature = literal_array([place(n) if n else 0 for n in inner], "int")
        value = literal_array([float(number(n)) if n else 0.0 for n in inner], "double")
        entry, bound = f"get({x}, get({feature}, {{at}}))", f"get({value}, {{at}})"
        if not any(flags):
            test = f"{entry} < {bound}"
        elif all(f for f, n in zip(flags, inner) if n):
            test = f"{entry} = {bound}"
        else:
            test = (f"CASE WHEN get({literal_array(flags, 'boolean')}, {{at}}) THEN {entry} = {bound} "
                    f"ELSE {entry} < {bound} END")
        step = (f"CASE WHEN get({left}, {{at}}) < 0 THEN {{at}} WHEN {test} THEN get({left}, {{at}}) "
                f"ELSE get({left}, {{at}}) + 1 END")
        return out + [f"{step.format(at=f'{prefix}{d}')} AS {prefix}{d + 1}" for d in range(self.depth)]


@dataclass
class Lookup:
    """A column to add: ``leaf`` of the leaf that a row reaches. Of several trees the one whose
    condition holds is walked; without one the result is null. ``which`` may give the number of that
    tree as SQL text, in place of trying the conditions."""

    name: str
    trees: Sequence[tuple[Optional[str], Tree]]
    leaf: Callable[[Node], object]
    kind: str = "double"
    which: Optional[str] = None


def is_large(alternatives: Sequence[tuple[Optional[str], Tree]]) -> bool:
    from quietgrove.plans import trees
    return len(alternatives) > trees.COMPILED_TREES or sum(len(t.nodes) for _, t in alternatives) > trees.COMPILED_NODES


def looked_up(df: DataFrame, lookups: Sequence[Lookup]) -> DataFrame:
    """``df`` with a column per lookup. Small trees are compiled to branches, others walked."""
    for one in lookups:
        kept = text.names(df.columns)
        if is_large(one.trees):
            df = _walked(df, one).selectExpr(*kept, one.name)
        else:
            parts = [(c, t.sql(one.leaf, one.kind)) for c, t in one.trees]
            value = parts[0][1] if parts[0][0] is None else text.case(parts)
            df = df.selectExpr(*kept, f"{value} AS {one.name}")
    return df


def _walked(df: DataFrame, one: Lookup) -> DataFrame:
    layout = Layout.of([(t, 0) for _, t in one.trees])
    used: dict[int, Feature] = {}
    words: dict[int, dict] = {}
    for n in layout.nodes:
        if n.split:
            f = n.split.feature
            used[f.index] = f
            if f.text:
                known = words.setdefault(f.index, {})
                known.setdefault(n.split.category, len(known) + 1)
    place = {i: p for p, i in enumerate(sorted(used))}

    def entry(i: int) -> str:
        if i not in words:
            return f"CAST({used[i].sql()} AS double)"
        listed = ", ".join(text.literal(w) for w in words[i])
        return f"CAST(array_position(array({listed}), {used[i].sql()}) AS double)"

    def number(n: Node) -> float:
        f = n.split.feature
        return float(words[f.index][n.split.category]) if f.text else float(n.split.value)

    x = f"array({', '.join(entry(i) for i in sorted(used)) or '0.0D'}) AS _wx"
    roots = [(c, str(r)) for r, (c, _) in enumerate(one.trees)]
    start = one.which or (roots[0][1] if roots[0][0] is None else text.case(roots))
    steps = layout.steps(start, "_wx", number, lambda n: place[n.split.feature.index], "_w")
    values = [None if n.split else one.leaf(n) for n in layout.nodes]
    end = f"_w{layout.depth}"
    if one.kind == "double":
        value = f"get({literal_array([float(v or 0.0) for v in values], 'double')}, {end})"
    else:
        value = f"nullif(get({literal_array([-1 if v is None else int(v) for v in values], 'bigint')}, {end}), -1L)"
    return df.selectExpr("*", x).selectExpr("*", *steps, f"{value} AS {one.name}")


def leaf_value(node: Node) -> float:
    return float(node.prediction or 0.0)


def boosted(df: DataFrame, totals: dict[str, tuple[str, Sequence[Sequence[tuple[Optional[str], Tree]]]]],
            learning_rate: float, which: Optional[str] = None) -> DataFrame:
    """``df`` with ``name = start + learning_rate * (sum of trees)`` for each ``name: (start, trees)``.

    A tree is a list of (condition, tree): the one whose condition holds counts, or none; ``which``
    as in ``Lookup``.
    """
    names, lookups, sums = text.names(df.columns), [], []
    for name, (start, rounds) in totals.items():
        parts = []
        for trees in rounds:
            if is_large(trees):
                found = f"_tree_{len(lookups)}"
                lookups.append(Lookup(found, trees, leaf_value, which=which))
                parts.append(f"coalesce({found}, 0.0D)")
            else:
                cases = [(c, t.value_sql()) for c, t in trees]
                parts.append(cases[0][1] if cases[0][0] is None else text.case(cases, "0.0D"))
        total = " + ".join(parts) or "0.0D"
        sums.append((name, f"{start} + {text.literal(float(learning_rate))} * ({total})"))
    new = {n for n, _ in sums}
    kept = [c for c in names if c.strip("`") not in new]
    return looked_up(df, lookups).selectExpr(*kept, *[f"{s} AS {text.name(n)}" for n, s in sums])
