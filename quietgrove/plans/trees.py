"""Trees as small driver-side tables and as Columns.

A node id is its position in a complete binary tree: the root is 0, the children of i are
2i + 1 (left) and 2i + 2 (right).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietgrove.functions import text
from quietgrove.spec import Feature

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType()), T.StructField("class_id", T.IntegerType()),
    T.StructField("node_id", T.LongType()), T.StructField("depth", T.IntegerType()),
    T.StructField("is_leaf", T.BooleanType()), T.StructField("feature", T.StringType()),
    T.StructField("is_cat", T.BooleanType()), T.StructField("split_value", T.DoubleType()),
    T.StructField("split_category", T.StringType()), T.StructField("gain", T.DoubleType()),
    T.StructField("n", T.LongType()), T.StructField("left", T.LongType()),
    T.StructField("right", T.LongType()), T.StructField("prediction", T.DoubleType()),
])

# Up to this many nodes a tree is compiled to nested CASE expressions, which code
# generation turns into plain branches; larger trees are walked (see ``walks``).
COMPILED_NODES = 512
# Of more alternative trees than these, the one for a row is looked up too.
COMPILED_TREES = 8


@dataclass
class Split:
    feature: Feature
    value: Optional[float]
    category: Optional[str]
    gain: float

    def goes_left(self) -> str:
        """SQL condition of the left branch."""
        col = self.feature.sql()
        if self.feature.text:
            return f"{col} = {text.literal(self.category)}"
        return f"{col} {'=' if self.feature.is_cat else '<'} {text.literal(float(self.value))}"


@dataclass
class Node:
    node_id: int
    n: int = 0
    g: float = 0.0
    h: float = 0.0
    split: Optional[Split] = None
    prediction: Optional[float] = None

    @property
    def depth(self) -> int:
        return (self.node_id + 1).bit_length() - 1

    @property
    def children(self) -> tuple[int, int]:
        return 2 * self.node_id + 1, 2 * self.node_id + 2


@dataclass
class Tree:
    nodes: dict[int, Node] = field(default_factory=dict)

    @property
    def leaves(self) -> list[Node]:
        return [n for i, n in sorted(self.nodes.items()) if n.split is None]

    @property
    def depth(self) -> int:
        return max((n.depth for n in self.nodes.values()), default=0)

    def value_sql(self) -> str:
        return self.sql(lambda n: float(n.prediction or 0.0), "double")

    def sql(self, leaf: Callable[[Node], object], kind: str) -> str:
        """The value of ``leaf`` at the leaf that a row falls into, as nested branches."""
        def at(node_id: int) -> str:
            node = self.nodes[node_id]
            if node.split is None:
                return text.literal(leaf(node), kind)
            left, right = (at(c) for c in node.children)
            return text.case([(node.split.goes_left(), left)], right)

        return at(0)

    def rows(self, tree_id: int, class_id: int) -> list[tuple]:
        out = []
        for i, n in sorted(self.nodes.items()):
            s = n.split
            left, right = n.children if s else (None, None)
            out.append((tree_id, class_id, i, n.depth, s is None, s and s.feature.name,
                        s.feature.is_cat if s else None, s and s.value, s and s.category,
                        s and float(s.gain), int(n.n), left, right,
                        None if s else float(n.prediction)))
        return out


def ancestors(leaf_id: Column) -> Column:
    """Node ids from the root to ``leaf_id``."""
    depth = F.floor(F.log2(leaf_id.cast("double") + 1)).cast("int")
    # shiftright wants a fixed distance, so halve with integer division by powers of two.
    return F.transform(F.sequence(depth, F.lit(0), F.lit(-1)), lambda up: (
        F.floor((leaf_id + 1) / F.pow(F.lit(2.0), up)) - 1).cast("bigint"))


def nodes_frame(spark: SparkSession, trees: Sequence[Sequence[Tree]]) -> DataFrame:
    rows = [r for t, round_ in enumerate(trees) for k, tree in enumerate(round_)
            for r in tree.rows(t, k)]
    return spark.createDataFrame(rows, NODE_SCHEMA)
