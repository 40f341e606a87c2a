"""Codes for text features during training.

Trees are grown on numbers only: fixed-width histogram keys and one array of features per
row. Codes follow the alphabetical order, so ties fall as they would on the text. A feature
whose dictionary is too long for the driver keeps its text.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import and_
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.operators.prefix import distinct_counts
from quietgrove.plans.trees import Node, Split, Tree
from quietgrove.scratch import Scratch
from quietgrove.spec import Feature, Scaled

DICTIONARY_ROWS = 10_000


class Coder:
    def __init__(self, features: Sequence[Feature], words: Mapping[str, list[str]]):
        self.words = dict(words)
        self.original = {f.index: f for f in features}
        self.features = [replace(f, text=False) if f.name in self.words else f for f in features]

    @classmethod
    def measure(cls, df: DataFrame, features: Sequence[Feature], counts: Mapping[str, int]
                ) -> "Coder":
        """Dictionaries of the text features whose approximate size allows it."""
        short = [f.name for f in features if f.text and counts[f.name] <= DICTIONARY_ROWS]
        if not short:
            return cls(features, {})
        found = df.agg(*[F.sort_array(F.collect_set(c)).alias(f"c{i}")
                         for i, c in enumerate(short)]).first()
        return cls(features, {c: list(found[f"c{i}"]) for i, c in enumerate(short)})

    def encode(self, df: DataFrame) -> DataFrame:
        columns = df.columns
        for c, words in self.words.items():
            table = df.sparkSession.createDataFrame(
                [(w, float(i)) for i, w in enumerate(words)], "_word string, _code double")
            df = (df.join(F.broadcast(table), F.col(c) == F.col("_word"), "left")
                  .withColumn(c, F.col("_code")).drop("_word", "_code"))
        return df.select(*columns)

    def categories(self, declared: Mapping) -> dict:
        """Declared categories by code; ones that do not occur get codes of their own."""
        out = {}
        for name, given in declared.items():
            if name not in self.words or isinstance(given, int):
                out[name] = given
                continue
            place = {w: i for i, w in enumerate(self.words[name])}
            unseen = [w for w in given if w not in place]
            place.update({w: len(place) + i for i, w in enumerate(unseen)})
            out[name] = [place[w] for w in given]
        return out

    def decode(self, tree: Tree, scaled: Mapping[str, Scaled] = {}) -> Tree:
        """The tree over the original columns; ``scaled`` were mapped before training."""
        nodes = {}
        for i, n in tree.nodes.items():
            s = n.split
            if s is not None and s.feature.name in self.words:
                s = Split(self.original[s.feature.index], None,
                          self.words[s.feature.name][int(s.value)], s.gain)
            elif s is not None and s.feature.name in scaled:
                s = replace(s, feature=replace(s.feature, scaled=scaled[s.feature.name]))
            nodes[i] = Node(n.node_id, n.n, n.g, n.h, s, n.prediction)
        return Tree(nodes)


class TrainingTable:
    """Stored rows with text features as codes, and what is known about them.

    Rows that miss a feature do not train: a missing value is on neither side of a split.
    (Trees send such rows to the right when they are applied.)
    """

    def __init__(self, df: DataFrame, features: Sequence[Feature], scratch: Scratch):
        whole = [F.col(text.name(f.name)).isNotNull() for f in features]
        raw = scratch.save(df.where(reduce(and_, whole)) if whole else df)
        self.n, self.counts = distinct_counts(raw, [f.name for f in features])
        self.coder = Coder.measure(raw, features, self.counts)
        cores = df.sparkSession.sparkContext.defaultParallelism
        few = len(raw.inputFiles()) < cores
        if few or self.coder.words:
            coded = self.coder.encode(raw)
            # A table in few files is small; a file per core lets all cores scan it.
            self.rows = scratch.save(coded.repartition(cores) if few else coded)
            scratch.release(raw)
        else:
            self.rows = raw
