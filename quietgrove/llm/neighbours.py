"""Approximate nearest neighbours by inner product over learned partitions.

A router (see ``partitions``) is learned on a bounded sample. A part that holds more than
``SPLIT_ROWS`` vectors gets a router of its own, learned on a bounded sample of that part, and so on,
so parts stay small as the table grows. How many of the most probable parts a query must visit is
calibrated on the sample. ``search`` routes every vector of the table to its most probable part and
every query to several; each (part, slice of candidates, slice of the part's queries) is one task that
computes inner products, keeps its best and rescores them in double precision in a fixed order. The
best of all slices is the answer. Vectors are sent once for each slice of the queries that ask for
their part.

Equal vectors are searched once: a vector stands for all its ids, and no more than ``k + 1`` of
them, the smallest, can matter for one query, so that is exact. They are found by a ranked
window that Spark cuts short before the exchange; no group of copies meets in one task.
Parts are cut into slices of bounded size, so a crowded part means more tasks, not longer ones.
All routers together are broadcast; there are ``MAX_ROUTERS`` at most (64 MB at 64 dimensions), and
parts that could not be split further are only cut into slices.

How many parts are visited follows from the data: vectors in tight groups need few, vectors
without structure nearly all (then the search approaches an exact one instead of losing
recall).

Defined cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do null ids; repeated rows of an id with an equal vector
count once; fewer than ``k`` candidates are all returned; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietgrove.functions.text import literal_array
from quietgrove.llm.partitions import Router, learn
from quietgrove.scratch import Scratch

#: Vectors that the router is learned on.
SAMPLE = 8_192
MAX_PARTS = 32
ROWS_PER_PART = 64
CALIBRATION_QUERIES = 512
RECALL = 0.95
SLICE = 4_096
QUERY_SLICE = 1_024
#: Vectors of a part from which it is split by a router of its own.
SPLIT_ROWS = 4 * SLICE
MAX_ROUTERS = 640
_ROUTE_ROWS = 512


@dataclass
class Index:
    """Routers in a tree. The parts of the first are 0, 1, ...; a part in ``inner`` is split further, by
    a router whose parts are numbered from the given one on."""

    router: Router
    inner: dict[int, tuple[int, Router]] = field(default_factory=dict)
    probes: int = 1

    @property
    def n_parts(self) -> int:
        return self.router.n_parts + sum(r.n_parts for _, r in self.inner.values())

    def own_part(self, vectors: np.ndarray) -> np.ndarray:
        """The part of each vector: the most probable one at every router on its way."""
        part = self.router.top(vectors, 1)[:, 0].astype(np.int64)
        # a part's number is larger than that of the part it was split from
        for p, (base, router) in sorted(self.inner.items()):
            at = np.nonzero(part == p)[0]
            if len(at):
                part[at] = base + router.top(vectors[at], 1)[:, 0]
        return part

    def chances(self, vectors: np.ndarray) -> np.ndarray:
        """Log probability of every part, -inf for those that are split further."""
        out = np.full((len(vectors), self.n_parts), -np.inf)
        out[:, :self.router.n_parts] = _log_share(self.router.logits(vectors))
        for p, (base, router) in sorted(self.inner.items()):
            out[:, base:base + router.n_parts] = out[:, [p]] + _log_share(router.logits(vectors))
            out[:, p] = -np.inf
        return out

    def order(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of each vector, most probable first."""
        if not self.inner:
            return self.router.top(vectors, probes)
        return np.concatenate([np.argsort(-self.chances(vectors[b:b + _ROUTE_ROWS]), axis=1, kind="stable")[:, :probes]
                               for b in range(0, len(vectors), _ROUTE_ROWS)])

    def calibrate(self, sample: np.ndarray, k: int, recall: float, seed: int = 5) -> "Index":
        """Set ``probes`` to what reaches ``recall`` on the sample's own neighbours."""
        n, leaves = len(sample), self.n_parts - len(self.inner)
        if leaves == 1 or n < 2:
            self.probes = leaves
            return self
        asked = np.random.default_rng(seed).permutation(n)[:CALIBRATION_QUERIES]
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        found = np.argpartition(-near, min(k, n - 1) - 1, axis=1)[:, :min(k, n - 1)]
        own = self.own_part(sample)
        rank = np.argsort(self.order(sample[asked], self.n_parts), axis=1)
        needed = np.take_along_axis(rank, own[found], axis=1)
        reached = np.cumsum(np.bincount(needed.ravel(), minlength=leaves)) / needed.size
        self.probes = next((p for p, r in enumerate(reached, 1) if r >= recall), leaves)
        return self


def _log_share(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector has no null or non-finite component and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def part_count(sampled: int, max_parts: int) -> int:
    """A power of two of parts, with ``ROWS_PER_PART`` vectors of the sample in each at least."""
    parts = 1
    while 2 * parts <= max_parts and 2 * parts * ROWS_PER_PART <= sampled:
        parts *= 2
    return parts


def learn_index(sample: np.ndarray, k: int, recall: float = RECALL, max_parts: int = MAX_PARTS,
                seed: int = 5) -> Index:
    """One router, and the number of probes that reach ``recall`` on the sample's own neighbours."""
    return Index(learn(sample, part_count(len(sample), max_parts), seed)).calibrate(
        sample, k, recall, seed)


def grow(index: Index, reps: DataFrame, sample: np.ndarray, k: int, recall: float, max_parts: int) -> Index:
    """Split crowded parts by routers learned on samples of their own, until none is crowded."""
    tried: set[int] = set()
    spark = reps.sparkSession
    while len(index.inner) + 1 < MAX_ROUTERS:
        shared = spark.sparkContext.broadcast(index)
        placed = reps.select("rep", "vector", _part_of(shared)("vector").alias("part"))
        crowded = [r["part"] for r in placed.groupBy("part").count().where(
            F.col("count") > SPLIT_ROWS).orderBy("part").collect() if r["part"] not in tried]
        crowded = crowded[:MAX_ROUTERS - 1 - len(index.inner)]
        if not crowded:
            break
        first = Window.partitionBy("part").orderBy(F.xxhash64("rep"), "rep")
        some = placed.where(F.col("part").isin(crowded)).withColumn("n", F.row_number().over(first)).where(
            F.col("n") <= SAMPLE)

        def learned(rows: pd.DataFrame) -> pd.DataFrame:
            own = np.stack(rows.sort_values("n")["vector"].to_numpy()).astype(np.float64)
            router = learn(own, part_count(len(own), max_parts))
            return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [pickle.dumps(router)]})

        found = some.groupBy("part").applyInPandas(learned, "part long, router binary").collect()
        for r in sorted(found, key=lambda r: r["part"]):
            tried.add(r["part"])
            router = pickle.loads(r["router"])
            if router.n_parts > 1:
                index.inner[r["part"]] = (index.n_parts, router)
        shared.unpersist()
    return index.calibrate(sample, k, recall) if index.inner else index


def _part_of(shared):
    @F.pandas_udf("long")
    def own_part(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int64")
        return pd.Series(shared.value.own_part(np.stack(vectors.to_numpy()).astype(np.float64)))

    return own_part


def _best(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 nearest candidates of each query, rescored alike for equal vectors."""
    columns = ["query", "rep", "score"]
    if not len(queries) or not len(candidates):
        return pd.DataFrame({c: [] for c in columns})
    c = np.stack(candidates["vector"].to_numpy()).astype(np.float64)
    reps = candidates["rep"].to_numpy()
    out = []
    for begin in range(0, len(queries), 256):
        part = queries.iloc[begin:begin + 256]
        q = np.stack(part["vector"].to_numpy()).astype(np.float64)
        rough = q @ c.T
        take = min(k + 1, len(c))
        floor = np.partition(rough, len(c) - take, axis=1)[:, len(c) - take]
        for i, row in enumerate(rough):
            at = np.nonzero(row >= floor[i] - 1e-9 * max(1.0, abs(floor[i])))[0]
            exact = np.einsum("cd,d->c", c[at], q[i])
            order = np.lexsort((reps[at], -exact))[:take]
            out.append((np.full(len(order), part["rep"].iat[i]), reps[at][order], exact[order]))
    return pd.DataFrame(dict(zip(columns, (np.concatenate(x) for x in zip(*out)))))


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id",
           vector: str = "embedding", recall: float = RECALL, max_parts: int = MAX_PARTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query row of ``df``.

    ``is_query`` is a condition on the key column named ``vec_id``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"),
                     F.col(f"`{vector}`").cast("array<double>").alias("vector")
                     ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    usual = rows.groupBy(F.size("vector").alias("size")).count().orderBy(
        F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == usual["size"]).distinct()

    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    first_ids = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    reps = scratch.save(first_ids.groupBy("vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    asking = rows.where(is_query).select("vec_id", "vector")
    asked = scratch.save(asking.join(reps.select("vector", "rep"), "vector").select(
        F.col("vec_id").alias("query_id"), "rep"))

    sample = np.array([r["vector"] for r in reps.select("rep", "vector").orderBy(
        F.xxhash64("rep"), "rep").limit(SAMPLE).collect()], dtype=np.float64)
    learned = grow(learn_index(sample, k, recall, max_parts), reps, sample, k, recall, max_parts)
    index = spark.sparkContext.broadcast(learned)
    probes = learned.probes

    @F.pandas_udf("array<int>")
    def probed_parts(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(index.value.order(np.stack(vectors.to_numpy()), probes).astype(np.int32)))

    placed = scratch.save(reps.select("rep", "vector", _part_of(index)("vector").cast("int").alias("part")))
    queries = scratch.save(asked.select("rep").distinct().join(reps.select("rep", "vector"), "rep")
                           .withColumn("parts", probed_parts("vector")))

    def cuts(rows: DataFrame, size: int) -> Column:
        """How many slices of at most about ``size`` rows each part has; there is a number per part."""
        n = dict.fromkeys(range(learned.n_parts), 0)
        n.update({r["part"]: -(-r["count"] // size) for r in rows.groupBy("part").count().collect()})
        return F.get(F.expr(literal_array([n[p] for p in range(learned.n_parts)], "int")), F.col("part"))

    asking = queries.select("rep", "vector", F.explode("parts").alias("part"))
    slices, query_slices = cuts(placed, SLICE), cuts(asking.select("part"), QUERY_SLICE)
    dealt = placed.withColumn("slice", F.pmod(F.xxhash64("rep"), slices).cast("int"))
    dealt = dealt.where(query_slices > 0).withColumn("query_slice", F.explode(F.sequence(
        F.lit(0), query_slices - 1)))
    asking = asking.where(slices > 0).withColumn("query_slice", F.pmod(
        F.xxhash64("rep"), query_slices).cast("int"))
    asking = asking.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))

    cell = ["part", "slice", "query_slice"]
    found = asking.groupBy(cell).cogroup(dealt.groupBy(cell)).applyInPandas(
        lambda q, c: _best(q, c, k), "query long, rep long, score double")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    best = found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1)
    listed = best.join(reps.select("rep", "ids"), "rep").groupBy("query").agg(
        F.collect_list(F.struct((-F.col("score")).alias("minus"), "ids")).alias("hits"))
    entries = F.flatten(F.transform("hits", lambda h: F.transform(
        h["ids"], lambda i: F.struct(h["minus"].alias("minus"), i.alias("vec_id")))))
    listed = listed.select(F.col("query").alias("rep"), F.slice(
        F.sort_array(entries), 1, k + 1).alias("hits"))
    out = asked.join(listed, "rep").select("query_id", F.slice(F.filter(
        "hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k).alias("hits"))
    return out.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        (-F.col("hit.minus")).alias("score"))
