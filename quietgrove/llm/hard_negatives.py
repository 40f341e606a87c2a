"""Hard negatives by inner product, with LEMP-style pruning by length and by coordinates.

Vectors become whole numbers (``floor(scale * x)``), so scores are exact and every tie is a true
tie. All rows are range-partitioned by length, longest first, and packed into buckets of bounded
size. A bucket holds its vectors and, for each coordinate, the order of its rows by that
coordinate of the unit vector.

Anchors are packed into chunks. A chunk meets a bucket in one task (a cell); neither side is ever
whole in one place. Two searches run over such cells, first for each anchor's positives and then
for its negatives inside the bands that the positives' scores open. Each search has two steps:

1. Cells with the longest buckets give every anchor a first list. The score at its end bounds
   from below what can still enter (for negatives, the foot of the band does so from the start).
2. With that bound, buckets whose longest vector is too short for a chunk are left out
   altogether. In the others an anchor's angle to a vector that reaches the bound is limited, and
   with it, by the triangle inequality on angles, the vector's angle to each axis. For the
   anchor's largest coordinates (its focus) this is a range of the bucket's sorted list, found by
   binary search; the rows in the ranges of all focus coordinates are the candidates, and only
   they are verified by exact products. Where the ranges exclude little, as for vectors without
   structure, the whole bucket is verified by one matrix product.

Nothing is dropped by either step, so the result is exact.

Defined cases: rows with a null id or label, a null or empty vector, or any null or non-finite
component take no part, nor do vectors of another length than most (the longer length where two
are equally frequent). Equal rows count once. Rows of an anchor's own id are never its partners.
Fewer partners than asked for are all returned; an anchor without a positive has no rows.
Components are limited to the range of a long; a score beyond that range is given, and tied, as its
end. Zero vectors take part (their scores are 0). Empty tables give an empty result. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietgrove.scratch import Scratch

#: Rows of a bucket and anchors of a chunk, at most; long vectors make them fewer.
BUCKET_ROWS = 4_096
CHUNK_ROWS = 2_048
_COMPONENTS = 1 << 21
#: Length classes that bounds are looked up in; each holds the same number of buckets.
MAX_CLASSES = 4_096
#: Largest coordinates of an anchor that its candidates are intersected on.
FOCUS = 4
#: Share of a bucket up to which single rows are verified in place of the whole bucket.
SPARSE = 0.25
#: Room for rounding in bounds that only decide what is looked at.
SLACK = 1e-9
_LONG = 2 ** 63 - 1
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BUCKET = ("bucket long, class int, n int, ids binary, labels array<string>, kind string, vectors binary, "
           "lengths binary, orders binary, longest double")
_ANCHOR = "anchor long, chunk long, id long, label string, vector binary, length double"
_HIT = "anchor long, band long, id long, score long"


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _smallest_kind(x: np.ndarray) -> str:
    """The narrowest type for the components."""
    top = max(abs(int(x.max())), abs(int(x.min())))
    return next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 64)) if top < 2 ** bits)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _number(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else column.chunk(0)


def _packer(bucket_rows: int, per_class: int):
    """Rows of one length range to buckets, each with a sorted list per coordinate."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        table = _whole(batches)
        if table is None:
            return
        x, ids, labels = _matrix(_column(table, "vector")), _number(table, "id"), _column(table, "label")
        lengths = _lengths(x)
        by_length = np.lexsort((ids, -lengths))
        for i, rows in enumerate(np.array_split(by_length, -(-len(x) // bucket_rows))):
            own, size = x[rows], lengths[rows]
            unit = own / np.where(size > 0, size, 1.0)[:, None]
            orders = np.argsort(unit, axis=0, kind="stable").T.astype("<u2")
            kind = _smallest_kind(own)
            yield pa.RecordBatch.from_pylist([{
                "bucket": (part << 20) + i, "class": part // per_class, "n": len(rows),
                "ids": ids[rows].astype("<i8").tobytes(), "labels": labels.take(pa.array(rows)).to_pylist(),
                "kind": kind, "vectors": own.astype(kind).tobytes(), "lengths": size.astype("<f8").tobytes(),
                "orders": orders.tobytes(), "longest": float(size.max())}], schema=_schema(_BUCKET))

    return pack


def _anchor_packer(chunk_rows: int):
    """Number the anchors of a task and cut them into chunks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            x = _matrix(_column(table, "vector"))
            number = np.arange(at, at + len(x))
            at += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 40) + number), pa.array((part << 30) + number // chunk_rows),
                 _column(table, "id"), _column(table, "label"),
                 pa.array([row.tobytes() for row in x.astype("<i8")], pa.binary()), pa.array(_lengths(x))],
                schema=_schema(_ANCHOR))

    return pack


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
             "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, limited to the range of a long."""
    top = [max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0 for v in (a, b)]
    bound = top[0] * top[1] * a.shape[1]
    if bound < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound <= _LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


def feasible(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per axis, the least and largest coordinate of a unit vector at ``cosine`` or more to ``unit``."""
    to_axis = np.arccos(np.clip(unit, -1.0, 1.0))
    off = np.arccos(min(1.0, max(-1.0, cosine)))
    return (np.cos(np.minimum(to_axis + off, np.pi)) - SLACK,
            np.cos(np.maximum(to_axis - off, 0.0)) + SLACK)


class _Bucket:
    def __init__(self, table: pa.Table):
        row = {c: table.column(c)[0].as_py() for c in table.column_names}
        self.n, self.longest = row["n"], row["longest"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = np.array(row["labels"], dtype=object)
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(self.n, -1)
        self.orders = np.frombuffer(row["orders"], "<u2").reshape(-1, self.n)
        lengths = np.frombuffer(row["lengths"], "<f8")
        self.scale = np.where(lengths > 0, lengths, 1.0)

    def candidates(self, q: np.ndarray, length: float, floor: float) -> np.ndarray | None:
        """Rows whose focus coordinates are feasible for a score of ``floor``; None for all rows."""
        reach = length * self.longest
        if floor <= 0 or reach == 0:
            return None
        if floor > reach * (1 + SLACK):
            return np.empty(0, dtype=np.int64)
        unit = q / length
        low, high = feasible(unit, floor / reach)
        count, asked = np.zeros(self.n, dtype=np.uint8), 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            if low[f] <= -1 and high[f] >= 1:
                continue
            order = self.orders[f]
            listed = self.x[order, f] / self.scale[order]
            begin, end = np.searchsorted(listed, low[f], "left"), np.searchsorted(listed, high[f], "right")
            if end - begin == self.n:
                continue
            count[order[begin:end]] += 1
            asked += 1
        if not asked:
            return None
        found = np.nonzero(count == asked)[0]
        return found if len(found) <= SPARSE * self.n else None


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= edge)[0]
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))[:k]


def _searcher(same: bool, k: int):
    """A cell: what each anchor of a chunk finds in one bucket.

    Anchors bring ``floor`` (least score worth returning, null for none) and, for negatives,
    ``bands``: (key, low, high) of the scores that each of its positives allows.
    """

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        hits: dict = {c: [] for c in ("anchor", "band", "id", "score")}
        if left.num_rows and right.num_rows:
            bucket = _Bucket(left)
            anchors, ids, lengths = (_number(right, c) for c in ("anchor", "id", "length"))
            labels = _column(right, "label").to_pylist()
            x = np.stack([np.frombuffer(v, "<i8") for v in _column(right, "vector").to_pylist()])
            floors = _column(right, "floor").to_pylist()
            bands = _column(right, "bands").to_pylist()
            whole, narrowed = [], []
            for i in range(len(x)):
                at = None if floors[i] is None else bucket.candidates(x[i], lengths[i], floors[i])
                whole.append(i) if at is None else narrowed.append((i, at))

            def take(i: int, at: np.ndarray | None, scores: np.ndarray) -> None:
                own, tags = (bucket.ids, bucket.labels) if at is None else (bucket.ids[at], bucket.labels[at])
                alike = tags == labels[i]
                good = (alike if same else ~alike) & (own != ids[i])
                if floors[i] is not None:
                    good &= scores >= floors[i]
                good = np.nonzero(good)[0]
                own, scores = own[good], scores[good]
                for key, low, high in ((b["key"], b["low"], b["high"]) for b in bands[i]):
                    inside = slice(None) if low is None else np.nonzero((scores >= low) & (scores <= high))[0]
                    some, their = scores[inside], own[inside]
                    best = _first(some, their, k)
                    hits["anchor"].append(np.full(len(best), anchors[i]))
                    hits["band"].append(np.full(len(best), key))
                    hits["id"].append(their[best])
                    hits["score"].append(some[best])

            for begin in range(0, len(whole), 128):
                part = whole[begin:begin + 128]
                for i, scores in zip(part, products(x[part], bucket.x)):
                    take(i, None, scores)
            for i, at in narrowed:
                if len(at):
                    take(i, at, products(x[i:i + 1], bucket.x[at])[0])
        joined = {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in hits.items()}
        return pa.table({c: pa.array(v.astype(np.int64)) for c, v in joined.items()}, schema=_schema(_HIT))

    return search


class _Miner:
    def __init__(self, scratch: Scratch, buckets: DataFrame, anchors: DataFrame):
        self.scratch, self.buckets, self.anchors = scratch, buckets, anchors
        found = buckets.groupBy("class").agg(F.max("longest").alias("longest")).collect()
        # at most MAX_CLASSES numbers; a class may be empty, so bounds run over what follows it
        self.classes = sorted((r["class"], r["longest"]) for r in found)

    def _cells(self, state: DataFrame, reach: bool) -> DataFrame:
        """(chunk, class): the class of the longest vectors, or all others that may reach a floor."""
        numbers = np.array([c for c, _ in self.classes])
        longest = np.array([v for _, v in self.classes])
        # longest vector of a class or any shorter one, so that the bound falls along the classes
        falling = np.maximum.accumulate(longest[::-1])[::-1]
        if not reach:
            return state.select("chunk", F.lit(int(numbers[0])).alias("class")).distinct()
        chunks = state.groupBy("chunk").agg(F.min(
            F.when(F.col("floor") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(0.0))).alias("need"))

        @F.pandas_udf("array<int>")
        def reached(need):
            import pandas as pd
            ends = np.searchsorted(-falling * (1 + SLACK), -need.to_numpy(), "right")
            return pd.Series([numbers[1:e].astype(np.int32) for e in ends], index=need.index, dtype=object)

        return chunks.select("chunk", F.explode(reached(F.coalesce("need", F.lit(0.0)))).alias("class"))

    def _search(self, state: DataFrame, cells: DataFrame, same: bool, k: int) -> DataFrame:
        """The best ``k`` of each (anchor, band) over some cells."""
        cells = self.scratch.save(cells)
        left = self.buckets.join(cells, "class")
        places = self.buckets.select("class", "bucket").join(cells, "class").select(
            "chunk", F.col("bucket").alias("met"))
        # an alias of its own for each key: both sides come from the same tables
        right = state.join(places, "chunk").withColumn("asking", F.col("chunk") + F.lit(0))
        return left.groupBy("bucket", "chunk").cogroup(right.groupBy("met", "asking")).applyInArrow(
            _searcher(same, k), _HIT)

    @staticmethod
    def _best(hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def find(self, state: DataFrame, same: bool, k: int, floors) -> DataFrame:
        """(anchor, band, id, score, rank). ``floors`` makes each anchor's bound from a first list."""
        first = self.scratch.save(self._best(self._search(state, self._cells(state, False), same, k), k))
        bounded = self.scratch.save(floors(state, first))
        rest = self._search(bounded, self._cells(bounded, True), same, k)
        return self.scratch.save(self._best(first.drop("rank").unionByName(rest), k))


def _positive_floor(k: int):
    def floors(state: DataFrame, first: DataFrame) -> DataFrame:
        last = first.where(F.col("rank") == k).select("anchor", F.col("score").alias("_floor"))
        return state.drop("floor").join(last, "anchor", "left").withColumnRenamed("_floor", "floor")

    return floors


def _negative_floor(k: int):
    def floors(state: DataFrame, first: DataFrame) -> DataFrame:
        """A band that is full asks for its last score, any other for its foot; the least counts."""
        last = first.where(F.col("rank") == k).select("anchor", F.col("band").alias("key"), "score")
        need = state.select("anchor", F.explode("bands").alias("b")).select(
            "anchor", "b.key", "b.low").join(last, ["anchor", "key"], "left").groupBy("anchor").agg(
            F.min(F.coalesce("score", "low")).alias("_floor"))
        return state.drop("floor").join(need, "anchor", "left").withColumnRenamed("_floor", "floor")

    return floors


def _band_edge(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a score, rounded up or down to a whole number, without overflow."""
    exact = score.cast("decimal(20,0)") * F.lit(percent)
    rest = F.pmod(exact, F.lit(100))
    whole = ((exact - rest) / F.lit(100)).cast("bigint")
    return whole + F.when(rest > 0, F.lit(1)).otherwise(F.lit(0)) if up else whole


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Of each anchor's first ``positives`` rows with its label, every one is paired with the first
    ``negatives`` rows of other labels that score between ``low`` and ``high`` percent of it.
    ``is_anchor`` is a condition on the key column named ``vec_id``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"),
                     F.col(f"`{label}`").cast("string").alias("label"),
                     F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return spark.createDataFrame([], _RESULT)
    whole = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))))
    rows = scratch.save(rows.where(F.size("v") == usual["size"]).select(
        F.col("vec_id").alias("id"), "label", whole.alias("vector"), is_anchor.alias("asks")).distinct())

    fitting = max(64, _COMPONENTS // usual["size"])
    bucket_rows, chunk_rows = min(BUCKET_ROWS, fitting), min(CHUNK_ROWS, fitting)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    parts = max(1, -(-sizes["n"] // bucket_rows))
    length = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # hashed ids keep vectors of one length from falling into one range
    ranged = rows.select("id", "label", "vector", length.alias("length")).repartitionByRange(
        parts, F.desc("length"), F.xxhash64("id", "vector"))
    buckets = scratch.save(ranged.drop("length").mapInArrow(
        _packer(bucket_rows, -(-parts // MAX_CLASSES)), _BUCKET))
    asking = rows.where("asks").select("id", "label", "vector").repartition(
        max(1, -(-sizes["asked"] // chunk_rows)))
    anchors = scratch.save(asking.mapInArrow(_anchor_packer(chunk_rows), _ANCHOR))
    miner = _Miner(scratch, buckets, anchors)

    bands = "array<struct<key:bigint,low:bigint,high:bigint>>"
    everywhere = F.array(F.struct(F.lit(0).alias("key"), F.lit(None).alias("low"), F.lit(None).alias("high")))
    state = anchors.withColumns({"floor": F.lit(None).cast("bigint"), "bands": everywhere.cast(bands)})
    good = miner.find(state, True, positives, _positive_floor(positives)).select(
        "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    band = F.struct(F.col("positive_score").alias("key"), _band_edge(F.col("positive_score"), low, True).alias("low"),
                    _band_edge(F.col("positive_score"), high, False).alias("high"))
    open_bands = good.select("anchor", band.alias("b")).where("b.low <= b.high").groupBy("anchor").agg(
        F.sort_array(F.collect_set("b")).cast(bands).alias("bands"))
    state = scratch.save(anchors.join(open_bands, "anchor").withColumn(
        "floor", F.array_min(F.col("bands.low"))))
    bad = miner.find(state, False, negatives, _negative_floor(negatives)).select(
        "anchor", F.col("band").alias("positive_score"), F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    out = good.join(bad, ["anchor", "positive_score"]).join(
        anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
