"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

If rows are dealt uniformly at random into shards of fixed sizes, then how many rows of each
input part go to each shard follows a multivariate hypergeometric law. So the driver draws
this matrix of counts (parts by shards) first; every part then deals its own rows in random
order by these counts, without seeing any other part; one exchange moves the rows, and each
shard permutes what it got. The result is a uniform permutation with exact shard sizes, and
no row is moved twice.

Parts are the files of a stored copy of the input, at most ``MAX_PARTS`` of them, so the
matrix that goes to the tasks has a proven bound (4 MB for eight shards). A row is known by its
file and its place in it, so that a repeated task deals it the same way; keys and contents of
rows do not matter, and hot ones cannot skew anything.

Inside a shard rows carry a random key. Its leading part splits large shards into blocks that
are sorted by different tasks; a row's slot is the number of rows in earlier blocks plus its
place in its own.

Defined cases: every row is dealt, repeats and nulls included; an empty table gives an empty
result; with fewer rows than shards some shards stay empty; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quietgrove.llm.common import replacing
from quietgrove.scratch import Scratch

MAX_PARTS = 1 << 16
BLOCK_ROWS = 1 << 18


def shard_sizes(n_rows: int, n_shards: int) -> np.ndarray:
    """Row counts of the shards, at most one apart."""
    return np.array([n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)],
                    dtype=np.int64)


def communication_matrix(part_rows: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Rows of each part (rows of the matrix) that go to each shard (columns).

    Part after part draws from what the shards can still take, without replacement.
    """
    rng = np.random.default_rng([seed, 0])
    left = sizes.astype(np.int64).copy()
    out = np.zeros((len(part_rows), len(sizes)), dtype=np.int64)
    for i, n in enumerate(part_rows):
        out[i] = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= out[i]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int = 8, seed: int = 11,
                        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0)."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    names = [f"c{i}" for i in range(len(df.columns))]
    source = df.toDF(*names)
    if not df.columns:
        raise ValueError("a table without columns cannot be dealt")
    stored = scratch.save(source.coalesce(MAX_PARTS))
    placed = stored.select(*names, F.col("_metadata.file_name").alias("__file"),
                           F.col("_metadata.row_index").alias("__row"))
    parts = sorted((r["__file"], r["n"]) for r in
                   placed.groupBy("__file").agg(F.count("*").alias("n")).collect())
    counts = np.array([n for _, n in parts], dtype=np.int64)
    index = {name: i for i, (name, _) in enumerate(parts)}
    total = int(counts.sum())
    matrix = communication_matrix(counts, shard_sizes(total, n_shards), seed)
    shared = spark.sparkContext.broadcast((index, matrix))

    @F.pandas_udf("shard int, key long")
    def deal(files: pd.Series, rows: pd.Series) -> pd.DataFrame:
        where, table = shared.value
        shard = np.empty(len(files), dtype=np.int32)
        key = np.empty(len(files), dtype=np.int64)
        for name, at in files.groupby(files.to_numpy()).indices.items():
            labels, keys = _dealt(seed, where[name], table[where[name]])
            places = rows.to_numpy()[at]
            shard[at], key[at] = labels[places], keys[places]
        return pd.DataFrame({"shard": shard, "key": key})

    blocks = max(1, -(-total // (n_shards * block_rows)))
    dealt = placed.withColumn("__to", deal("__file", "__row")).select(
        *names, "__file", "__row", F.col("__to.shard").alias("__shard"),
        F.col("__to.key").alias("__key"),
        F.floor(F.col("__to.key") / (2.0 ** 62 / blocks)).cast("int").alias("__block"))
    sizes = dealt.groupBy("__shard", "__block").agg(F.count("*").alias("n")).collect()
    before, offset = {}, {s: 0 for s in range(n_shards)}
    for r in sorted(sizes, key=lambda r: (r["__shard"], r["__block"])):
        before[(r["__shard"], r["__block"])] = offset[r["__shard"]]
        offset[r["__shard"]] += r["n"]
    starts = spark.createDataFrame([(s, b, n) for (s, b), n in before.items()],
                                   "__shard int, __block int, __before long")
    local = Window.partitionBy("__shard", "__block").orderBy("__key", "__file", "__row")
    ranked = dealt.withColumn("__n", F.row_number().over(local))
    out = ranked.join(F.broadcast(starts), ["__shard", "__block"])
    slot = (F.col("__before") + F.col("__n") - 1).cast("bigint")
    whole = out.select(*[F.col(c).alias(o) for c, o in zip(names, df.columns)],
                       F.col("__shard"), slot.alias("__slot"))
    return replacing(whole, {"shard": F.col("__shard"), "slot": F.col("__slot")}, keep=df.columns)


_last: tuple = (None, None)


def _dealt(seed: int, part: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shard and random key of each place of a part; the last part is remembered."""
    global _last
    if _last[0] != (seed, part, row.tobytes()):
        rng = np.random.default_rng([seed, 1, part])
        labels = np.repeat(np.arange(len(row), dtype=np.int16), row)
        rng.shuffle(labels)
        _last = ((seed, part, row.tobytes()), (labels, rng.integers(0, 1 << 62, len(labels))))
    return _last[1]
