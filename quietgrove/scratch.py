"""Shared scratch tables used to cut lineage.

Tables are written below ``spark.checkpoint.dir``, so that they outlive any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for local sessions."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quietgrove-"))
    return sc.getCheckpointDir()


#: Folders of this process that may still hold tables.
_kept: set[str] = set()


def delete_all(spark: SparkSession) -> int:
    """Delete the intermediate tables that results handed out so far are read from; returns how many
    folders these were. For the end of a job, when none of its results is read any more."""
    folders = sorted(_kept)
    for folder in folders:
        _delete(spark, folder)
    return len(folders)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _kept.discard(folder)


class Scratch:
    """A folder of intermediate tables, deleted on exit or, if results are read from it, by
    ``delete_all``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_root(spark).rstrip('/')}/quietgrove-{uuid.uuid4().hex}"
        _kept.add(self.path)
        self._n = 0
        self._stored: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, partition_by: Sequence[str] = (), spread: bool = False
             ) -> DataFrame:
        """Write ``df`` and return the stored table (same columns, same order).

        ``spread`` is for tables that are scanned many times: one that came out in fewer
        files than there are cores (so it is small) is written again with a file per core.
        """
        stored = self._write(df, partition_by)
        cores = self.spark.sparkContext.defaultParallelism
        if spread and len(stored.inputFiles()) < cores:
            small, stored = stored, self._write(stored.repartition(cores), partition_by)
            self.release(small)
        return stored

    def release(self, stored: DataFrame) -> None:
        """Delete a stored table that nothing reads any more."""
        for i, (df, path) in enumerate(self._stored):
            if df is stored:
                del self._stored[i]
                _delete(self.spark, path)
                return

    def _write(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        self._n += 1
        path = f"{self.path}/t{self._n}"
        writer = df.write.mode("error")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        self._stored.append((stored, path))
        return stored

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_):
        _delete(self.spark, self.path)


def materialize(df: DataFrame, partition_by: Optional[Sequence[str]] = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that are handed to the caller: the table stays until ``delete_all``.
    """
    return Scratch(df.sparkSession).save(df, partition_by or ())
