"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of what separates words: space, tab, line feed, vertical tab, form feed, return.
WORD_GAPS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that go to Python at a time; with whole texts in them, the default of 10,000 is too many.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS, if it is higher or unlimited.

    The setting is read when a query runs, so it stays lowered.
    """
    now = int(spark.conf.get(_BATCH_SETTING, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


#: What drops the tables that an operator keeps in a Python process, by operator.
_drops: dict[str, Callable[[], None]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Say how the tables that ``operator`` keeps in a process are dropped."""
    _drops[operator] = drop


def give_back() -> None:
    """Give spare memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def begin_task(operator: str) -> None:
    """For the start of a task: a process lives on into stages of other operators, so it drops what
    any other one keeps."""
    for other, drop in _drops.items():
        if other != operator:
            drop()
    give_back()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS), lambda w: w != "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def replacing(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None
              ) -> DataFrame:
    """``df`` with result columns at the end; a column of the same name gives way."""
    new = {c.lower() for c in columns}
    old = [c for c in (keep if keep is not None else df.columns) if c.lower() not in new]
    return df.select(*[df[f"`{c}`"] for c in old], *[v.alias(k) for k, v in columns.items()])
