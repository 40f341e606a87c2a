"""From a file under a column-role spec to a trained model."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.functions import text
from quietgrove.operators.cleaning import minority_positive
from quietgrove.plans.boosting import PrivateBoostedTrees
from quietgrove.plans.model import BoostedModel
from quietgrove.scratch import materialize
from quietgrove.sources.tables import load_table
from quietgrove.spec import ModelParams, TableSpec


def training_rows(spark: SparkSession, path: str, spec: TableSpec, row_id: str = "row_id", **options) -> DataFrame:
    """Rows of a file that are ready to train: no missing marker, features in file order, and a
    numeric target. The two labels of a binary target become 0 and 1, the rarer one being 1.

    A file without an id column gets ``row_id``: the number of the row's task and its place in it.
    Ids are stored with the rows, so they stay; another reading may deal them differently.
    """
    rows = load_table(spark, path, spec, **options)
    if spec.task == "binary":
        # at most three labels are looked at
        labels = sorted(r[0] for r in rows.select(text.name(spec.target)).where(
            f"{text.name(spec.target)} IS NOT NULL").distinct().limit(3).collect())
        if len(labels) > 2:
            raise ValueError(f"{spec.name}: {spec.target} has more than two labels")
        code = F.when(F.col(text.name(spec.target)) == F.lit(labels[0] if labels else ""), F.lit(0.0)).when(
            F.col(text.name(spec.target)).isNotNull(), F.lit(1.0))
        rows = minority_positive(materialize(rows.withColumn(spec.target, code)), spec.target)
    if spec.row_id is None:
        rows = rows.withColumn(row_id, F.monotonically_increasing_id())
    return materialize(rows)


def train_file(spark: SparkSession, path: str, spec: TableSpec, params: ModelParams, row_id: str = "row_id",
               rows: Optional[DataFrame] = None, **options) -> tuple[BoostedModel, DataFrame]:
    """A model trained on a file, and the rows it was trained on."""
    rows = training_rows(spark, path, spec, row_id, **options) if rows is None else rows
    trainer = PrivateBoostedTrees(params, spec.numeric, spec.categorical, spec.target, spec.row_id or row_id,
                                  spec.features)
    return trainer.fit(rows), rows
