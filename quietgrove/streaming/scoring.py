"""Scoring a stream. A model's scores are stateless column arithmetic, so a stream needs no
watermark and no state store; exactly-once output is up to the sink and its checkpoint."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quietgrove.plans.model import BoostedModel
from quietgrove.scratch import checkpoint_root


def score_stream(model: BoostedModel, stream: DataFrame, output: str = "raw") -> DataFrame:
    """Add a prediction (``raw``), a ``label`` or a ``probability`` to a streaming table."""
    steps = {"raw": model.transform, "label": model.predict_label,
             "probability": model.predict_proba}
    return steps[output](stream)


def write_scores(scored: DataFrame, path: str, name: str, format: str = "parquet",
                 trigger: Optional[dict] = None) -> StreamingQuery:
    """Append scored rows to files; progress is kept below the shared checkpoint folder."""
    spark = scored.sparkSession
    writer = (scored.writeStream.format(format).outputMode("append")
              .option("checkpointLocation", f"{checkpoint_root(spark)}/stream-{name}")
              .option("path", path))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
