"""Documents to packed token sequences: language, quality, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept.
The first three return rows of ``docs`` with its columns; the last returns pieces of sequences.
Stages are written as Parquet and read again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.llm import jaccard_join, language_id, packing, quality_rules
from quietgrove.llm.common import free_name
from quietgrove.scratch import Scratch

#: A text is of no learned language if a draw of n-grams at random explains it better than its
#: best one does: its mean evidence per n-gram (nats) is below this by more than twice the
#: standard error of such a mean. Short texts are so given the benefit of the doubt.
MIN_EVIDENCE = 0.0
#: Standard deviation of the evidence of single n-grams.
EVIDENCE_SPREAD = 4.0


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts that no learned language explains."""
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    row = free_name(docs, "row")
    found = model.predict(docs.select(F.struct("*").alias(row), "text"), evidence=True)
    doubt = 2 * EVIDENCE_SPREAD / F.sqrt(F.greatest("n_grams", F.lit(1)))
    good = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("evidence") >= MIN_EVIDENCE - doubt)
    return found.where(good).select(*[F.col(row)[c].alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject what any of the quality rules rejects."""
    rules = quality_rules.ordered(quality_rules.estimate(docs))
    by = free_name(docs, "rejected_by")
    found = docs.withColumn(by, quality_rules.cascade(F.col("text"), rules))
    return found.where(F.col(by).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts exactly one row stays: the first by doc_id (nulls last).

    Ids never decide whether different texts stay. A text without words is linked with nothing,
    so every such row stays.
    """
    scratch = Scratch(spark)
    row = free_name(docs, "row")
    groups = scratch.save(jaccard_join.grouped_rows(docs))
    stay = scratch.save(groups.where(F.col("row") == F.col("head.row")).groupBy("row").agg(
        F.count("*").alias("copies")).withColumnRenamed("row", row))
    few = stay.count() <= jaccard_join.BROADCAST_IDS
    keyed = docs.withColumn(row, jaccard_join.row_key())
    # the rule of shingle_set for a text that has words
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def among(rows: DataFrame, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
        return rows.join(F.broadcast(wanted.select(row)) if few else wanted.select(row), row, how)

    kept = among(keyed.where(worded), stay)
    repeated = stay.where("copies > 1")
    if repeated.limit(1).count():
        # rows of equal id and text
        kept = among(kept, repeated, "left_anti").unionByName(
            among(kept, repeated).dropDuplicates([row]))
    if groups.where("size = 0").limit(1).count():
        kept = kept.unionByName(keyed.where(~worded))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_near_duplicates),
    ("packing", pack),
]

#: No stage after the second can be told in SQL: tests compare with a plain version instead.
ORACLE_SQL: Optional[str] = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
