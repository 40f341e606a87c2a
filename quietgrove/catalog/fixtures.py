"""Tables that the catalog's queries start from, each built from the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietgrove.sources.presets import COMPANY_FLAGS
from quietgrove.spec import feature_list

NUMERIC = ["c_acctbal", "c_nationkey"]
CATEGORICAL = ["o_orderstatus", "o_orderpriority", "c_mktsegment"]
MULTI_CATEGORICAL = ["o_orderpriority", "c_mktsegment"]
SECTORS = ("manufacturing", "technology", "energy", "hospitality", "professional_services",
           "other", "education", "financial_services", "retail", "healthcare")
CONFIGS = ("clip", "filter", "both")
BUDGETS = (0.5, 1.0, 5.0, 10.0)
SIZES = (300, 5000, 15000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reg(spark, d) -> DataFrame:
    """Orders with their customer; the target is the order price."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), *NUMERIC, *CATEGORICAL,
        F.col("o_totalprice").alias("y"))


def planted(spark, d) -> DataFrame:
    """The same features with a target that two of them explain."""
    y = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.6)).otherwise(F.lit(-0.2))
         + F.when(F.col("c_acctbal") < 2000, F.lit(0.3)).otherwise(F.lit(0.0))
         + (F.col("row_id") % 9 - 4) / F.lit(40.0))
    return reg(spark, d).withColumn("y", y)


def gradients(spark, d) -> DataFrame:
    """Features with a gradient whose sums are exact in any order (multiples of 1/64)."""
    g = F.floor(F.col("y") / 8000.0).cast("double") / 64.0 - 0.5
    shift = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0.25)).otherwise(F.lit(0.0)) \
        + F.when(F.col("c_acctbal") < 2000, F.lit(0.125)).otherwise(F.lit(0.0))
    node = F.when(F.col("c_nationkey") < 12, F.lit(1)).otherwise(F.lit(2)).cast("bigint")
    return reg(spark, d).withColumn("grad", g - shift).withColumn("node_id", node)


def binary(spark, d) -> DataFrame:
    """Labelled documents."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), "n_chars", "lang", "source",
        F.col("quality").cast("double").alias("y"))


def multi(spark, d) -> DataFrame:
    """Order status as a class from 0 to 2."""
    status = F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0)
    return reg(spark, d).withColumn("y", status.otherwise(2.0)).drop("o_orderstatus")


def missing(spark, d) -> DataFrame:
    """Orders whose priority is unknown now and then."""
    unknown = F.when(F.col("row_id") % 17 == 0, F.lit("?")).otherwise(F.col("o_orderpriority"))
    return reg(spark, d).withColumn("o_orderpriority", unknown)


def scored(spark, d) -> DataFrame:
    """Predictions of several configurations and budgets: price plus a fixed error."""
    config = F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.lit(c).alias("config"))
                                 for i, c in enumerate((*CONFIGS, "plain"))])).alias("cfg")
    rows = reg(spark, d).select("row_id", "y", config).select("row_id", "y", "cfg.*")
    budgets = F.when(F.col("config") == "plain", F.array(F.lit(0.0))).otherwise(
        F.array(*[F.lit(b) for b in BUDGETS]))
    rows = rows.withColumn("budget", F.explode(budgets))
    error = (F.col("row_id") % 11 - 5) * 100.0 * (F.col("ci") + 1) / (F.col("budget") + 1)
    size = F.element_at(F.array(*[F.lit(s) for s in SIZES]),
                        (F.floor(F.col("row_id") / 5) % 3 + 1).cast("int"))
    return rows.select(
        "row_id", F.lit("orders").alias("dataset"), size.alias("n"),
        (F.col("row_id") % 5).cast("int").alias("fold"), "config", "budget",
        F.when(F.floor(F.col("row_id") / 15) % 2 == 0, "loss").otherwise("cost").alias("label"),
        "y", (F.col("y") + error).alias("p"))


def company(spark, d) -> DataFrame:
    """Customers as companies, with flags from the digits of their key."""
    key = F.col("c_custkey")
    flags = [(F.floor(key / (i + 1)) % 2).cast("int").alias(f)
             for i, f in enumerate(COMPANY_FLAGS)]
    return table(spark, d, "customer").select(
        key.alias("row_id"),
        F.when(F.floor(key / 3) % 2 == 0, "small").otherwise("large").alias("company_size"),
        F.element_at(F.array(*[F.lit(s) for s in SECTORS]),
                     (key % len(SECTORS) + 1).cast("int")).alias("company_sector"), *flags)


def features(df: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL):
    return feature_list(df, numeric, categorical)


def wide(spark, d, columns: int = 90) -> DataFrame:
    """Many numeric features: entries of a vector and products of neighbouring ones."""
    e = table(spark, d, "embeddings")
    v = [F.col("embedding")[i].cast("double") for i in range(64)]
    parts = [*v, *[a * b for a, b in zip(v, v[1:])]][:columns]
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    *[p.alias(f"f_{i}") for i, p in enumerate(parts)])
