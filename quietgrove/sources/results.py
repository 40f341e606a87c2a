"""Result tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Result columns as other tools expect them.
SWEEP_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("nb_samples", T.LongType()),
    T.StructField("nb_trees", T.IntegerType()), T.StructField("use_dp", T.BooleanType()),
    T.StructField("privacy_budget", T.DoubleType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("glc", T.BooleanType()),
    T.StructField("gdf", T.BooleanType())])
#: The same with the configuration's name in front, as ``sweep`` returns it.
NAMED_SWEEP_SCHEMA = T.StructType([T.StructField("config", T.StringType()), *SWEEP_SCHEMA])


def write_results(df: DataFrame, path: str, format: str = "csv", mode: str = "error") -> None:
    """Write one file per partition; CSV gets a header."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(format).save(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType = SWEEP_SCHEMA,
                 format: str = "csv") -> DataFrame:
    """Read results back. Rows with fewer fields than the header (some tools drop trailing
    ones) get nulls; a header with other names than the schema's is refused. Sweep results may
    have their configuration in front."""
    if format == "csv":
        header = spark.read.option("header", False).csv(path).first()
        found = [v for v in (header or []) if v is not None]
        if schema is SWEEP_SCHEMA and found[:1] == ["config"]:
            schema = NAMED_SWEEP_SCHEMA
        if found and found[:len(schema)] != schema.names[:len(found)]:
            raise ValueError(f"columns {found}, expected {schema.names}")
        return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return spark.read.schema(schema).format(format).load(path)
