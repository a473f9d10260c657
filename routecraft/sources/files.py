"""File formats: route costs as CSV, constraint documents as JSON, and the
versioned feature store as partitioned Parquet.

Files are exports and imports at the edge; stages inside the engine hand
DataFrames to each other directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CONSTRAINTS_SCHEMA, FEATURE_SCHEMA, FEATURE_VIEW_NAME, FEATURE_VIEW_VERSION, ROUTE_COST_SCHEMA


def write_route_costs_csv(route_costs: DataFrame, path: str) -> None:
    """Long route costs (warehouse, customer, cost_per_unit) as CSV with header."""
    route_costs.select("warehouse", "customer", "cost_per_unit").write.mode("overwrite") \
        .option("header", True).csv(path)


def read_route_costs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read long route costs with an explicit schema (no inference pass)."""
    return spark.read.schema(ROUTE_COST_SCHEMA).option("header", True).csv(path)


def write_constraints_json(capacities: DataFrame, demands: DataFrame, path: str) -> None:
    """Constraint documents {warehouses: {name: {capacity}}, customers: {name: {demand}}},
    one line for each party, written by as many tasks as hold the rows."""
    limit = lambda name, value, text: F.create_map(F.col(name), F.struct(
        F.col(value).cast("double").alias(value), F.concat(F.lit(text), F.col(name)).alias("description")))
    capacities.select(limit("warehouse", "capacity", "Shipping limit of ").alias("warehouses")).write.mode("overwrite").json(path)
    demands.select(limit("customer", "demand", "Units owed to ").alias("customers")).write.mode("append").json(path)


def read_constraints_json(spark: SparkSession, path: str, pretty: bool = False) -> tuple[DataFrame, DataFrame]:
    """Capacities (warehouse, capacity) and demands (customer, demand) from
    constraint documents: one per line, or one pretty-printed document per file
    (``pretty``)."""
    doc = spark.read.schema(CONSTRAINTS_SCHEMA).option("multiLine", pretty).json(path)
    caps = doc.select(F.explode("warehouses").alias("warehouse", "v")).select(
        "warehouse", F.col("v.capacity").alias("capacity"))
    dems = doc.select(F.explode("customers").alias("customer", "v")).select(
        "customer", F.col("v.demand").alias("demand"))
    return caps, dems


def view_name(name: str = FEATURE_VIEW_NAME, version: str = FEATURE_VIEW_VERSION) -> str:
    return f"{name}_v{version.replace('.', '_')}"


def publish_features(features: DataFrame, base_path: str, name: str = FEATURE_VIEW_NAME,
                     version: str = FEATURE_VIEW_VERSION) -> str:
    """Publish a feature table under (name, version): Parquet partitioned by
    ``version`` with dynamic partition overwrite (other versions stay), plus a
    temp view ``<name>_v<version>`` over the published partition."""
    spark = features.sparkSession
    features.withColumn("version", F.lit(version)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic") \
        .partitionBy("version").parquet(f"{base_path}/{name}")
    view = view_name(name, version)
    read_features(spark, base_path, name, version).createOrReplaceTempView(view)
    return view


def read_features(spark: SparkSession, base_path: str, name: str = FEATURE_VIEW_NAME,
                  version: str = FEATURE_VIEW_VERSION) -> DataFrame:
    """Read one published version (the version filter prunes partitions).
    The schema is given so ``version`` stays text ("1.10" is not 1.1)."""
    schema = T.StructType(FEATURE_SCHEMA.fields + [T.StructField("version", T.StringType())])
    return spark.read.schema(schema).parquet(f"{base_path}/{name}").where(F.col("version") == version)
