"""The transport fact table: seed rows, DDL and the mapping onto the test tables.

The fact table has one row per observed shipment on a route
(warehouse, customer), schema ``schemas.FACT_SCHEMA``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import FACT_SCHEMA, ROUTE_KEYS
from .tables import table

# ---------------------------------------------------------------------------
# The sixteen seed observations (four per route) of the modelled
# application, columns
#   warehouse, customer, distance_km, fuel_price_per_liter, vehicle_capacity_tons,
#   base_rate_per_km, travel_time_hours, road_condition_factor, seasonal_factor,
#   priority_multiplier
# ---------------------------------------------------------------------------
SEED_ROWS = [
    ("Warehouse_A", "Customer_1", 45, 1.25, 10, 0.8, 0.9, 1.0, 1.0, 1.0),
    ("Warehouse_A", "Customer_2", 72, 1.25, 10, 0.8, 1.4, 1.1, 1.0, 1.0),
    ("Warehouse_B", "Customer_1", 68, 1.30, 8, 0.85, 1.3, 1.2, 1.0, 1.0),
    ("Warehouse_B", "Customer_2", 38, 1.30, 8, 0.85, 0.8, 1.0, 1.0, 1.0),
    ("Warehouse_A", "Customer_1", 45, 1.35, 10, 0.8, 0.9, 1.0, 1.1, 1.2),
    ("Warehouse_A", "Customer_2", 72, 1.35, 10, 0.8, 1.4, 1.1, 1.1, 1.0),
    ("Warehouse_B", "Customer_1", 68, 1.40, 8, 0.85, 1.3, 1.2, 1.1, 1.0),
    ("Warehouse_B", "Customer_2", 38, 1.40, 8, 0.85, 0.8, 1.0, 1.1, 1.0),
    ("Warehouse_A", "Customer_1", 45, 1.20, 12, 0.75, 0.8, 0.9, 0.9, 1.0),
    ("Warehouse_A", "Customer_2", 72, 1.20, 12, 0.75, 1.2, 0.9, 0.9, 1.0),
    ("Warehouse_B", "Customer_1", 68, 1.25, 10, 0.80, 1.1, 1.0, 0.9, 1.0),
    ("Warehouse_B", "Customer_2", 38, 1.25, 10, 0.80, 0.7, 0.9, 0.9, 1.0),
    ("Warehouse_A", "Customer_1", 45, 1.28, 10, 0.8, 1.0, 1.1, 1.05, 1.1),
    ("Warehouse_A", "Customer_2", 72, 1.28, 10, 0.8, 1.5, 1.2, 1.05, 1.0),
    ("Warehouse_B", "Customer_1", 68, 1.32, 8, 0.85, 1.4, 1.3, 1.05, 1.0),
    ("Warehouse_B", "Customer_2", 38, 1.32, 8, 0.85, 0.9, 1.1, 1.05, 1.0),
]


def seed_facts(spark: SparkSession, observed_at: _dt.datetime | None = None) -> DataFrame:
    """The sixteen seed observations, all stamped with one instant."""
    ts = observed_at or _dt.datetime(2024, 1, 15, 12, 0, 0)
    rows = [(w, c, *[float(v) for v in vals], ts) for (w, c, *vals) in SEED_ROWS]
    return spark.createDataFrame(rows, FACT_SCHEMA)


def create_fact_table(df: DataFrame, path: str, partition_by_day: bool = True) -> None:
    """Create-or-replace the fact table as Parquet.

    Partitioning by observation day lets the look-back filter prune whole
    folders instead of row groups.
    """
    rows = df.select(*[f.name for f in FACT_SCHEMA.fields])
    if partition_by_day:
        _by_day(rows).write.mode("overwrite").partitionBy("obs_day").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def _by_day(rows: DataFrame) -> DataFrame:
    """Rows in the order of time over all write tasks: a day has one or two files, and a
    hot day is cut by route over several tasks. The number of tasks is given, as adaptive
    execution would write the many small folders of a small table one after the other."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("obs_day", F.to_date("last_updated")).repartitionByRange(tasks, "last_updated", *ROUTE_KEYS)


def replace_days(df: DataFrame, path: str) -> None:
    """Write the days that ``df`` has anew; all other days of the table stay."""
    rows = df.select(*[f.name for f in FACT_SCHEMA.fields])
    _by_day(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("obs_day").parquet(path)


def read_fact_days(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The day-partitioned fact table; with ``first`` and ``last`` (dates or ISO text) only the
    folders of those days are opened."""
    schema = T.StructType([*FACT_SCHEMA.fields, T.StructField("obs_day", T.DateType())])
    rows = spark.read.schema(schema).parquet(path)
    if first is not None:
        rows = rows.where(F.col("obs_day") >= F.to_date(F.lit(str(first))))
    if last is not None:
        rows = rows.where(F.col("obs_day") <= F.to_date(F.lit(str(last))))
    return rows.drop("obs_day")


def _d(c: Column) -> Column:
    return c.cast("double")


def fact_from_tpch(spark: SparkSession, data_dir: str, with_lane: bool = False) -> DataFrame:
    """Map the TPC-H style tables onto the fact schema.

    warehouse = supplier nation, customer = market segment, one observation per
    line item on its order date. Orders are joined to customers first so that
    the line-item side is shuffled once (on the order key); the supplier side is
    left to adaptive execution, which broadcasts it only when its measured size
    allows.

    ``with_lane`` adds ``lane_warehouse``: the warehouse name of the customer's
    own nation, i.e. the other end of the trade lane (used to derive pairs of
    warehouses that trade with each other).
    """
    li = table(spark, data_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, data_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = table(spark, data_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supp = table(spark, data_dir, "supplier").select("s_suppkey", "s_nationkey")

    order_side = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = (li.join(order_side, li.l_orderkey == order_side.o_orderkey)
                .join(supp, li.l_suppkey == supp.s_suppkey))

    distance = (_d(F.lit(20) + F.lit(7) * F.abs(F.col("s_nationkey") - F.col("c_nationkey")))
                + _d(F.col("l_suppkey") % 13) / F.lit(7.0))
    extra = [warehouse_name(F.col("c_nationkey")).alias("lane_warehouse")] if with_lane else []
    return joined.select(
        warehouse_name(F.col("s_nationkey")).alias("warehouse"),
        F.concat(F.lit("Customer_"), F.col("c_mktsegment")).alias("customer"),
        distance.alias("distance_km"),
        (F.lit(1.2) + _d(F.col("l_partkey") % 21) / F.lit(97.0)).alias("fuel_price_per_liter"),
        _d(F.lit(8) + F.lit(2) * (F.col("l_linenumber") % 3)).alias("vehicle_capacity_tons"),
        (F.lit(0.75) + F.lit(0.05) * _d(F.col("s_nationkey") % 3)).alias("base_rate_per_km"),
        (distance / F.lit(53.0)).alias("travel_time_hours"),
        (F.lit(0.9) + F.lit(0.1) * _d(F.col("l_suppkey") % 5)).alias("road_condition_factor"),
        (F.lit(0.9) + _d(F.month("o_orderdate") % 5) / F.lit(19.0)).alias("seasonal_factor"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1.2))
         .when(F.col("o_orderpriority") == "2-HIGH", F.lit(1.1))
         .otherwise(F.lit(1.0)).alias("priority_multiplier"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("last_updated"),
        *extra,
    )


def warehouse_name(nation_key: Column) -> Column:
    """'Warehouse_' + two-digit nation key."""
    return F.concat(F.lit("Warehouse_"), F.lpad(nation_key.cast("string"), 2, "0"))

