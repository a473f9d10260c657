"""Scenario preparation: default names by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_off


def with_position(df: DataFrame, order_cols: list[str], out_col: str = "_position") -> DataFrame:
    """0-based position of each row in ``order_cols`` order, computed without
    moving all rows to one task.

    Rows are range-partitioned (a sorted layout over many tasks), each slice
    numbers its rows, and the slice sizes (one row per slice) give the offsets.
    ``order_cols`` must be unique. The cut is made once and stored with the rows,
    so that numbers and offsets speak of the same slices.
    """
    ranged = hand_off(df.repartitionByRange(*order_cols).withColumn("_slice", F.spark_partition_id()), "positions")
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_slice").orderBy(*order_cols)) - 1)
    sizes = ranged.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    # offsets has one row per slice (bounded by the partition count)
    return (local.join(F.broadcast(offsets), "_slice")
            .withColumn(out_col, F.col("_offset") + F.col("_local"))
            .drop("_slice", "_local", "_offset"))


def default_scenario_names(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Fill missing ``scenario_name`` with ``scenario_<position>``; the column may be absent."""
    if "scenario_name" not in df.columns:
        df = df.withColumn("scenario_name", F.lit(None).cast("string"))
    positioned = with_position(df, order_cols)
    return positioned.withColumn(
        "scenario_name", F.coalesce(F.col("scenario_name"),
                                    F.concat(F.lit("scenario_"), F.col("_position").cast("string")))
    ).drop("_position")
