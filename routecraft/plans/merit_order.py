"""Many warehouses, one customer: merit-order fill.

For a single customer the cheapest plan takes warehouses in ascending
(unit cost, warehouse) order, each shipping min(capacity, remaining demand).
Solved for every customer at once; the running capacity before each
warehouse comes from the skew-safe ``running_total``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_total


def plan_mx1(offers: DataFrame, group_col: str = "customer", skew_safe: bool = True) -> DataFrame:
    """``offers``: one row per (customer, warehouse) with ``cost_per_unit``,
    ``capacity`` and the customer's ``demand`` (repeated per row).
    Returns the rows with ``shipment`` and the customer's ``feasible`` flag."""
    g = group_col
    base = offers.select(g, "warehouse", F.col("cost_per_unit").cast("double").alias("cost_per_unit"),
                         F.greatest(F.col("capacity").cast("double"), F.lit(0.0)).alias("capacity"),
                         F.greatest(F.col("demand").cast("double"), F.lit(0.0)).alias("demand"))
    ordered = running_total(base, [g], ["cost_per_unit", "warehouse"], "capacity", "_before",
                            totals={"_supply": ("sum", F.col("capacity")), "_demand": ("max", F.col("demand"))},
                            skew_safe=skew_safe)
    feasible = F.col("_supply") >= F.col("_demand")
    ship = F.greatest(F.lit(0.0), F.least(F.col("capacity"), F.col("demand") - F.col("_before")))
    return ordered.select(g, "warehouse", "cost_per_unit", "capacity", "demand", feasible.alias("feasible"),
                          F.when(feasible, ship).otherwise(F.lit(0.0)).alias("shipment"))
