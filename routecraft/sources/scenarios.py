"""Scenario inputs: literal tables, the sample frame and scenarios derived from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCENARIO_SCHEMA

# ---------------------------------------------------------------------------
# The five sample scenarios (name, capacity A, capacity B,
# demand 1, demand 2, cost A->1, A->2, B->1, B->2) and the four batch scenarios
# of the SQL example, in the modelled application's order.
# ---------------------------------------------------------------------------
SAMPLE_SCENARIOS = [
    ("base_case", 100, 80, 70, 60, 5.0, 8.0, 6.0, 4.0),
    ("peak_season", 100, 80, 90, 80, 5.0, 8.0, 6.0, 4.0),
    ("fuel_cost_spike", 100, 80, 70, 60, 7.0, 10.0, 8.0, 6.0),
    ("reduced_capacity", 60, 50, 70, 60, 5.0, 8.0, 6.0, 4.0),
    ("impossible_demand", 50, 40, 70, 60, 5.0, 8.0, 6.0, 4.0),
]
BATCH_SCENARIOS_SQL = """
SELECT * FROM VALUES
    ('peak_season', 100, 80, 90, 80, 5, 8, 6, 4),
    ('off_season', 100, 80, 50, 40, 5, 8, 6, 4),
    ('fuel_price_hike', 100, 80, 70, 60, 7, 10, 8, 6),
    ('new_warehouse', 150, 80, 70, 60, 4, 7, 6, 4)
AS t(scenario_name, warehouse_a_capacity, warehouse_b_capacity,
     customer_1_demand, customer_2_demand, cost_a_to_1, cost_a_to_2,
     cost_b_to_1, cost_b_to_2)
"""

# Customers kept for two-customer (wide) scenarios over the test tables.
FACT_WIDE_CUSTOMERS = ("Customer_AUTOMOBILE", "Customer_BUILDING")
DEMAND_DIVISOR = 20


def sample_scenarios(spark: SparkSession) -> DataFrame:
    """The five sample scenarios (two infeasible by design)."""
    return spark.createDataFrame(SAMPLE_SCENARIOS, SCENARIO_SCHEMA)


def batch_scenarios(spark: SparkSession, table_name: str | None = "transportation_scenarios") -> DataFrame:
    """The batch scenario table created from a ``VALUES ... AS t(cols)`` relation;
    registered as a temp view when ``table_name`` is given."""
    df = spark.sql(BATCH_SCENARIOS_SQL)
    if table_name:
        df.createOrReplaceTempView(table_name)
    return df


# The functions below read a count table: any frame with warehouse, customer,
# (lane_warehouse) and ``n`` = number of observations, e.g. ``route_partials``
# of the facts, or the facts themselves with ``n = 1``.

def warehouse_capacities(counts: DataFrame) -> DataFrame:
    """Capacity of each warehouse = its number of observations."""
    return counts.groupBy("warehouse").agg(F.sum("n").cast("bigint").alias("capacity"))


def customer_demands(counts: DataFrame, divisor: int = DEMAND_DIVISOR) -> DataFrame:
    """Demand of each customer = floor(observations / divisor)."""
    return counts.groupBy("customer").agg(
        F.floor(F.sum("n") / F.lit(divisor)).cast("bigint").alias("demand"))


def warehouse_pairs(counts: DataFrame) -> DataFrame:
    """Pairs (warehouse_a < warehouse_b) of warehouses joined by a trade lane.

    A lane exists when a warehouse ships to a customer located in the nation
    of another warehouse. Derived by a distinct aggregate over the facts, so no
    pairs are enumerated by a cross product.
    """
    w, lane = F.col("warehouse"), F.col("lane_warehouse")
    return (counts.where(w != lane)
            .select(F.least(w, lane).alias("warehouse_a"), F.greatest(w, lane).alias("warehouse_b"))
            .distinct())


def fact_pair_scenarios(counts: DataFrame) -> DataFrame:
    """One scenario per lane pair with both ends' capacities.

    Both ends must be warehouses (inner joins on the capacity table, which has
    one row per warehouse).
    """
    caps = warehouse_capacities(counts)
    cap_a = caps.select(F.col("warehouse").alias("warehouse_a"), F.col("capacity").alias("warehouse_a_capacity"))
    cap_b = caps.select(F.col("warehouse").alias("warehouse_b"), F.col("capacity").alias("warehouse_b_capacity"))
    return (warehouse_pairs(counts).join(cap_a, "warehouse_a").join(cap_b, "warehouse_b")
            .select(F.concat_ws("_vs_", "warehouse_a", "warehouse_b").alias("scenario_name"),
                    "warehouse_a", "warehouse_b", "warehouse_a_capacity", "warehouse_b_capacity"))


def fact_wide_scenarios(counts: DataFrame, customers=FACT_WIDE_CUSTOMERS,
                        divisor: int = DEMAND_DIVISOR) -> DataFrame:
    """Two-customer scenarios: lane pairs x the demands of two customers.

    The demands are global one-row aggregates attached as scalar subqueries
    (evaluated once, merged into a single subquery), not by a join.
    """
    c1, c2 = customers
    totals = counts.agg(
        F.sum(F.when(F.col("customer") == c1, F.col("n")).otherwise(F.lit(0))).alias("n1"),
        F.sum(F.when(F.col("customer") == c2, F.col("n")).otherwise(F.lit(0))).alias("n2"))
    d1 = totals.select(F.floor(F.col("n1") / F.lit(divisor)).cast("bigint")).scalar()
    d2 = totals.select(F.floor(F.col("n2") / F.lit(divisor)).cast("bigint")).scalar()
    return fact_pair_scenarios(counts).select(
        "*", d1.alias("customer_1_demand"), d2.alias("customer_2_demand"))
