"""Batch optimisation in SQL: features view -> matrix -> scenarios -> function.

The whole flow is one ``spark.sql`` statement over published views. The one
-row feature matrix is read through scalar subqueries, which Catalyst merges
and evaluates once, instead of a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import register_sql_functions
from ..schemas import DEFAULT_ROUTES

# fixed names of the result fields
RESULT_FIELDS = ["optimal_cost", "shipment_a_to_1", "shipment_a_to_2", "shipment_b_to_1", "shipment_b_to_2",
                 "warehouse_a_utilization", "warehouse_b_utilization"]


def batch_optimize_sql(spark: SparkSession, features_view: str, scenarios_view: str,
                       routes=DEFAULT_ROUTES) -> DataFrame:
    """Run the SQL batch: feature costs pivoted from ``features_view`` for the
    four ``routes``, every row of ``scenarios_view`` planned with them."""
    register_sql_functions(spark)
    wa, wb, c1, c2 = routes
    extract = ",\n       ".join(f"result.{f} AS {f}" for f in RESULT_FIELDS)
    def cost(w, c):
        return (f"(SELECT MAX(CASE WHEN warehouse = {w} AND customer = {c} THEN composite_cost END) "
                f"FROM {features_view})")
    return spark.sql(f"""
SELECT optimize_transport(
         s.scenario_name, s.warehouse_a_capacity, s.warehouse_b_capacity,
         s.customer_1_demand, s.customer_2_demand,
         {cost(':wa', ':c1')}, {cost(':wa', ':c2')}, {cost(':wb', ':c1')}, {cost(':wb', ':c2')},
         (SELECT MAX(feature_timestamp) FROM {features_view})) AS result,
       {extract},
       result.scenario_name AS result_scenario_name,
       result.feasible AS feasible
FROM {scenarios_view} s
""", args={"wa": wa, "wb": wb, "c1": c1, "c2": c2})
