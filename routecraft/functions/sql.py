"""The planner as SQL functions, for ``spark.sql`` users.

``optimize_transport(name, cap_a, cap_b, demand_1, demand_2, cost_a_to_1,
cost_a_to_2, cost_b_to_1, cost_b_to_2, feature_timestamp)`` returns the plan
result as a struct (pre-joined / sql-mode semantics). The functions are SQL
bodies, so Catalyst inlines them into a plain projection: no Python worker.
Nested helper functions stand in for local variables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import CAPACITY_COLUMNS, COST_COLUMNS, DEMAND_COLUMNS, MESSAGES

RESULT_TYPE = ("STRUCT<scenario_name: STRING, optimal_cost: DOUBLE, feasible: BOOLEAN, "
               "shipment_a_to_1: DOUBLE, shipment_a_to_2: DOUBLE, shipment_b_to_1: DOUBLE, "
               "shipment_b_to_2: DOUBLE, warehouse_a_utilization: DOUBLE, warehouse_b_utilization: DOUBLE, "
               "cost_matrix_source: STRING, feature_timestamp: TIMESTAMP_NTZ, execution_mode: STRING, "
               "error: STRING>")

_CORE = f"""
CREATE OR REPLACE TEMPORARY FUNCTION rc_plan_core(
    name STRING, ka DOUBLE, kb DOUBLE, e1 DOUBLE, e2 DOUBLE, ca1 DOUBLE, ca2 DOUBLE, cb1 DOUBLE, cb2 DOUBLE,
    t DOUBLE, x1 DOUBLE, ts TIMESTAMP_NTZ, err STRING, ok BOOLEAN)
RETURNS {RESULT_TYPE}
RETURN named_struct(
    'scenario_name', name,
    'optimal_cost', CASE WHEN ok THEN ca1 * x1 + ca2 * (t - x1) + cb1 * (e1 - x1) + cb2 * (e2 - (t - x1)) END,
    'feasible', ok,
    'shipment_a_to_1', CASE WHEN ok THEN x1 ELSE 0D END,
    'shipment_a_to_2', CASE WHEN ok THEN t - x1 ELSE 0D END,
    'shipment_b_to_1', CASE WHEN ok THEN e1 - x1 ELSE 0D END,
    'shipment_b_to_2', CASE WHEN ok THEN e2 - (t - x1) ELSE 0D END,
    'warehouse_a_utilization', CASE WHEN ok THEN coalesce(try_divide(t, ka) * 100D, 0D) ELSE 0D END,
    'warehouse_b_utilization', CASE WHEN ok THEN coalesce(try_divide(e1 + e2 - t, kb) * 100D, 0D) ELSE 0D END,
    'cost_matrix_source', CASE WHEN err IS NULL THEN 'sql_input' ELSE 'error' END,
    'feature_timestamp', ts,
    'execution_mode', 'sql',
    'error', err)
"""

_FILL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION rc_plan_fill(
    name STRING, ka DOUBLE, kb DOUBLE, e1 DOUBLE, e2 DOUBLE, ca1 DOUBLE, ca2 DOUBLE, cb1 DOUBLE, cb2 DOUBLE,
    t DOUBLE, ts TIMESTAMP_NTZ, err STRING)
RETURNS {RESULT_TYPE}
RETURN rc_plan_core(name, ka, kb, e1, e2, ca1, ca2, cb1, cb2, t,
    CASE WHEN ca1 - cb1 <= ca2 - cb2 THEN least(e1, t) ELSE t - least(e2, t) END,
    ts, err, coalesce(err IS NULL AND ka >= 0 AND kb >= 0 AND e1 + e2 <= ka + kb, false))
"""

_NULLS = "\n".join(f"      WHEN {c} IS NULL THEN '{MESSAGES['null'].format(c)}'" for c in CAPACITY_COLUMNS + DEMAND_COLUMNS)


def _listed(test: str) -> str:
    """Names of the cost parameters for which ``test`` holds."""
    names = ", ".join(f"CASE WHEN {test.format(c)} THEN '{c}' END" for c in COST_COLUMNS)
    return f"array_join(array_compact(array({names})), ', ')"


_ENTRY = f"""
CREATE OR REPLACE TEMPORARY FUNCTION optimize_transport(
    scenario_name STRING, warehouse_a_capacity BIGINT, warehouse_b_capacity BIGINT,
    customer_1_demand BIGINT, customer_2_demand BIGINT,
    cost_a_to_1 DOUBLE, cost_a_to_2 DOUBLE, cost_b_to_1 DOUBLE, cost_b_to_2 DOUBLE,
    feature_timestamp TIMESTAMP_NTZ)
RETURNS {RESULT_TYPE}
RETURN rc_plan_fill(
    scenario_name, CAST(warehouse_a_capacity AS DOUBLE), CAST(warehouse_b_capacity AS DOUBLE),
    greatest(CAST(customer_1_demand AS DOUBLE), 0D), greatest(CAST(customer_2_demand AS DOUBLE), 0D),
    nanvl(cost_a_to_1, NULL), nanvl(cost_a_to_2, NULL), nanvl(cost_b_to_1, NULL), nanvl(cost_b_to_2, NULL),
    least(greatest(
            (CASE WHEN cost_a_to_1 - cost_b_to_1 < 0 THEN greatest(CAST(customer_1_demand AS DOUBLE), 0D) ELSE 0D END)
          + (CASE WHEN cost_a_to_2 - cost_b_to_2 < 0 THEN greatest(CAST(customer_2_demand AS DOUBLE), 0D) ELSE 0D END),
            greatest(CAST(customer_1_demand AS DOUBLE), 0D) + greatest(CAST(customer_2_demand AS DOUBLE), 0D)
              - CAST(warehouse_b_capacity AS DOUBLE), 0D),
          CAST(warehouse_a_capacity AS DOUBLE),
          greatest(CAST(customer_1_demand AS DOUBLE), 0D) + greatest(CAST(customer_2_demand AS DOUBLE), 0D)),
    feature_timestamp,
    CASE
{_NULLS}
      WHEN nanvl(cost_a_to_1 + cost_a_to_2 + cost_b_to_1 + cost_b_to_2, NULL) IS NULL
        THEN concat('{MESSAGES["prejoined"]}', {_listed("nanvl({0}, NULL) IS NULL")})
      WHEN least(cost_a_to_1, cost_a_to_2, cost_b_to_1, cost_b_to_2) < 0
        THEN concat('{MESSAGES["negative"]}', {_listed("{0} < 0")})
    END)
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Register ``optimize_transport`` (and its helpers) in the session."""
    for stmt in (_CORE, _FILL, _ENTRY):
        spark.sql(stmt)
