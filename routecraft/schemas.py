"""Schemas, keys and the fixed constants of the cost model."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity of every feature row: one transport route.
ROUTE_KEYS = ["warehouse", "customer"]

# ---------------------------------------------------------------------------
# Fixed values of the cost model (must equal the modelled application's):
#   fuel efficiency base            8   (litres-per-km scale of a 10 t vehicle)
#   reference vehicle capacity      10  (tons)
#   hourly driver rate              25
#   time-cost weight                0.3
#   default look-back               30 days
#   feature view name / version     cost_matrix_features / "1.0"
#   default costs when the feature store is off and a column is absent:
#       A->1 10, A->2 12, B->1 15, B->2 8
#   base constraints: Warehouse_A capacity 100, Warehouse_B capacity 80,
#       Customer_1 demand 70, Customer_2 demand 60
# ---------------------------------------------------------------------------
FUEL_EFFICIENCY_BASE = 8.0
REFERENCE_CAPACITY_TONS = 10.0
HOURLY_RATE = 25.0
TIME_WEIGHT = 0.3
LOOKBACK_DAYS = 30
FEATURE_VIEW_NAME = "cost_matrix_features"
FEATURE_VIEW_VERSION = "1.0"
DEFAULT_COSTS = {"cost_a_to_1": 10.0, "cost_a_to_2": 12.0, "cost_b_to_1": 15.0, "cost_b_to_2": 8.0}
BASE_CONSTRAINTS = {
    "warehouses": {"Warehouse_A": 100, "Warehouse_B": 80},
    "customers": {"Customer_1": 70, "Customer_2": 60},
}
# The two-warehouse, two-customer routes addressed by the wide scenario columns.
DEFAULT_ROUTES = ("Warehouse_A", "Warehouse_B", "Customer_1", "Customer_2")
COST_COLUMNS = ["cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2"]
CAPACITY_COLUMNS = ["warehouse_a_capacity", "warehouse_b_capacity"]
DEMAND_COLUMNS = ["customer_1_demand", "customer_2_demand"]

FACT_SCHEMA = T.StructType([
    T.StructField("warehouse", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("distance_km", T.DoubleType()),
    T.StructField("fuel_price_per_liter", T.DoubleType()),
    T.StructField("vehicle_capacity_tons", T.DoubleType()),
    T.StructField("base_rate_per_km", T.DoubleType()),
    T.StructField("travel_time_hours", T.DoubleType()),
    T.StructField("road_condition_factor", T.DoubleType()),
    T.StructField("seasonal_factor", T.DoubleType()),
    T.StructField("priority_multiplier", T.DoubleType()),
    T.StructField("last_updated", T.TimestampNTZType()),
])

FEATURE_SCHEMA = T.StructType([
    T.StructField("warehouse", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("avg_distance_cost", T.DoubleType()),
    T.StructField("avg_fuel_cost", T.DoubleType()),
    T.StructField("avg_time_cost", T.DoubleType()),
    T.StructField("avg_capacity_factor", T.DoubleType()),
    T.StructField("avg_seasonal_factor", T.DoubleType()),
    T.StructField("avg_priority_factor", T.DoubleType()),
    T.StructField("composite_cost", T.DoubleType()),
    T.StructField("fuel_price_volatility", T.DoubleType()),
    T.StructField("min_fuel_price", T.DoubleType()),
    T.StructField("max_fuel_price", T.DoubleType()),
    T.StructField("sample_count", T.LongType(), False),
    T.StructField("feature_timestamp", T.TimestampNTZType()),
])

SCENARIO_SCHEMA = T.StructType([
    T.StructField("scenario_name", T.StringType()),
    T.StructField("warehouse_a_capacity", T.LongType()),
    T.StructField("warehouse_b_capacity", T.LongType()),
    T.StructField("customer_1_demand", T.LongType()),
    T.StructField("customer_2_demand", T.LongType()),
    T.StructField("cost_a_to_1", T.DoubleType()),
    T.StructField("cost_a_to_2", T.DoubleType()),
    T.StructField("cost_b_to_1", T.DoubleType()),
    T.StructField("cost_b_to_2", T.DoubleType()),
])

ROUTE_COST_SCHEMA = T.StructType([
    T.StructField("warehouse", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("cost_per_unit", T.DoubleType()),
])

_PARTY = T.StructType([
    T.StructField("capacity", T.DoubleType()),
    T.StructField("demand", T.DoubleType()),
    T.StructField("description", T.StringType()),
])
CONSTRAINTS_SCHEMA = T.StructType([
    T.StructField("warehouses", T.MapType(T.StringType(), _PARTY)),
    T.StructField("customers", T.MapType(T.StringType(), _PARTY)),
])

PLAN_RESULT_SCHEMA = T.StructType([
    T.StructField("scenario_name", T.StringType()),
    T.StructField("optimal_cost", T.DoubleType()),
    T.StructField("feasible", T.BooleanType()),
    T.StructField("shipment_a_to_1", T.DoubleType()),
    T.StructField("shipment_a_to_2", T.DoubleType()),
    T.StructField("shipment_b_to_1", T.DoubleType()),
    T.StructField("shipment_b_to_2", T.DoubleType()),
    T.StructField("warehouse_a_utilization", T.DoubleType()),
    T.StructField("warehouse_b_utilization", T.DoubleType()),
    T.StructField("cost_matrix_source", T.StringType()),
    T.StructField("feature_timestamp", T.TimestampNTZType()),
    T.StructField("execution_mode", T.StringType()),
    T.StructField("error", T.StringType()),
])

# Messages of error rows, the same from the DataFrame planner and the SQL function.
MESSAGES = {
    "invalid": "not convertible: ",
    "null": "{} has no value",
    "negative": "cost below zero: ",
    "prejoined": "pre-joined costs without a value: ",
    "no_costs": "feature costs switched off and no cost column given",
    "no_feature": "route without features: ",
}
