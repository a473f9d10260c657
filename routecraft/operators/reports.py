"""Plan reports: utilisation, satisfaction, shipments, display lines, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed names of the detail report
DETAIL_COLUMNS = ["scenario_name", "optimal_cost", "feasible", "warehouse_a_utilization",
                  "warehouse_b_utilization", "cost_matrix_source", "execution_mode"]


def warehouse_utilization(plan_lines: DataFrame, scenario_col: str = "scenario_name") -> DataFrame:
    """Per (scenario, warehouse): units used, capacity, utilisation rate
    (fraction; null when the capacity is 0). Needs ``warehouse_a``/``warehouse_b``."""
    s = scenario_col
    per = plan_lines.groupBy(s).agg(
        F.max("warehouse_a").alias("wa"), F.max("warehouse_b").alias("wb"),
        F.sum("shipment_from_a").alias("ua"), F.sum("shipment_from_b").alias("ub"),
        F.max("capacity_a").alias("ka"), F.max("capacity_b").alias("kb"))
    long = per.select(s, F.inline(F.array(
        F.struct(F.col("wa").alias("warehouse"), F.col("ua").alias("used"), F.col("ka").alias("capacity")),
        F.struct(F.col("wb").alias("warehouse"), F.col("ub").alias("used"), F.col("kb").alias("capacity")))))
    return long.withColumn("utilization_rate", F.try_divide(F.col("used"), F.col("capacity")))


def customer_satisfaction(plan_lines: DataFrame, scenario_col: str = "scenario_name") -> DataFrame:
    """Per (scenario, customer): units received, demand, satisfaction rate
    (null when the demand is 0)."""
    received = F.col("shipment_from_a") + F.col("shipment_from_b")
    return plan_lines.select(scenario_col, "customer", received.alias("received"), "demand",
                             F.try_divide(received, F.col("demand")).alias("satisfaction_rate"))


def shipments_nonzero(plan_lines: DataFrame, scenario_col: str = "scenario_name") -> DataFrame:
    """Positive shipments only, one row per (scenario, warehouse, customer),
    with the cost of the shipment = quantity x unit cost."""
    legs = plan_lines.select(scenario_col, "customer", F.inline(F.array(
        F.struct(F.col("warehouse_a").alias("warehouse"), F.col("shipment_from_a").alias("quantity"),
                 F.col("cost_from_a").alias("cost_per_unit")),
        F.struct(F.col("warehouse_b").alias("warehouse"), F.col("shipment_from_b").alias("quantity"),
                 F.col("cost_from_b").alias("cost_per_unit")))))
    return (legs.where(F.col("quantity") > 0)
            .withColumn("shipment_cost", F.col("quantity") * F.col("cost_per_unit")))


def summary_line(plan: DataFrame) -> DataFrame:
    """Display value per scenario: the cost as '$1234.56' when feasible, else 'N/A'."""
    return plan.select("scenario_name", "feasible", "cost_matrix_source", "execution_mode",
                       F.when(F.col("feasible"), F.format_string("$%.2f", F.col("optimal_cost")))
                       .otherwise(F.lit("N/A")).alias("display_cost"))


def plan_detail(plan: DataFrame) -> DataFrame:
    """The seven detail columns of a plan result."""
    return plan.select(*DETAIL_COLUMNS)


def source_counts(plan: DataFrame) -> DataFrame:
    """Value counts of execution mode and of cost source, most frequent first."""
    counts = plan.select(F.inline(F.array(
        F.struct(F.lit("execution_mode").alias("attribute"), F.col("execution_mode").alias("value")),
        F.struct(F.lit("cost_matrix_source").alias("attribute"), F.col("cost_matrix_source").alias("value")))))
    return counts.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("attribute", F.col("n").desc(), "value")


def routes_with_constraints(route_costs: DataFrame, capacities: DataFrame, demands: DataFrame) -> DataFrame:
    """Route costs with their warehouse capacity and customer demand (left
    joins); a route whose warehouse or customer has no constraint gets an error."""
    joined = route_costs.join(capacities, "warehouse", "left").join(demands, "customer", "left")
    return joined.withColumn(
        "error",
        F.when(F.col("capacity").isNull(), F.concat(F.lit("no capacity for "), F.col("warehouse")))
         .when(F.col("demand").isNull(), F.concat(F.lit("no demand for "), F.col("customer"))))


def unmatched_constraints(route_costs: DataFrame, capacities: DataFrame, demands: DataFrame) -> DataFrame:
    """problem, name: keys that one side has and the other lacks, both ways. Warehouses and
    customers of routes without a limit, and limits of parties that no route has. A null key
    matches nothing and is reported."""
    def lacking(left, right, key, problem):
        return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti") \
            .select(F.lit(problem).alias("problem"), F.col(key).alias("name"))
    parts = [lacking(route_costs, capacities, "warehouse", "route without capacity"),
             lacking(route_costs, demands, "customer", "route without demand"),
             lacking(capacities, route_costs, "warehouse", "capacity without route"),
             lacking(demands, route_costs, "customer", "demand without route")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
