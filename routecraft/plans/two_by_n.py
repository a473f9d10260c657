"""Two warehouses x any number of customers: the long scenario planner.

Input is long: one row per (scenario, customer) with the unit costs from
warehouse A and B and the customer's demand, plus the scenario capacities.
The plan is exact (see ``two_by_two`` for the rule): per scenario
  T = min(max(want, D - K_B, 0), K_A, D)
and A fills customers in ascending (cost_a - cost_b, customer) order; the
running demand before each customer comes from ``running_total``. Everything
else is grouped aggregation on the scenario key (partial aggregation first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.running import running_total

CUSTOMERS_PER_BUCKET = 1024


def complete_lines(lines: DataFrame, scenarios: DataFrame, demands: DataFrame,
                   scenario_col: str = "scenario_name") -> DataFrame:
    """Every scenario with every customer that has a demand: the given ``lines`` (scenario,
    customer, cost_from_a, cost_from_b), and those that a scenario lacks with null costs, which
    make the planner report the scenario as an error instead of serving it in part.

    ``scenarios`` has one row for each scenario, ``demands`` (customer, demand) one for each
    customer. Only scenarios with fewer lines than there are customers are looked at, and of
    them only the buckets of customers in which one is missing; these meet the demand table
    by bucket. The three inputs are read several times: pass small or written tables.
    """
    s = scenario_col
    buckets = max(1, -(-demands.count() // CUSTOMERS_PER_BUCKET))
    wanted = demands.withColumn("_bucket", F.pmod(F.xxhash64("customer"), F.lit(buckets)).cast("int"))
    own = lines.join(wanted, "customer").select(s, "customer", "cost_from_a", "cost_from_b", "_bucket", "demand")
    sizes = wanted.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    have = own.groupBy(s, "_bucket").agg(F.count(F.lit(1)).alias("_have"))
    total = sizes.agg(F.sum("_size")).scalar()
    full = have.groupBy(s).agg(F.sum("_have").alias("_all")).where(F.col("_all") >= total)
    short = scenarios.select(s).join(full, s, "left_anti")
    gaps = (short.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).join(sizes, "_bucket")
            .join(have, [s, "_bucket"], "left").where(F.coalesce("_have", F.lit(0)) < F.col("_size")).select(s, "_bucket"))
    missing = gaps.join(wanted, "_bucket").join(own.select(s, "customer"), [s, "customer"], "left_anti")
    every = own.drop("_bucket").unionByName(missing.drop("_bucket"), allowMissingColumns=True)
    return every.join(scenarios, s)


def plan_2xn(lines: DataFrame, scenario_col: str = "scenario_name", skew_safe: bool = True,
             carry: list[str] | None = None) -> DataFrame:
    """Solve every scenario of ``lines``.

    ``lines`` columns: scenario key, ``customer``, ``demand``, ``cost_from_a``,
    ``cost_from_b``, ``capacity_a``, ``capacity_b`` (the capacities repeat on
    each line of a scenario).
    Returns one row per line with ``shipment_from_a``, ``shipment_from_b``,
    ``line_cost`` and the scenario's ``feasible`` flag and ``error``.
    ``carry``: extra line columns passed through (e.g. warehouse names).
    """
    carry = carry or []
    s = scenario_col
    base = lines.select(
        s, "customer", *carry,
        F.greatest(F.col("demand").cast("double"), F.lit(0.0)).alias("demand"),
        F.col("cost_from_a").cast("double").alias("cost_from_a"),
        F.col("cost_from_b").cast("double").alias("cost_from_b"),
        F.col("capacity_a").cast("double").alias("capacity_a"),
        F.col("capacity_b").cast("double").alias("capacity_b"),
    ).withColumn("_p", F.col("cost_from_a") - F.col("cost_from_b"))

    demand, p = F.col("demand"), F.col("_p")
    # one pass: running demand in fill order + the scenario totals it needs
    ordered = running_total(base, [s], ["_p", "customer"], "demand", "_before", totals={
        "_total": ("sum", demand),
        "_want": ("sum", F.when(p < 0, demand).otherwise(F.lit(0.0))),
        "_ka": ("max", F.col("capacity_a")), "_kb": ("max", F.col("capacity_b")),
        "_missing": ("sum", F.when(F.col("cost_from_a").isNull() | F.col("cost_from_b").isNull(), 1).otherwise(0)),
        "_negative": ("sum", F.when((F.col("cost_from_a") < 0) | (F.col("cost_from_b") < 0), 1).otherwise(0)),
    }, skew_safe=skew_safe)
    error = (F.when(F.col("_missing") > 0, F.lit("route cost missing"))
             .when(F.col("_negative") > 0, F.lit("negative route cost")))
    capacity_ok = ((F.col("_ka") >= 0) & (F.col("_kb") >= 0)
                   & (F.col("_total") <= F.col("_ka") + F.col("_kb")))
    from_a = F.least(F.greatest(F.col("_want"), F.col("_total") - F.col("_kb"), F.lit(0.0)),
                     F.col("_ka"), F.col("_total"))
    staged = ordered.select("*", error.alias("error"), from_a.alias("_from_a")) \
        .withColumn("feasible", F.col("error").isNull() & capacity_ok)
    x = F.greatest(F.lit(0.0), F.least(F.col("demand"), F.col("_from_a") - F.col("_before")))
    return (staged
            .select(s, "customer", *carry, "demand", "cost_from_a", "cost_from_b", "capacity_a", "capacity_b",
                    "feasible", "error",
                    F.when(F.col("feasible"), x).otherwise(F.lit(0.0)).alias("shipment_from_a"),
                    F.when(F.col("feasible"), F.col("demand") - x).otherwise(F.lit(0.0)).alias("shipment_from_b"))
            .withColumn("line_cost", F.when(F.col("feasible"),
                                            F.col("cost_from_a") * F.col("shipment_from_a")
                                            + F.col("cost_from_b") * F.col("shipment_from_b"))))


def plan_summary(plan_lines: DataFrame, scenario_col: str = "scenario_name") -> DataFrame:
    """Per scenario: optimal cost, feasibility, units from each warehouse and
    their utilisation (percent; null when the capacity is 0)."""
    s = scenario_col
    return plan_lines.groupBy(s).agg(
        F.sum("line_cost").alias("optimal_cost"),
        F.bool_and("feasible").alias("feasible"),
        F.max("error").alias("error"),
        F.sum("shipment_from_a").alias("used_a"),
        F.sum("shipment_from_b").alias("used_b"),
        F.max("capacity_a").alias("capacity_a"),
        F.max("capacity_b").alias("capacity_b"),
        F.sum("demand").alias("total_demand"),
    ).select(s, "optimal_cost", "feasible", "error", "used_a", "used_b", "total_demand",
             (F.try_divide(F.col("used_a"), F.col("capacity_a")) * F.lit(100.0)).alias("utilization_a"),
             (F.try_divide(F.col("used_b"), F.col("capacity_b")) * F.lit(100.0)).alias("utilization_b"))
