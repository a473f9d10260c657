"""Plans that miss customers, default names, equal messages, ambiguous matrices, unmatched limits."""

import pytest
from pyspark.sql import functions as F

from routecraft.functions.sql import register_sql_functions
from routecraft.operators.matrix import cost_matrix_long, cost_matrix_pivot
from routecraft.operators.reports import routes_with_constraints, unmatched_constraints
from routecraft.plans import two_by_n
from routecraft.plans.two_by_n import complete_lines, plan_2xn, plan_summary
from routecraft.plans.two_by_two import plan_2x2


@pytest.mark.parametrize("per_bucket", [1, 2, 1024])
def test_unreachable_customer_keeps_its_line(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(two_by_n, "CUSTOMERS_PER_BUCKET", per_bucket)
    scenarios = spark.createDataFrame([("s1", 100, 100), ("s2", 100, 100), ("s3", 100, 100)], "scenario_name string, capacity_a long, capacity_b long")
    demands = spark.createDataFrame([(f"c{i}", 5) for i in range(5)], "customer string, demand long")
    lines = spark.createDataFrame([("s1", f"c{i}", 1.0, 2.0) for i in range(5)] + [("s2", f"c{i}", 1.0, 2.0) for i in range(4)]
                                  + [("s1", "no demand", 1.0, 1.0), ("s2", "no demand", 1.0, 1.0)],
                                  "scenario_name string, customer string, cost_from_a double, cost_from_b double")
    full = complete_lines(lines, scenarios, demands)
    assert full.groupBy("scenario_name").count().where("count <> 5").count() == 0 and full.count() == 15
    plan = plan_2xn(full)
    assert {(r.scenario_name, r.customer) for r in plan.where("cost_from_a is null").collect()} == {("s2", "c4")} | {("s3", f"c{i}") for i in range(5)}
    got = {r.scenario_name: (r.feasible, r.error is None, r.optimal_cost, r.total_demand) for r in plan_summary(plan).collect()}
    assert got == {"s1": (True, True, 25.0, 25.0), "s2": (False, False, None, 25.0), "s3": (False, False, None, 25.0)}


COSTS = ["cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2"]
LIMITS = ["warehouse_a_capacity", "warehouse_b_capacity", "customer_1_demand", "customer_2_demand"]


def test_default_names_in_plans_and_error_rows(spark):
    rows = [(2, None, None, 80), (0, None, 100, 80), (1, "named", None, 80), (3, None, 100, 80)]
    df = spark.createDataFrame(rows, "pos int, scenario_name string, warehouse_a_capacity long, warehouse_b_capacity long") \
        .select("*", F.lit(70).alias("customer_1_demand"), F.lit(60).alias("customer_2_demand"), *[F.lit(5.0).alias(c) for c in COSTS])
    got = {r.pos: (r.scenario_name, r.error is None) for r in plan_2x2(df, mode="sql", keep=["pos"], order_by=["pos"]).collect()}
    assert got == {0: ("scenario_0", True), 1: ("named", False), 2: ("scenario_2", False), 3: ("scenario_3", True)}
    bare = plan_2x2(df.drop("scenario_name"), mode="sql", keep=["pos"], order_by=["pos"])
    assert {r.pos: r.scenario_name for r in bare.collect()} == {i: f"scenario_{i}" for i in range(4)}
    assert {r.scenario_name for r in plan_2x2(df.drop("scenario_name"), mode="sql").collect()} == {None}


def test_messages_are_the_same_from_sql(spark):
    full = [100, 80, 70, 60, 5.0, 8.0, 6.0, 4.0]
    rows = [("ok", *full)]
    for i in range(8):
        rows.append((f"null {i}", *[None if i == j else v for j, v in enumerate(full)]))
    for i in range(4, 8):
        rows.append((f"minus {i}", *[-1.0 if j in (i, 5) else v for j, v in enumerate(full)]))
    rows += [("nan", *full[:7], float("nan")), ("both", None, None, *full[2:4], None, -1.0, None, 4.0)]
    df = spark.createDataFrame(rows, "scenario_name string, " + ", ".join(f"{c} long" for c in LIMITS) + ", " + ", ".join(f"{c} double" for c in COSTS))
    register_sql_functions(spark)
    df.createOrReplaceTempView("message_cases")
    sql = spark.sql(f"SELECT r.* FROM (SELECT optimize_transport(scenario_name, {', '.join(LIMITS + COSTS)}, CAST(NULL AS TIMESTAMP_NTZ)) AS r FROM message_cases)")
    a, b = ({r.scenario_name: r for r in x.collect()} for x in (plan_2x2(df, mode="sql"), sql))
    assert a == b and sum(r.error is not None for r in a.values()) == len(rows) - 1
    assert a["minus 4"].error.endswith("cost_a_to_1, cost_a_to_2")


def test_ambiguous_matrix_is_an_error(spark):
    schema = "warehouse string, customer string, composite_cost double"
    good = [("w1", "a", 1.0), ("w1", "b", None), ("w2", "new", 3.0), ("w2", None, 4.0)]
    wide = cost_matrix_pivot(spark.createDataFrame(good, schema))
    assert wide.columns == ["warehouse", "a", "b", "new", "null"]
    assert {tuple(r) for r in wide.collect()} == {("w1", 1.0, None, None, None), ("w2", None, None, 3.0, 4.0)}
    assert cost_matrix_long(wide).count() == 3
    assert cost_matrix_pivot(spark.createDataFrame(good, schema), ["a", "z"]).columns == ["warehouse", "a", "z"]
    with pytest.raises(Exception, match=r"route \(w1, a\) occurs 2 times"):
        cost_matrix_pivot(spark.createDataFrame(good + [("w1", "a", 1.0)], schema))


def test_unmatched_limits_both_ways(spark):
    costs = spark.createDataFrame([("w1", "c1", 1.0), ("w2", "c2", 2.0), ("w2", None, 2.0)], "warehouse string, customer string, cost_per_unit double")
    caps = spark.createDataFrame([("w1", 10), ("w3", 10)], "warehouse string, capacity long")
    dems = spark.createDataFrame([("c1", 5), ("c9", 5)], "customer string, demand long")
    got = {(r.problem, r.name) for r in unmatched_constraints(costs, caps, dems).collect()}
    assert got == {("route without capacity", "w2"), ("route without demand", "c2"), ("route without demand", None),
                   ("capacity without route", "w3"), ("demand without route", "c9")}
    errors = {(r.warehouse, r.customer): r.error for r in routes_with_constraints(costs, caps, dems).collect()}
    assert errors[("w1", "c1")] is None and "w2" in errors[("w2", "c2")]
