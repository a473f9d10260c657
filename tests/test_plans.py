"""Plans against exhaustive search, and the skew-safe running total."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from routecraft.operators.running import running_total
from routecraft.plans.merit_order import plan_mx1
from routecraft.plans.two_by_n import plan_2xn, plan_summary
from routecraft.plans.two_by_two import plan_2x2


def brute_force(ka, kb, demands, cost_a, cost_b):
    """Cheapest integer plan shipping exactly the demands (None if infeasible)."""
    best = None
    for xs in itertools.product(*[range(d + 1) for d in demands]):
        if sum(xs) > ka or sum(d - x for d, x in zip(demands, xs)) > kb:
            continue
        c = sum(a * x + b * (d - x) for a, b, d, x in zip(cost_a, cost_b, demands, xs))
        best = c if best is None else min(best, c)
    return best


def random_cases(n, customers, seed):
    rnd = random.Random(seed)
    for i in range(n):
        demands = [rnd.randint(0, 6) for _ in range(customers)]
        yield (f"s{i}", rnd.randint(0, 12), rnd.randint(0, 12), demands,
               [float(rnd.randint(0, 9)) for _ in range(customers)], [float(rnd.randint(0, 9)) for _ in range(customers)])


def test_plan_2x2_matches_brute_force(spark):
    cases = list(random_cases(300, 2, 1))
    rows = [(s, ka, kb, d[0], d[1], a[0], a[1], b[0], b[1]) for s, ka, kb, d, a, b in cases]
    df = spark.createDataFrame(rows, "scenario_name string, warehouse_a_capacity long, warehouse_b_capacity long, "
                                     "customer_1_demand long, customer_2_demand long, cost_a_to_1 double, "
                                     "cost_a_to_2 double, cost_b_to_1 double, cost_b_to_2 double")
    got = {r.scenario_name: r for r in plan_2x2(df, mode="sql").collect()}
    for s, ka, kb, d, a, b in cases:
        exp = brute_force(ka, kb, d, a, b)
        r = got[s]
        assert r.feasible == (exp is not None), s
        if exp is not None:
            assert r.optimal_cost == pytest.approx(exp), s
            assert r.shipment_a_to_1 + r.shipment_a_to_2 <= ka and r.shipment_b_to_1 + r.shipment_b_to_2 <= kb
            assert min(r.shipment_a_to_1, r.shipment_a_to_2, r.shipment_b_to_1, r.shipment_b_to_2) >= 0


@pytest.mark.parametrize("skew_safe", [True, False])
def test_plan_2xn_matches_brute_force(spark, skew_safe):
    cases = list(random_cases(120, 3, 2))
    lines = [(s, f"c{j}", d[j], a[j], b[j], ka, kb) for s, ka, kb, d, a, b in cases for j in range(3)]
    df = spark.createDataFrame(lines, "scenario_name string, customer string, demand long, cost_from_a double, "
                                      "cost_from_b double, capacity_a long, capacity_b long")
    summary = {r.scenario_name: r for r in plan_summary(plan_2xn(df, skew_safe=skew_safe)).collect()}
    for s, ka, kb, d, a, b in cases:
        exp = brute_force(ka, kb, d, a, b)
        assert summary[s].feasible == (exp is not None), s
        if exp is not None:
            assert summary[s].optimal_cost == pytest.approx(exp), s
            assert summary[s].used_a <= ka and summary[s].used_b <= kb


def test_plan_2xn_equals_2x2(spark):
    cases = list(random_cases(100, 2, 3))
    wide = spark.createDataFrame(
        [(s, ka, kb, d[0], d[1], a[0], a[1], b[0], b[1]) for s, ka, kb, d, a, b in cases],
        "scenario_name string, warehouse_a_capacity long, warehouse_b_capacity long, customer_1_demand long, "
        "customer_2_demand long, cost_a_to_1 double, cost_a_to_2 double, cost_b_to_1 double, cost_b_to_2 double")
    long = spark.createDataFrame(
        [(s, f"c{j}", d[j], a[j], b[j], ka, kb) for s, ka, kb, d, a, b in cases for j in range(2)],
        "scenario_name string, customer string, demand long, cost_from_a double, cost_from_b double, "
        "capacity_a long, capacity_b long")
    w = {r.scenario_name: r.optimal_cost for r in plan_2x2(wide, mode="sql").collect()}
    n = {r.scenario_name: r.optimal_cost for r in plan_summary(plan_2xn(long)).collect()}
    assert w.keys() == n.keys()
    for k in w:
        assert (w[k] is None and n[k] is None) or w[k] == pytest.approx(n[k])


def test_merit_order_matches_brute_force(spark):
    rnd = random.Random(4)
    rows, expected = [], {}
    for i in range(80):
        m = rnd.randint(2, 4)
        caps = [rnd.randint(0, 8) for _ in range(m)]
        costs = [float(rnd.randint(0, 9)) for _ in range(m)]
        demand = rnd.randint(0, 15)
        best = None
        for xs in itertools.product(*[range(c + 1) for c in caps]):
            if sum(xs) == demand:
                c = sum(x * k for x, k in zip(xs, costs))
                best = c if best is None else min(best, c)
        expected[f"c{i}"] = best
        rows += [(f"c{i}", f"w{j}", costs[j], caps[j], demand) for j in range(m)]
    df = spark.createDataFrame(rows, "customer string, warehouse string, cost_per_unit double, capacity long, "
                                     "demand long")
    out = plan_mx1(df)
    got = {r.customer: (r.feasible, r.total) for r in out.groupBy("customer").agg(
        F.bool_and("feasible").alias("feasible"), F.sum(F.col("shipment") * F.col("cost_per_unit")).alias("total")
    ).collect()}
    for c, best in expected.items():
        assert got[c][0] == (best is not None), c
        if best is not None:
            assert got[c][1] == pytest.approx(best), c


def test_running_total_hot_group(spark):
    """One group with most rows: the skew-safe form spreads it over slices and
    still equals the single-window answer."""
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
        .alias("g"), F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    safe = running_total(df, ["g"], ["k"], "v", "before", totals={"tot": ("sum", F.col("v"))}, slices=8)
    plain = running_total(df, ["g"], ["k"], "v", "before", totals={"tot": ("sum", F.col("v"))}, skew_safe=False)
    a = sorted(safe.select("g", "k", "before", "tot").collect())
    b = sorted(plain.select("g", "k", "before", "tot").collect())
    assert a == b
    # the hot group really is cut into several slices
    n_slices = df.repartitionByRange(8, "g", "k").withColumn("s", F.spark_partition_id()) \
        .where("g = 'hot'").select("s").distinct().count()
    assert n_slices > 1
