"""Goldens computed from the seed observations and the sample scenarios."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from routecraft.operators.features import route_features
from routecraft.plans.batch_sql import batch_optimize_sql
from routecraft.plans.two_by_two import plan_2x2
from routecraft.sources.fact import seed_facts
from routecraft.sources.scenarios import batch_scenarios, sample_scenarios

EXPECTED_FEATURES = {  # route: (distance, fuel, time, capacity, priority, composite, volatility, min, max)
    ("Warehouse_A", "Customer_1"): (35.49375, 6.901875, 6.75, 0.958333, 1.075, 52.715306, 0.062716, 1.20, 1.35),
    ("Warehouse_A", "Customer_2"): (61.11, 11.916, 10.3125, 0.958333, 1.0, 82.5903, 0.062716, 1.20, 1.35),
    ("Warehouse_B", "Customer_1"): (67.065, 15.820625, 9.5625, 1.1875, 1.0, 113.801602, 0.062383, 1.25, 1.40),
    ("Warehouse_B", "Customer_2"): (31.8725, 7.499063, 6.0, 1.1875, 1.0, 55.645473, 0.062383, 1.25, 1.40),
}


@pytest.fixture(scope="module")
def seed_features(spark):
    return route_features(seed_facts(spark)).cache()


def test_seed_features(seed_features):
    rows = {(r.warehouse, r.customer): r for r in seed_features.collect()}
    assert set(rows) == set(EXPECTED_FEATURES)
    for key, exp in EXPECTED_FEATURES.items():
        r = rows[key]
        got = (r.avg_distance_cost, r.avg_fuel_cost, r.avg_time_cost, r.avg_capacity_factor, r.avg_priority_factor,
               r.composite_cost, r.fuel_price_volatility, r.min_fuel_price, r.max_fuel_price)
        assert got == pytest.approx(exp, abs=1e-6)
        assert r.sample_count == 4 and r.avg_seasonal_factor == pytest.approx(1.0125)


def _costs(df):
    return {r.scenario_name: (r.optimal_cost, r.feasible, r.cost_matrix_source) for r in df.collect()}


def test_sample_scenarios_with_overrides(spark, seed_features):
    sc = sample_scenarios(spark).withColumn("use_feature_store", F.lit(True))
    got = _costs(plan_2x2(sc, seed_features))
    assert got["base_case"] == (590.0, True, "override")
    assert got["peak_season"] == (770.0, True, "override")
    assert got["fuel_cost_spike"] == (850.0, True, "override")
    assert got["reduced_capacity"] == (None, False, "override")
    assert got["impossible_demand"] == (None, False, "override")


def test_sample_scenarios_features_only(spark, seed_features):
    sc = sample_scenarios(spark).drop("cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2")
    got = _costs(plan_2x2(sc, seed_features))
    assert got["base_case"][0] == pytest.approx(7028.7998, abs=1e-4)
    assert got["peak_season"][0] == pytest.approx(9196.0154, abs=1e-4)
    assert got["base_case"][2] == "feature_store"
    assert got["reduced_capacity"][1] is False


def test_sample_scenarios_prejoined(spark):
    sc = sample_scenarios(spark)
    for c, v in zip(["cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2"], [10.0, 12.0, 15.0, 8.0]):
        sc = sc.withColumn(c, F.lit(v))
    got = _costs(plan_2x2(sc, mode="sql"))
    assert got["base_case"] == (1180.0, True, "sql_input")
    assert got["peak_season"] == (1540.0, True, "sql_input")


def test_feasible_rows_ship_a_to_1_and_b_to_2(spark):
    rows = plan_2x2(sample_scenarios(spark), mode="sql").where("feasible").collect()
    for r in rows:
        assert r.shipment_a_to_2 == 0 and r.shipment_b_to_1 == 0


@pytest.mark.parametrize("ka,kb,expected,cost", [
    (60, 100, (60, 0, 10, 60), 600),
    (100, 40, (70, 20, 0, 40), 670),
    (70, 60, (70, 0, 0, 60), 590),
    (0, 130, (0, 0, 70, 60), 660),
])
def test_split_cases(spark, ka, kb, expected, cost):
    sc = spark.createDataFrame([("s", ka, kb, 70, 60, 5.0, 8.0, 6.0, 4.0)],
                               "scenario_name string, warehouse_a_capacity long, warehouse_b_capacity long, "
                               "customer_1_demand long, customer_2_demand long, cost_a_to_1 double, "
                               "cost_a_to_2 double, cost_b_to_1 double, cost_b_to_2 double")
    r = plan_2x2(sc, mode="sql").first()
    assert (r.shipment_a_to_1, r.shipment_a_to_2, r.shipment_b_to_1, r.shipment_b_to_2) == expected
    assert r.optimal_cost == cost and r.feasible
    if ka == 0:
        assert r.warehouse_a_utilization == 0


def test_sql_batch(spark, seed_features):
    seed_features.createOrReplaceTempView("seed_features_v1_0")
    batch_scenarios(spark, "seed_batch_scenarios")
    got = {r.result_scenario_name: r.optimal_cost for r in
           batch_optimize_sql(spark, "seed_features_v1_0", "seed_batch_scenarios").collect()}
    assert got["peak_season"] == pytest.approx(9196.0154, abs=1e-4)
    assert got["off_season"] == pytest.approx(4861.5842, abs=1e-4)
    assert got["fuel_price_hike"] == pytest.approx(7028.7998, abs=1e-4)
    assert got["new_warehouse"] == pytest.approx(7028.7998, abs=1e-4)


def test_error_rows(spark, seed_features):
    schema = ("scenario_name string, warehouse_a_capacity string, warehouse_b_capacity long, "
              "customer_1_demand long, customer_2_demand long, cost_a_to_1 double, feature_timestamp string")
    sc = spark.createDataFrame([
        ("null_capacity", None, 80, 70, 60, 5.0, None),
        ("text_capacity", "100.5", 80, 70, 60, 5.0, None),
        ("negative_cost", "100", 80, 70, 60, -1.0, None),
        ("bad_timestamp", "100", 80, 70, 60, 5.0, "not a time"),
        ("ok", "100", 80, 70, 60, 5.0, "2024-01-15T12:00:00"),
    ], schema)
    rows = {r.scenario_name: r for r in plan_2x2(sc, seed_features).collect()}
    for name in ["null_capacity", "text_capacity", "negative_cost", "bad_timestamp"]:
        assert rows[name].cost_matrix_source == "error" and rows[name].error, name
        assert rows[name].optimal_cost is None and not rows[name].feasible
    assert rows["ok"].error is None and rows["ok"].feasible
    assert rows["ok"].feature_timestamp == dt.datetime(2024, 1, 15, 12, 0)


def test_feature_store_off_without_overrides_is_error(spark, seed_features):
    sc = sample_scenarios(spark).select("scenario_name", "warehouse_a_capacity", "warehouse_b_capacity",
                                        "customer_1_demand", "customer_2_demand") \
        .withColumn("use_feature_store", F.lit(False))
    assert {r.cost_matrix_source for r in plan_2x2(sc, seed_features).collect()} == {"error"}


def test_override_only_defaults(spark):
    sc = sample_scenarios(spark).select("scenario_name", "warehouse_a_capacity", "warehouse_b_capacity",
                                        "customer_1_demand", "customer_2_demand", "cost_a_to_1") \
        .withColumn("use_feature_store", F.lit(False))
    r = {x.scenario_name: x for x in plan_2x2(sc).collect()}["base_case"]
    # costs 5 / 12 / 15 / 8: A serves 1 (5 < 15), B serves 2 (8 < 12)
    assert r.cost_matrix_source == "override_only" and r.optimal_cost == 70 * 5 + 60 * 8


def test_missing_route_feature_is_error(spark, seed_features):
    partial = seed_features.where("NOT (warehouse = 'Warehouse_B' AND customer = 'Customer_2')")
    sc = sample_scenarios(spark).drop("cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2")
    rows = plan_2x2(sc, partial).collect()
    assert all(r.cost_matrix_source == "error" and "cost_b_to_2" in r.error for r in rows)
