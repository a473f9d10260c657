"""Registered queries over the test tables: name -> (spark, data_dir) -> DataFrame.

Every query reads the given tables (the fact mapping of ``sources.fact``) or
data Spark derives from them, over whole tables. Double results are rounded
to ``DIGITS`` decimals at this reporting edge only (the library itself keeps
full precision), so that engines summing in different orders report equal
values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import asof
from .operators import features as feat
from .operators import matrix
from .plans.merit_order import plan_mx1
from .plans.two_by_n import complete_lines, plan_2xn, plan_summary
from .plans.two_by_two import plan_2x2
from .session import hand_off, run_path
from .sources import scenarios as scen
from .sources.fact import fact_from_tpch
from .sources.tables import table

DIGITS = 6
FILE_ROWS = 1 << 20                       # rows of a file of streamed facts
LANE = ["warehouse", "customer", "lane_warehouse"]
AS_OF = "2000-07-02"                      # look-back end used by the windowed queries
WIDE_ROUTES = ("Warehouse_00", "Warehouse_01", "Customer_AUTOMOBILE", "Customer_BUILDING")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column half up (reporting edge only).

    A first round to 9 decimals merges values that differ only in the last
    bit (sums taken in another order), so exact decimal ties such as 1.0665625
    round the same way whichever side of the tie the raw sum landed on.
    """
    return df.select(*[F.round(F.round(F.col(f.name), 9), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


# -- shared building blocks ----------------------------------------------------

def facts(spark, d, with_lane=False) -> DataFrame:
    return fact_from_tpch(spark, d, with_lane=with_lane)


def lane_stats(spark, d) -> DataFrame:
    """Partial statistics per (warehouse, customer, lane_warehouse), computed
    once, written, and shared by every consumer of a query."""
    return hand_off(feat.route_partials(facts(spark, d, with_lane=True), LANE), "lane-stats")


def observations(spark, d, keys=feat.ROUTE_KEYS) -> DataFrame:
    """Partial statistics per (``keys``, observation time), written once: the one table
    that point-in-time queries take spine, snapshots and counts from."""
    return hand_off(feat.route_partials(facts(spark, d, with_lane="lane_warehouse" in keys), [*keys, "last_updated"]), "observations")


def span_observations(spark, d, keys) -> DataFrame:
    """``observations`` per (``keys``, snapshot span) for queries that only look at monthly
    snapshots: the groups that a task holds are keys x months, however many facts there are."""
    span = asof.snapshot_span(F.col("last_updated"))
    rows = facts(spark, d, with_lane="lane_warehouse" in keys).withColumns(span)
    return hand_off(feat.route_partials(rows, [*keys, *span]), "observations")


def priced_pairs(stats: DataFrame, customers=scen.FACT_WIDE_CUSTOMERS) -> DataFrame:
    """Wide two-customer scenarios over lane pairs with per-warehouse feature costs."""
    features = feat.merge_partials(stats)
    byw = matrix.costs_by_warehouse(features, customers)
    a = byw.select(F.col("warehouse").alias("warehouse_a"), F.col("cost_to_1").alias("fs_cost_a_to_1"),
                   F.col("cost_to_2").alias("fs_cost_a_to_2"), F.col("feature_timestamp").alias("_ts_a"))
    b = byw.select(F.col("warehouse").alias("warehouse_b"), F.col("cost_to_1").alias("fs_cost_b_to_1"),
                   F.col("cost_to_2").alias("fs_cost_b_to_2"), F.col("feature_timestamp").alias("_ts_b"))
    return (scen.fact_wide_scenarios(stats, customers)
            .join(a, "warehouse_a", "left").join(b, "warehouse_b", "left")
            .withColumn("fs_feature_timestamp", F.greatest("_ts_a", "_ts_b"))
            .drop("_ts_a", "_ts_b"))


def plan_lines(stats: DataFrame) -> DataFrame:
    """Long 2xN lines: lane pair x every customer with a demand.

    Each pair is expanded to its two ends (fixed fan-out 2), joined once to the
    route features on the warehouse, and folded back per (scenario, customer);
    customers that neither end reaches are added without costs.
    """
    features = feat.merge_partials(stats).select("warehouse", "customer", "composite_cost")
    pairs = scen.fact_pair_scenarios(stats).select(
        "scenario_name", "warehouse_a", "warehouse_b", F.col("warehouse_a_capacity").alias("capacity_a"),
        F.col("warehouse_b_capacity").alias("capacity_b"))
    ends = pairs.select("scenario_name", F.inline(F.array(F.struct(F.col("warehouse_a").alias("warehouse"), F.lit(True).alias("is_a")),
                         F.struct(F.col("warehouse_b").alias("warehouse"), F.lit(False).alias("is_a")))))
    priced = ends.join(features, "warehouse")  # route table: one row per (warehouse, customer)
    lines = priced.groupBy("scenario_name", "customer").agg(
        F.max(F.when(F.col("is_a"), F.col("composite_cost"))).alias("cost_from_a"),
        F.max(F.when(~F.col("is_a"), F.col("composite_cost"))).alias("cost_from_b"))
    return complete_lines(lines, pairs, scen.customer_demands(stats))


# -- A. sources ----------------------------------------------------------------

@register("fact_scan")
def q_fact_scan(spark, d):
    return facts(spark, d)


# -- B. projections ------------------------------------------------------------

@register("route_cost_components")
def q_route_cost_components(spark, d):
    f = feat.with_cost_components(facts(spark, d))
    return rounded(f.select("warehouse", "customer", "last_updated", "distance_cost", "fuel_cost",
                            "time_cost", "capacity_factor"))


@register("route_composite_cost")
def q_route_composite_cost(spark, d):
    f = feat.with_cost_components(facts(spark, d))
    return rounded(f.select("warehouse", "customer", "last_updated", "calculated_cost"))


# -- D. features and matrices ----------------------------------------------------

@register("features_all")
def q_features_all(spark, d):
    return rounded(feat.route_features(facts(spark, d)))


@register("features_30d")
def q_features_30d(spark, d):
    return rounded(feat.route_features(facts(spark, d), as_of=AS_OF, lookback_days=30))


@register("features_from_partials")
def q_features_from_partials(spark, d):
    return rounded(feat.merge_partials(feat.route_partials(facts(spark, d, with_lane=True), LANE)))


@register("features_30d_partitioned")
def q_features_30d_partitioned(spark, d):
    """The fact table stored by day: the look-back opens the folders of its days only."""
    from .sources.fact import create_fact_table, read_fact_days
    path = run_path(spark, "facts-by-day")
    create_fact_table(facts(spark, d), path)
    near = read_fact_days(spark, path, first="2000-06-02", last=AS_OF)
    return rounded(feat.route_features(near, as_of=AS_OF, lookback_days=30))


@register("cost_matrix_wide")
def q_cost_matrix_wide(spark, d):
    return rounded(matrix.cost_matrix_wide(feat.route_features(facts(spark, d)), WIDE_ROUTES))


@register("cost_matrix_pivot")
def q_cost_matrix_pivot(spark, d):
    return rounded(matrix.cost_matrix_pivot(feat.route_features(facts(spark, d))))


@register("cost_matrix_long")
def q_cost_matrix_long(spark, d):
    wide = matrix.cost_matrix_pivot(feat.route_features(facts(spark, d)))
    return rounded(matrix.cost_matrix_long(wide))


@register("route_costs_dedup")
def q_route_costs_dedup(spark, d):
    f = feat.with_cost_components(facts(spark, d))
    return matrix.route_costs_dedup(
        f.select("warehouse", "customer", F.col("calculated_cost").alias("cost_per_unit")))


# -- E. sort / limit -------------------------------------------------------------

@register("latest_costs_top10")
def q_latest_costs_top10(spark, d):
    f = feat.with_cost_components(facts(spark, d))
    top = (f.select("warehouse", "customer", "distance_km", "fuel_price_per_liter", "seasonal_factor",
                    "calculated_cost", "last_updated")
           .orderBy(F.col("warehouse"), F.col("customer"), F.col("last_updated").desc(),
                    "distance_km", "fuel_price_per_liter", "seasonal_factor", "calculated_cost")
           .limit(10))
    return rounded(top)


# -- F. plans ----------------------------------------------------------------------

@register("plan_2x2")
def q_plan_2x2(spark, d):
    """Flagship: every lane pair of warehouses priced from the route features."""
    stats = lane_stats(spark, d)
    return rounded(plan_2x2(priced_pairs(stats), mode="python", keep=["warehouse_a", "warehouse_b"]))


@register("plan_2xn")
def q_plan_2xn(spark, d):
    return rounded(plan_2xn(plan_lines(lane_stats(spark, d))))


@register("plan_summary")
def q_plan_summary(spark, d):
    return rounded(plan_summary(plan_2xn(plan_lines(lane_stats(spark, d)))))


@register("plan_mx1")
def q_plan_mx1(spark, d):
    stats = lane_stats(spark, d)
    offers = (feat.merge_partials(stats).select("warehouse", "customer", F.col("composite_cost").alias("cost_per_unit"))
              .join(scen.warehouse_capacities(stats), "warehouse")
              .join(scen.customer_demands(stats), "customer"))
    return rounded(plan_mx1(offers))


# -- F/G. plan variants over lane-pair scenarios -------------------------------------

def _pairs(spark, d):
    return priced_pairs(lane_stats(spark, d))


def _no_fs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("fs_")])


def _plan_lines_named(spark, d):
    return plan_2xn(plan_lines(lane_stats(spark, d)), carry=["warehouse_a", "warehouse_b"])


@register("plan_feasibility")
def q_plan_feasibility(spark, d):
    s = plan_summary(plan_2xn(plan_lines(lane_stats(spark, d))))
    return rounded(s.select("scenario_name", "feasible", "total_demand",
                            (F.col("used_a") + F.col("used_b")).alias("total_shipped")))


@register("plan_infeasible")
def q_plan_infeasible(spark, d):
    sc = _pairs(spark, d)
    sc = sc.withColumn("warehouse_a_capacity", F.floor(F.col("warehouse_a_capacity") / 4)) \
           .withColumn("warehouse_b_capacity", F.floor(F.col("warehouse_b_capacity") / 4))
    return rounded(plan_2x2(sc).where(~F.col("feasible")))


@register("plan_errors")
def q_plan_errors(spark, d):
    sc = _pairs(spark, d)
    sc = sc.withColumn("use_feature_store", F.col("warehouse_a_capacity") % 2 == 0) \
           .withColumn("warehouse_b_capacity", F.when(F.col("warehouse_b_capacity") % 3 != 0,
                                                      F.col("warehouse_b_capacity")))
    return rounded(plan_2x2(sc))


@register("scenario_with_matrix")
def q_scenario_with_matrix(spark, d):
    stats = lane_stats(spark, d)
    sc = _no_fs(priced_pairs(stats))
    return rounded(plan_2x2(sc, features=feat.merge_partials(stats), routes=WIDE_ROUTES))


@register("resolve_feature_store")
def q_resolve_feature_store(spark, d):
    sc = _pairs(spark, d).withColumn("use_feature_store", F.lit(True))
    return rounded(plan_2x2(sc))


@register("resolve_override")
def q_resolve_override(spark, d):
    sc = (_pairs(spark, d).withColumn("use_feature_store", F.lit(True))
          .withColumn("cost_a_to_1", F.when(F.col("warehouse_a_capacity") >= F.col("warehouse_b_capacity"), F.lit(5.0)))
          .withColumn("cost_b_to_2", F.lit(4.0)))
    return rounded(plan_2x2(sc))


@register("resolve_override_only")
def q_resolve_override_only(spark, d):
    sc = (_pairs(spark, d).withColumn("use_feature_store", F.lit(False))
          .withColumn("cost_a_to_1", F.col("fs_cost_a_to_1")).withColumn("cost_b_to_2", F.col("fs_cost_b_to_2")))
    return rounded(plan_2x2(_no_fs(sc)))


@register("resolve_sql_input")
def q_resolve_sql_input(spark, d):
    sc = _pairs(spark, d)
    for c in ["cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2"]:
        sc = sc.withColumn(c, F.col(f"fs_{c}"))
    return rounded(plan_2x2(_no_fs(sc), mode="sql"))


@register("scenario_resolve_constraints")
def q_scenario_resolve_constraints(spark, d):
    base = {"warehouses": {WIDE_ROUTES[0]: 100, WIDE_ROUTES[1]: 80},
            "customers": {WIDE_ROUTES[2]: 70, WIDE_ROUTES[3]: 60}}
    sc = _pairs(spark, d).drop("customer_1_demand", "customer_2_demand")
    return rounded(plan_2x2(sc, routes=WIDE_ROUTES, base_constraints=base))


@register("scenario_casts")
def q_scenario_casts(spark, d):
    from .functions.casts import cast_scenarios
    sc = _pairs(spark, d)
    raw = sc.select(
        "scenario_name",
        (F.col("warehouse_a_capacity") / F.lit(3.0)).alias("warehouse_a_capacity"),
        F.col("warehouse_b_capacity").cast("string").alias("warehouse_b_capacity"),
        F.when(F.col("warehouse_a_capacity") % 2 == 0, F.concat(F.col("customer_1_demand").cast("string"), F.lit(".5")))
         .otherwise(F.col("customer_1_demand").cast("string")).alias("customer_1_demand"),
        F.col("fs_cost_a_to_1").cast("string").alias("cost_a_to_1"),
        F.date_format("fs_feature_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("feature_timestamp"))
    out = cast_scenarios(raw)
    return rounded(out.withColumn("_invalid_inputs", F.array_join("_invalid_inputs", ","))
                   .withColumnRenamed("_invalid_inputs", "invalid_inputs"))


@register("scenario_missing_costs")
def q_scenario_missing_costs(spark, d):
    """Scenarios priced by the lane between the two ends alone: a pair that trades one way, or not
    with a customer, really lacks those costs."""
    stats = lane_stats(spark, d)
    lanes = feat.finished(stats, LANE)
    c1, c2 = scen.FACT_WIDE_CUSTOMERS
    direct = lanes.groupBy("warehouse", "lane_warehouse").agg(
        F.max(F.when(F.col("customer") == c1, F.col("composite_cost"))).alias("c1"),
        F.max(F.when(F.col("customer") == c2, F.col("composite_cost"))).alias("c2"))
    a = direct.select(F.col("warehouse").alias("warehouse_a"), F.col("lane_warehouse").alias("warehouse_b"),
                      F.col("c1").alias("cost_a_to_1"), F.col("c2").alias("cost_a_to_2"))
    b = direct.select(F.col("warehouse").alias("warehouse_b"), F.col("lane_warehouse").alias("warehouse_a"),
                      F.col("c1").alias("cost_b_to_1"), F.col("c2").alias("cost_b_to_2"))
    sc = scen.fact_wide_scenarios(stats).join(a, ["warehouse_a", "warehouse_b"], "left").join(b, ["warehouse_a", "warehouse_b"], "left")
    return rounded(plan_2x2(sc, mode="sql", keep=["warehouse_a", "warehouse_b"]))


@register("scenario_default_name")
def q_scenario_default_name(spark, d):
    sc = _pairs(spark, d).withColumn(
        "scenario_name", F.when(F.col("warehouse_a_capacity") % 2 == 0, F.col("scenario_name")))
    return rounded(plan_2x2(sc, keep=["warehouse_a", "warehouse_b"], order_by=["warehouse_a", "warehouse_b"]))


# -- reports -------------------------------------------------------------------------

@register("warehouse_utilization")
def q_warehouse_utilization(spark, d):
    from .operators.reports import warehouse_utilization
    return rounded(warehouse_utilization(_plan_lines_named(spark, d)))


@register("customer_satisfaction")
def q_customer_satisfaction(spark, d):
    from .operators.reports import customer_satisfaction
    return rounded(customer_satisfaction(_plan_lines_named(spark, d)))


@register("shipments_nonzero")
def q_shipments_nonzero(spark, d):
    from .operators.reports import shipments_nonzero
    return rounded(shipments_nonzero(_plan_lines_named(spark, d)))


@register("plan_detail")
def q_plan_detail(spark, d):
    from .operators.reports import plan_detail
    return rounded(plan_detail(plan_2x2(_pairs(spark, d))))


@register("plan_summary_line")
def q_plan_summary_line(spark, d):
    from .operators.reports import summary_line
    sc = _pairs(spark, d).withColumn("warehouse_a_capacity", F.floor(F.col("warehouse_a_capacity") / 4)) \
        .withColumn("warehouse_b_capacity", F.floor(F.col("warehouse_b_capacity") / 4))
    return summary_line(plan_2x2(sc))


def _mixed_sources(spark, d):
    sc = (_pairs(spark, d).withColumn("use_feature_store", F.col("warehouse_a_capacity") % 2 == 0)
          .withColumn("cost_a_to_1", F.when(F.col("warehouse_b_capacity") % 3 == 0, F.col("fs_cost_a_to_1") * 0.5)))
    return plan_2x2(sc)


@register("plan_source_counts")
def q_plan_source_counts(spark, d):
    from .operators.reports import source_counts
    return source_counts(_mixed_sources(spark, d))


def _limits(spark, d):
    """Route costs, capacities and demands over the whole fact table, from one pass."""
    stats = lane_stats(spark, d)
    costs = feat.merge_partials(stats).select("warehouse", "customer", F.col("composite_cost").alias("cost_per_unit"))
    return costs, stats


@register("routes_with_constraints")
def q_routes_with_constraints(spark, d):
    from .operators.reports import routes_with_constraints
    costs, stats = _limits(spark, d)
    return rounded(routes_with_constraints(costs, scen.warehouse_capacities(stats), scen.customer_demands(stats)))


@register("constraint_mismatches")
def q_constraint_mismatches(spark, d):
    """Routes against the limits of the places that receive: warehouses that only ship, or only receive."""
    from .operators.reports import unmatched_constraints
    costs, stats = _limits(spark, d)
    received = scen.warehouse_capacities(stats.where("n >= 5").select(F.col("lane_warehouse").alias("warehouse"), "n"))
    return unmatched_constraints(costs, received, scen.customer_demands(stats.where("lane_warehouse = warehouse")))


# -- H. SQL surface -------------------------------------------------------------------

def _sql_views(spark, d):
    from .functions.sql import register_sql_functions
    register_sql_functions(spark)
    stats = lane_stats(spark, d)
    feat.merge_partials(stats).createOrReplaceTempView("cost_matrix_features_v1_0")
    priced_pairs(stats).createOrReplaceTempView("lane_scenarios")


@register("plan_sql_function")
def q_plan_sql_function(spark, d):
    _sql_views(spark, d)
    return rounded(spark.sql("""
        SELECT r.* FROM (
          SELECT optimize_transport(scenario_name, warehouse_a_capacity, warehouse_b_capacity,
                                    customer_1_demand, customer_2_demand, fs_cost_a_to_1, fs_cost_a_to_2,
                                    fs_cost_b_to_1, fs_cost_b_to_2, fs_feature_timestamp) AS r
          FROM lane_scenarios)"""))


@register("batch_optimize_sql")
def q_batch_optimize_sql(spark, d):
    from .plans.batch_sql import batch_optimize_sql
    _sql_views(spark, d)
    scen.batch_scenarios(spark)
    return rounded(batch_optimize_sql(spark, "cost_matrix_features_v1_0", "transportation_scenarios",
                                      WIDE_ROUTES).drop("result"))


@register("result_extract")
def q_result_extract(spark, d):
    _sql_views(spark, d)
    return rounded(spark.sql("""
        WITH stored AS (
          SELECT to_json(optimize_transport(scenario_name, warehouse_a_capacity, warehouse_b_capacity,
                                            customer_1_demand, customer_2_demand, fs_cost_a_to_1, fs_cost_a_to_2,
                                            fs_cost_b_to_1, fs_cost_b_to_2, fs_feature_timestamp)) AS result_json
          FROM lane_scenarios),
        parsed AS (SELECT parse_json(result_json) AS result FROM stored)
        SELECT variant_get(result, '$.scenario_name', 'string') AS result_scenario_name,
               variant_get(result, '$.optimal_cost', 'double') AS optimal_cost,
               variant_get(result, '$.shipment_a_to_1', 'double') AS shipment_a_to_1,
               variant_get(result, '$.shipment_a_to_2', 'double') AS shipment_a_to_2,
               variant_get(result, '$.shipment_b_to_1', 'double') AS shipment_b_to_1,
               variant_get(result, '$.shipment_b_to_2', 'double') AS shipment_b_to_2,
               variant_get(result, '$.warehouse_a_utilization', 'double') AS warehouse_a_utilization,
               variant_get(result, '$.warehouse_b_utilization', 'double') AS warehouse_b_utilization,
               variant_get(result, '$.feasible', 'boolean') AS feasible
        FROM parsed"""))


@register("what_if_override")
def q_what_if_override(spark, d):
    _sql_views(spark, d)
    wa, wb, c1, c2 = WIDE_ROUTES

    def cost(w, c):
        return (f"(SELECT MAX(CASE WHEN warehouse = '{w}' AND customer = '{c}' THEN composite_cost END) "
                f"FROM cost_matrix_features_v1_0)")
    return rounded(spark.sql(f"""
        SELECT s.scenario_name, r.optimal_cost, r.feasible, r.shipment_a_to_1, r.shipment_a_to_2,
               r.shipment_b_to_1, r.shipment_b_to_2
        FROM (SELECT scenario_name,
                     optimize_transport(scenario_name, warehouse_a_capacity, warehouse_b_capacity,
                                        customer_1_demand, customer_2_demand,
                                        7.5D,                -- override of route A -> 1
                                        {cost(wa, c2)}, {cost(wb, c1)}, {cost(wb, c2)},
                                        (SELECT MAX(feature_timestamp) FROM cost_matrix_features_v1_0)) AS r
              FROM lane_scenarios) s"""))


@register("scenario_cross_features")
def q_scenario_cross_features(spark, d):
    """Per-scenario matrix of the late-aggregating form (scenarios x feature
    rows, grouped back per scenario). Every group sees the same feature rows,
    so the result equals the one-row matrix; it is computed that way (a global
    aggregate attached as merged scalar subqueries) without materialising
    scenarios x features."""
    stats = lane_stats(spark, d)
    m = matrix.cost_matrix_wide(feat.merge_partials(stats), WIDE_ROUTES)
    sc = scen.fact_wide_scenarios(stats)
    return rounded(sc.select("scenario_name", "warehouse_a_capacity", "warehouse_b_capacity",
                             "customer_1_demand", "customer_2_demand",
                             *[m.select(c).scalar().alias(c) for c in m.columns]))


# -- C4/C5/G8/B7. point in time ----------------------------------------------------------

@register("features_on_date")
def q_features_on_date(spark, d):
    # only observations that the day's snapshot can cover: the range reaches the orders scan
    seen = F.col("last_updated")
    day = feat.ts_literal("2000-07-01")
    near = facts(spark, d).where((seen >= day - F.make_dt_interval(F.lit(feat.LOOKBACK_DAYS))) & (seen < day + F.expr("INTERVAL 1 DAY")))
    return rounded(feat.day_filter(asof.monthly_snapshots(near), "2000-07-01", ts_col="snapshot_ts"))


@register("feature_asof")
def q_feature_asof(spark, d):
    seen = observations(spark, d)
    snaps = asof.snapshots_from_partials(seen).select("warehouse", "customer", "snapshot_ts", "composite_cost", "sample_count")
    spine = seen.select("warehouse", "customer", (F.col("last_updated") + F.expr("INTERVAL 10 DAYS")).alias("ts"))
    return rounded(asof.asof_join(spine, snaps, ["warehouse", "customer"]))


@register("feature_recompute_asof")
def q_feature_recompute_asof(spark, d):
    seen = observations(spark, d)
    spine = seen.select("warehouse", "customer",
                        (F.date_trunc("month", "last_updated").cast("timestamp_ntz")
                         + F.expr("INTERVAL 14 DAYS 12 HOURS")).alias("ts")).distinct()
    return rounded(asof.recompute_from_partials(spine, seen))


@register("resolve_asof")
def q_resolve_asof(spark, d):
    """Scenarios priced with the features as of their own timestamp. Scenarios and snapshots
    come from one table of partials; only routes that a scenario looks up get snapshots."""
    seen = span_observations(spark, d, LANE)
    stats = hand_off(feat.roll_up_partials(seen, LANE), "lane-stats")
    sc = scen.fact_wide_scenarios(stats).withColumn(
        "feature_timestamp", F.lit("1996-01-01").cast("timestamp_ntz")
        + F.make_dt_interval(F.col("warehouse_a_capacity") % 1500))
    c1, c2 = scen.FACT_WIDE_CUSTOMERS
    spine = sc.select("scenario_name", F.col("feature_timestamp").alias("ts"), F.inline(F.array(
        F.struct(F.lit("cost_a_to_1").alias("slot"), F.col("warehouse_a").alias("warehouse"), F.lit(c1).alias("customer")),
        F.struct(F.lit("cost_a_to_2").alias("slot"), F.col("warehouse_a").alias("warehouse"), F.lit(c2).alias("customer")),
        F.struct(F.lit("cost_b_to_1").alias("slot"), F.col("warehouse_b").alias("warehouse"), F.lit(c1).alias("customer")),
        F.struct(F.lit("cost_b_to_2").alias("slot"), F.col("warehouse_b").alias("warehouse"), F.lit(c2).alias("customer")))))
    wanted = seen.join(spine.select("warehouse", "customer").distinct(), ["warehouse", "customer"], "left_semi")
    snaps = asof.snapshots_from_partials(wanted).select("warehouse", "customer", "snapshot_ts", "composite_cost")
    found = asof.asof_join(spine, snaps, ["warehouse", "customer"])
    costs = found.groupBy("scenario_name").agg(
        *[F.max(F.when(F.col("slot") == c, F.col("composite_cost"))).alias(f"fs_{c}")
          for c in ["cost_a_to_1", "cost_a_to_2", "cost_b_to_1", "cost_b_to_2"]])
    return rounded(plan_2x2(sc.join(costs, "scenario_name", "left"), keep=["warehouse_a", "warehouse_b"]))


# -- A. files, feature store, streaming ---------------------------------------------------

@register("constraints_json")
def q_constraints_json(spark, d):
    from .sources.files import read_constraints_json, write_constraints_json
    counts = facts(spark, d).withColumn("n", F.lit(1))
    path = run_path(spark, "constraints_json")
    write_constraints_json(scen.warehouse_capacities(counts), scen.customer_demands(counts), path)
    caps, dems = read_constraints_json(spark, path)
    return (caps.select(F.lit("warehouse").alias("party"), F.col("warehouse").alias("name"),
                        F.col("capacity").alias("value"))
            .unionByName(dems.select(F.lit("customer").alias("party"), F.col("customer").alias("name"),
                                     F.col("demand").alias("value"))))


@register("route_costs_csv")
def q_route_costs_csv(spark, d):
    from .sources.files import read_route_costs_csv, write_route_costs_csv
    costs = feat.route_features(facts(spark, d)).select(
        "warehouse", "customer", F.col("composite_cost").alias("cost_per_unit"))
    path = run_path(spark, "route_costs_csv")
    write_route_costs_csv(costs, path)
    return rounded(read_route_costs_csv(spark, path))


@register("feature_publish")
def q_feature_publish(spark, d):
    from .sources.files import publish_features, read_features
    base = run_path(spark, "feature_store")
    publish_features(feat.route_features(facts(spark, d)), base)
    return rounded(read_features(spark, base))


@register("feature_read")
def q_feature_read(spark, d):
    from .sources.files import publish_features
    base = run_path(spark, "feature_store_read")
    view = publish_features(feat.route_features(facts(spark, d)), base)
    return rounded(spark.table(view).drop("version"))


@register("feature_lookup")
def q_feature_lookup(spark, d):
    """Spine of (customer-nation warehouse, customer) routes; routes without
    features keep null feature values."""
    stats = lane_stats(spark, d)
    spine = stats.select(F.col("lane_warehouse").alias("warehouse"), "customer").distinct()
    return rounded(feat.feature_lookup(spine, feat.merge_partials(stats)))


@register("rolling_features_30d")
def q_rolling_features_30d(spark, d):
    from .streaming.daily import daily_partials, rolling_features
    return rounded(rolling_features(daily_partials(facts(spark, d))))


@register("stream_daily_features")
def q_stream_daily_features(spark, d):
    """Facts written as files, consumed by the streaming job (available-now
    trigger); the days still open behind the watermark are merged in."""
    from .schemas import FACT_SCHEMA
    from .sources.fact import create_fact_table
    from .streaming.daily import daily_features, run_daily_partials, with_open_days
    run = run_path(spark, "stream_daily")
    create_fact_table(facts(spark, d), f"{run}/facts", partition_by_day=False)
    run_daily_partials(spark, f"{run}/facts", FACT_SCHEMA, f"{run}/daily", f"{run}/checkpoint")
    written = spark.read.schema(FACT_SCHEMA).parquet(f"{run}/facts")
    return rounded(daily_features(with_open_days(spark.read.parquet(f"{run}/daily"), written)))


@register("stream_rolling_features")
def q_stream_rolling_features(spark, d):
    """Rolling features from the store that a stream of two micro-batches has filled, in
    whatever order the files came (the allowed lateness spans the table). A file has some
    FILE_ROWS rows, so that the tasks that write them read no more the larger the table is."""
    from .schemas import FACT_SCHEMA
    from .sources.fact import create_fact_table
    from .streaming.daily import rolling_features
    from .streaming.upsert import compact, read_days, run_upserts
    run = run_path(spark, "stream_rolling")
    files = max(6, -(-table(spark, d, "lineitem").count() // FILE_ROWS))
    create_fact_table(facts(spark, d).repartition(files, "distance_km", "last_updated"), f"{run}/facts", partition_by_day=False)
    run_upserts(spark, f"{run}/facts", FACT_SCHEMA, f"{run}/store", f"{run}/checkpoint", lateness_days=20000, files_per_batch=-(-files // 2))
    compact(spark, f"{run}/store", 0)
    return rounded(rolling_features(read_days(spark, f"{run}/store")))


@register("stream_late_rows")
def q_stream_late_rows(spark, d):
    """Newer facts first, then the older ones, which come too late: rows in time (from the day
    store) and late rows (from the side folder) of each route."""
    from .schemas import FACT_SCHEMA
    from .streaming.upsert import read_days, read_late, run_upserts
    run = run_path(spark, "stream_late")
    rows = facts(spark, d)
    for part in (F.col("last_updated") >= feat.ts_literal("1995-01-01"), F.col("last_updated") < feat.ts_literal("1995-01-01")):
        rows.where(part).write.mode("append").parquet(f"{run}/facts")
        run_upserts(spark, f"{run}/facts", FACT_SCHEMA, f"{run}/store", f"{run}/checkpoint")
    on_time = read_days(spark, f"{run}/store").select("warehouse", "customer", F.col("n").alias("n_on_time"), F.lit(0).cast("long").alias("n_late"))
    late = read_late(spark, f"{run}/store", FACT_SCHEMA).select("warehouse", "customer", F.lit(0).cast("long").alias("n_on_time"), F.lit(1).cast("long").alias("n_late"))
    return on_time.unionByName(late).groupBy("warehouse", "customer").agg(F.sum("n_on_time").alias("n_on_time"), F.sum("n_late").alias("n_late"))


@register("stream_scenarios")
def q_stream_scenarios(spark, d):
    """Lane-pair scenarios arriving as a file stream, planned against static
    per-warehouse feature costs."""
    from .streaming.daily import stream_plans
    run = run_path(spark, "stream_scenarios")
    stats = lane_stats(spark, d)
    sc = scen.fact_wide_scenarios(stats)
    sc.write.mode("overwrite").parquet(f"{run}/scenarios")
    costs = matrix.costs_by_warehouse(feat.merge_partials(stats), scen.FACT_WIDE_CUSTOMERS)
    stream = spark.readStream.schema(sc.schema).parquet(f"{run}/scenarios")
    q = (stream_plans(stream, costs).writeStream.format("parquet").option("path", f"{run}/plans")
         .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return rounded(spark.read.parquet(f"{run}/plans"))
