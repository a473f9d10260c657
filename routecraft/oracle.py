"""Oracle SQL (DuckDB dialect) for the registered queries.

Written independently of the Spark code, from the written definitions of the
fact mapping and of each operator; the correctness check runs both sides over
the same parquet tables and compares rows.
"""

FACT = """
fact AS (
SELECT concat('Warehouse_', lpad(CAST(s_nationkey AS VARCHAR), 2, '0')) AS warehouse,
       concat('Customer_', c_mktsegment) AS customer,
       CAST(20 + 7*abs(s_nationkey - c_nationkey) AS DOUBLE) + CAST(l_suppkey % 13 AS DOUBLE)/7E0 AS distance_km,
       1.2E0 + CAST(l_partkey % 21 AS DOUBLE)/97E0 AS fuel_price_per_liter,
       CAST(8 + 2*(l_linenumber % 3) AS DOUBLE) AS vehicle_capacity_tons,
       7.5E-1 + 5E-2*CAST(s_nationkey % 3 AS DOUBLE) AS base_rate_per_km,
       (CAST(20 + 7*abs(s_nationkey - c_nationkey) AS DOUBLE) + CAST(l_suppkey % 13 AS DOUBLE)/7E0)/53E0 AS travel_time_hours,
       9E-1 + 1E-1*CAST(l_suppkey % 5 AS DOUBLE) AS road_condition_factor,
       9E-1 + CAST(month(o_orderdate) % 5 AS DOUBLE)/19E0 AS seasonal_factor,
       CASE o_orderpriority WHEN '1-URGENT' THEN 1.2E0 WHEN '2-HIGH' THEN 1.1E0 ELSE 1E0 END AS priority_multiplier,
       o_orderdate AS last_updated,
       concat('Warehouse_', lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS lane_warehouse
FROM lineitem
JOIN orders   ON l_orderkey = o_orderkey
JOIN customer ON o_custkey  = c_custkey
JOIN supplier ON l_suppkey  = s_suppkey
)"""

# per-row cost terms, as SQL text over the fact columns
DIST = "(distance_km * base_rate_per_km * road_condition_factor)"
FUEL = "((distance_km / (8E0 * (vehicle_capacity_tons / 10E0) * (1E0 / road_condition_factor))) * fuel_price_per_liter)"
TIME = "(travel_time_hours * 25E0 * 3E-1)"
CAPF = "(10E0 / vehicle_capacity_tons)"
COMP = f"(({DIST} + {FUEL} + {TIME}) * {CAPF} * seasonal_factor * priority_multiplier)"

FEATURE_SELECT = f"""
SELECT warehouse, customer,
       round(avg({DIST}), 6) AS avg_distance_cost,
       round(avg({FUEL}), 6) AS avg_fuel_cost,
       round(avg({TIME}), 6) AS avg_time_cost,
       round(avg({CAPF}), 6) AS avg_capacity_factor,
       round(avg(seasonal_factor), 6) AS avg_seasonal_factor,
       round(avg(priority_multiplier), 6) AS avg_priority_factor,
       round(avg({COMP}), 6) AS composite_cost,
       round(stddev_samp(fuel_price_per_liter), 6) AS fuel_price_volatility,
       round(min(fuel_price_per_liter), 6) AS min_fuel_price,
       round(max(fuel_price_per_liter), 6) AS max_fuel_price,
       count(*) AS sample_count,
       max(last_updated) AS feature_timestamp
FROM fact"""

# route composite cost per (warehouse, customer), unrounded, all time
ROUTES = f"""
routes AS (SELECT warehouse, customer, avg({COMP}) AS cc, max(last_updated) AS ts
           FROM fact GROUP BY warehouse, customer)"""
CAPS = """
caps AS (SELECT warehouse, count(*) AS cap FROM fact GROUP BY warehouse)"""
PAIRS = """
pairs AS (SELECT DISTINCT least(warehouse, lane_warehouse) AS wa, greatest(warehouse, lane_warehouse) AS wb
          FROM fact WHERE warehouse <> lane_warehouse)"""
DEMAND = """
dem AS (SELECT customer, floor(count(*) / 20) AS demand FROM fact GROUP BY customer)"""
SCEN = """
sc AS (SELECT p.wa || '_vs_' || p.wb AS scenario_name, p.wa, p.wb, ca.cap AS capacity_a, cb.cap AS capacity_b
       FROM pairs p JOIN caps ca ON ca.warehouse = p.wa JOIN caps cb ON cb.warehouse = p.wb)"""

# two-customer scenario rows s(scenario_name, wa, wb, ka, kb, d1, d2, ca1, ca2, cb1, cb2, ts)
WIDE_SCEN = f"""{ROUTES},{CAPS},{PAIRS},{SCEN},
dem2 AS (SELECT floor(sum(CASE WHEN customer = 'Customer_AUTOMOBILE' THEN 1 ELSE 0 END) / 20) AS d1,
                floor(sum(CASE WHEN customer = 'Customer_BUILDING' THEN 1 ELSE 0 END) / 20) AS d2 FROM fact),
byw AS (SELECT warehouse,
               max(CASE WHEN customer = 'Customer_AUTOMOBILE' THEN cc END) AS c1,
               max(CASE WHEN customer = 'Customer_BUILDING' THEN cc END) AS c2,
               max(ts) AS ts
        FROM routes GROUP BY warehouse),
s AS (SELECT sc.scenario_name, sc.wa, sc.wb, sc.capacity_a AS ka, sc.capacity_b AS kb, dem2.d1, dem2.d2,
             a.c1 AS ca1, a.c2 AS ca2, b.c1 AS cb1, b.c2 AS cb2, greatest(a.ts, b.ts) AS ts
      FROM sc CROSS JOIN dem2 LEFT JOIN byw a ON a.warehouse = sc.wa LEFT JOIN byw b ON b.warehouse = sc.wb)"""


def solve_2x2_sql(src: str) -> str:
    """CTEs r1..r3 solving every row of ``src`` (ka, kb, d1, d2, ca1..cb2, err)."""
    return f"""
r1 AS (SELECT *, greatest(CAST(d1 AS DOUBLE), 0) AS e1, greatest(CAST(d2 AS DOUBLE), 0) AS e2,
              ca1 - cb1 AS p1, ca2 - cb2 AS p2 FROM {src}),
r2 AS (SELECT *, least(greatest((CASE WHEN p1 < 0 THEN e1 ELSE 0 END) + (CASE WHEN p2 < 0 THEN e2 ELSE 0 END),
                                e1 + e2 - kb, 0), ka, e1 + e2) AS t,
              coalesce(err IS NULL AND ka >= 0 AND kb >= 0 AND e1 + e2 <= ka + kb, false) AS ok FROM r1),
r3 AS (SELECT *, CASE WHEN p1 <= p2 THEN least(e1, t) ELSE t - least(e2, t) END AS x1 FROM r2)"""


PLAN_2X2_COLUMNS = """
       CASE WHEN ok THEN round(ca1 * x1 + ca2 * (t - x1) + cb1 * (e1 - x1) + cb2 * (e2 - (t - x1)), 6) END AS optimal_cost,
       ok AS feasible,
       CASE WHEN ok THEN round(x1, 6) ELSE 0 END AS shipment_a_to_1,
       CASE WHEN ok THEN round(t - x1, 6) ELSE 0 END AS shipment_a_to_2,
       CASE WHEN ok THEN round(e1 - x1, 6) ELSE 0 END AS shipment_b_to_1,
       CASE WHEN ok THEN round(e2 - (t - x1), 6) ELSE 0 END AS shipment_b_to_2,
       CASE WHEN ok THEN round(coalesce(t / nullif(ka, 0) * 100, 0), 6) ELSE 0 END AS warehouse_a_utilization,
       CASE WHEN ok THEN round(coalesce((e1 + e2 - t) / nullif(kb, 0) * 100, 0), 6) ELSE 0 END AS warehouse_b_utilization"""

LINES_2XN = f"""{ROUTES},{CAPS},{PAIRS},{SCEN},{DEMAND},
lines AS (SELECT sc.scenario_name, dem.customer, ra.cc AS cost_from_a, rb.cc AS cost_from_b
          FROM sc CROSS JOIN dem LEFT JOIN routes ra ON ra.warehouse = sc.wa AND ra.customer = dem.customer
                                 LEFT JOIN routes rb ON rb.warehouse = sc.wb AND rb.customer = dem.customer),
l2 AS (SELECT lines.*, greatest(CAST(dem.demand AS DOUBLE), 0) AS demand,
              CAST(sc.capacity_a AS DOUBLE) AS capacity_a, CAST(sc.capacity_b AS DOUBLE) AS capacity_b,
              cost_from_a - cost_from_b AS p
       FROM lines JOIN dem ON dem.customer = lines.customer JOIN sc ON sc.scenario_name = lines.scenario_name),
agg AS (SELECT scenario_name, sum(demand) AS tot, sum(CASE WHEN p < 0 THEN demand ELSE 0 END) AS want,
               max(capacity_a) AS ka, max(capacity_b) AS kb,
               count(*) FILTER (WHERE cost_from_a IS NULL OR cost_from_b IS NULL) AS missing,
               count(*) FILTER (WHERE cost_from_a < 0 OR cost_from_b < 0) AS neg
        FROM l2 GROUP BY scenario_name),
agg2 AS (SELECT scenario_name,
                CASE WHEN missing > 0 THEN 'route cost missing' WHEN neg > 0 THEN 'negative route cost' END AS error,
                least(greatest(want, tot - kb, 0), ka, tot) AS t,
                (missing = 0 AND neg = 0 AND ka >= 0 AND kb >= 0 AND tot <= ka + kb) AS feasible
         FROM agg),
w AS (SELECT l2.*, agg2.error, agg2.t, agg2.feasible,
             coalesce(sum(demand) OVER (PARTITION BY l2.scenario_name ORDER BY p, customer
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM l2 JOIN agg2 ON agg2.scenario_name = l2.scenario_name),
pl AS (SELECT scenario_name, customer, demand, cost_from_a, cost_from_b, capacity_a, capacity_b, feasible, error,
              CASE WHEN feasible THEN greatest(0, least(demand, t - before)) ELSE 0 END AS shipment_from_a,
              CASE WHEN feasible THEN demand - greatest(0, least(demand, t - before)) ELSE 0 END AS shipment_from_b
       FROM w),
plan AS (SELECT *, CASE WHEN feasible THEN cost_from_a * shipment_from_a + cost_from_b * shipment_from_b END AS line_cost
         FROM pl)"""


ORACLE: dict[str, str] = {}

ORACLE["fact_scan"] = f"""WITH {FACT}
SELECT warehouse, customer, distance_km, fuel_price_per_liter, vehicle_capacity_tons, base_rate_per_km,
       travel_time_hours, road_condition_factor, seasonal_factor, priority_multiplier, last_updated FROM fact"""

ORACLE["route_cost_components"] = f"""WITH {FACT}
SELECT warehouse, customer, last_updated, round({DIST}, 6) AS distance_cost, round({FUEL}, 6) AS fuel_cost,
       round({TIME}, 6) AS time_cost, round({CAPF}, 6) AS capacity_factor FROM fact"""

ORACLE["route_composite_cost"] = f"""WITH {FACT}
SELECT warehouse, customer, last_updated, round({COMP}, 6) AS calculated_cost FROM fact"""

ORACLE["features_all"] = f"WITH {FACT} {FEATURE_SELECT} GROUP BY warehouse, customer"
ORACLE["features_from_partials"] = ORACLE["features_all"]

ORACLE["features_30d"] = f"""WITH {FACT} {FEATURE_SELECT}
WHERE last_updated >= TIMESTAMP '2000-07-02 00:00:00' - INTERVAL 30 DAY
  AND last_updated <= TIMESTAMP '2000-07-02 00:00:00'
GROUP BY warehouse, customer"""

ORACLE["cost_matrix_wide"] = f"""WITH {FACT}, {ROUTES}
SELECT round(max(CASE WHEN warehouse = 'Warehouse_00' AND customer = 'Customer_AUTOMOBILE' THEN cc END), 6) AS cost_a_to_1,
       round(max(CASE WHEN warehouse = 'Warehouse_00' AND customer = 'Customer_BUILDING' THEN cc END), 6) AS cost_a_to_2,
       round(max(CASE WHEN warehouse = 'Warehouse_01' AND customer = 'Customer_AUTOMOBILE' THEN cc END), 6) AS cost_b_to_1,
       round(max(CASE WHEN warehouse = 'Warehouse_01' AND customer = 'Customer_BUILDING' THEN cc END), 6) AS cost_b_to_2,
       max(ts) AS feature_timestamp
FROM routes"""

ORACLE["cost_matrix_pivot"] = f"""WITH {FACT}, {ROUTES}
SELECT warehouse,
       round(max(CASE WHEN customer = 'Customer_AUTOMOBILE' THEN cc END), 6) AS "Customer_AUTOMOBILE",
       round(max(CASE WHEN customer = 'Customer_BUILDING' THEN cc END), 6) AS "Customer_BUILDING",
       round(max(CASE WHEN customer = 'Customer_FURNITURE' THEN cc END), 6) AS "Customer_FURNITURE",
       round(max(CASE WHEN customer = 'Customer_HOUSEHOLD' THEN cc END), 6) AS "Customer_HOUSEHOLD",
       round(max(CASE WHEN customer = 'Customer_MACHINERY' THEN cc END), 6) AS "Customer_MACHINERY"
FROM routes GROUP BY warehouse"""

ORACLE["cost_matrix_long"] = f"""WITH {FACT}, {ROUTES}
SELECT warehouse, customer, round(cc, 6) AS cost_per_unit FROM routes"""

ORACLE["route_costs_dedup"] = f"""WITH {FACT}
SELECT DISTINCT warehouse, customer, {COMP} AS cost_per_unit FROM fact"""

ORACLE["latest_costs_top10"] = f"""WITH {FACT},
top AS (SELECT warehouse, customer, distance_km, fuel_price_per_liter, seasonal_factor, {COMP} AS calculated_cost,
               last_updated
        FROM fact
        ORDER BY warehouse, customer, last_updated DESC, distance_km, fuel_price_per_liter, seasonal_factor,
                 calculated_cost
        LIMIT 10)
SELECT warehouse, customer, round(distance_km, 6) AS distance_km, round(fuel_price_per_liter, 6) AS fuel_price_per_liter,
       round(seasonal_factor, 6) AS seasonal_factor, round(calculated_cost, 6) AS calculated_cost, last_updated
FROM top"""

ORACLE["plan_2x2"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT *, CASE WHEN ca1 IS NULL OR ca2 IS NULL OR cb1 IS NULL OR cb2 IS NULL THEN 'missing' END AS err FROM s),
{solve_2x2_sql('src')}
SELECT wa AS warehouse_a, wb AS warehouse_b, scenario_name, {PLAN_2X2_COLUMNS},
       CASE WHEN err IS NULL THEN 'feature_store' ELSE 'error' END AS cost_matrix_source,
       ts AS feature_timestamp, 'python' AS execution_mode, CAST(NULL AS VARCHAR) AS error
FROM r3"""

ORACLE["plan_2xn"] = f"""WITH {FACT}, {LINES_2XN}
SELECT scenario_name, customer, round(demand, 6) AS demand, round(cost_from_a, 6) AS cost_from_a,
       round(cost_from_b, 6) AS cost_from_b, round(capacity_a, 6) AS capacity_a, round(capacity_b, 6) AS capacity_b,
       feasible, error, round(shipment_from_a, 6) AS shipment_from_a, round(shipment_from_b, 6) AS shipment_from_b,
       round(line_cost, 6) AS line_cost
FROM plan"""

ORACLE["plan_summary"] = f"""WITH {FACT}, {LINES_2XN}
SELECT scenario_name, round(sum(line_cost), 6) AS optimal_cost, bool_and(feasible) AS feasible, max(error) AS error,
       round(sum(shipment_from_a), 6) AS used_a, round(sum(shipment_from_b), 6) AS used_b,
       round(sum(demand), 6) AS total_demand,
       round(sum(shipment_from_a) / nullif(max(capacity_a), 0) * 100, 6) AS utilization_a,
       round(sum(shipment_from_b) / nullif(max(capacity_b), 0) * 100, 6) AS utilization_b
FROM plan GROUP BY scenario_name"""

ORACLE["plan_mx1"] = f"""WITH {FACT}, {ROUTES}, {CAPS}, {DEMAND},
o AS (SELECT routes.customer, routes.warehouse, routes.cc AS cost_per_unit,
             greatest(CAST(caps.cap AS DOUBLE), 0) AS capacity, greatest(CAST(dem.demand AS DOUBLE), 0) AS demand
      FROM routes JOIN caps ON caps.warehouse = routes.warehouse JOIN dem ON dem.customer = routes.customer),
w AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY customer ORDER BY cost_per_unit, warehouse
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(capacity) OVER (PARTITION BY customer) >= demand AS feasible
      FROM o)
SELECT customer, warehouse, round(cost_per_unit, 6) AS cost_per_unit, round(capacity, 6) AS capacity,
       round(demand, 6) AS demand, feasible,
       round(CASE WHEN feasible THEN greatest(0, least(capacity, demand - before)) ELSE 0 END, 6) AS shipment
FROM w"""



def plan_out(src: str, keep: str = "") -> str:
    """Plan-result columns from CTE ``src`` with: scenario_name, ka, kb, d1, d2,
    ca1, ca2, cb1, cb2 (resolved), ts, err, source, mode (+ ``keep``)."""
    return f"""{solve_2x2_sql(src)}
SELECT {keep} scenario_name, {PLAN_2X2_COLUMNS},
       CASE WHEN err IS NULL THEN source ELSE 'error' END AS cost_matrix_source,
       ts AS feature_timestamp, mode AS execution_mode, err AS error
FROM r3"""


NO_TS = "CAST(NULL AS TIMESTAMP)"
USE_FS_MSG = "'feature costs switched off and no cost column given'"
MISSING_FEATURE = """CASE WHEN ca1 IS NULL OR ca2 IS NULL OR cb1 IS NULL OR cb2 IS NULL THEN
  'route without features: ' || array_to_string(list_filter([CASE WHEN ca1 IS NULL THEN 'cost_a_to_1' END,
      CASE WHEN ca2 IS NULL THEN 'cost_a_to_2' END, CASE WHEN cb1 IS NULL THEN 'cost_b_to_1' END,
      CASE WHEN cb2 IS NULL THEN 'cost_b_to_2' END], lambda x: x IS NOT NULL), ', ') END"""
SQL_MISSING = """CASE WHEN ca1 IS NULL OR ca2 IS NULL OR cb1 IS NULL OR cb2 IS NULL THEN
  'pre-joined costs without a value: ' || array_to_string(list_filter([CASE WHEN ca1 IS NULL THEN 'cost_a_to_1' END,
      CASE WHEN ca2 IS NULL THEN 'cost_a_to_2' END, CASE WHEN cb1 IS NULL THEN 'cost_b_to_1' END,
      CASE WHEN cb2 IS NULL THEN 'cost_b_to_2' END], lambda x: x IS NOT NULL), ', ') END"""
GLOBAL_M = """
gm AS (SELECT max(CASE WHEN warehouse = 'Warehouse_00' AND customer = 'Customer_AUTOMOBILE' THEN cc END) AS g1,
              max(CASE WHEN warehouse = 'Warehouse_00' AND customer = 'Customer_BUILDING' THEN cc END) AS g2,
              max(CASE WHEN warehouse = 'Warehouse_01' AND customer = 'Customer_AUTOMOBILE' THEN cc END) AS g3,
              max(CASE WHEN warehouse = 'Warehouse_01' AND customer = 'Customer_BUILDING' THEN cc END) AS g4,
              max(ts) AS gts
       FROM routes)"""

ORACLE["plan_infeasible"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT scenario_name, floor(ka / 4) AS ka, floor(kb / 4) AS kb, d1, d2, ca1, ca2, cb1, cb2, ts,
               {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s),
{plan_out('src').replace('FROM r3', 'FROM r3 WHERE NOT ok')}"""

ORACLE["plan_errors"] = f"""WITH {FACT}, {WIDE_SCEN},
s2 AS (SELECT scenario_name, ka, CASE WHEN kb % 3 <> 0 THEN kb END AS kb, d1, d2, ca1, ca2, cb1, cb2, ts,
              ka % 2 = 0 AS use_fs FROM s),
src AS (SELECT *, CASE WHEN kb IS NULL THEN 'warehouse_b_capacity has no value'
                       WHEN NOT use_fs THEN {USE_FS_MSG}
                       ELSE {MISSING_FEATURE} END AS err,
               CASE WHEN use_fs THEN 'feature_store' ELSE 'error' END AS source, 'python' AS mode FROM s2),
{plan_out('src')}"""

ORACLE["scenario_with_matrix"] = f"""WITH {FACT}, {WIDE_SCEN}, {GLOBAL_M},
s2 AS (SELECT scenario_name, ka, kb, d1, d2, g1 AS ca1, g2 AS ca2, g3 AS cb1, g4 AS cb2, {NO_TS} AS ts FROM s CROSS JOIN gm),
src AS (SELECT *, {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s2),
{plan_out('src')}"""

ORACLE["resolve_feature_store"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT *, {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s),
{plan_out('src')}"""

ORACLE["resolve_override"] = f"""WITH {FACT}, {WIDE_SCEN},
s2 AS (SELECT scenario_name, ka, kb, d1, d2, coalesce(CASE WHEN ka >= kb THEN 5E0 END, ca1) AS ca1, ca2, cb1,
              4E0 AS cb2, ts FROM s),
src AS (SELECT *, {MISSING_FEATURE} AS err, 'override' AS source, 'python' AS mode FROM s2),
{plan_out('src')}"""

ORACLE["resolve_override_only"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT scenario_name, ka, kb, d1, d2, coalesce(ca1, 10E0) AS ca1, 12E0 AS ca2, 15E0 AS cb1,
               coalesce(cb2, 8E0) AS cb2, {NO_TS} AS ts, CAST(NULL AS VARCHAR) AS err, 'override_only' AS source,
               'python' AS mode FROM s),
{plan_out('src')}"""

ORACLE["resolve_sql_input"] = f"""WITH {FACT}, {WIDE_SCEN},
s2 AS (SELECT scenario_name, ka, kb, d1, d2, ca1, ca2, cb1, cb2, {NO_TS} AS ts FROM s),
src AS (SELECT *, {SQL_MISSING} AS err, 'sql_input' AS source, 'sql' AS mode FROM s2),
{plan_out('src')}"""

ORACLE["scenario_resolve_constraints"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT scenario_name, ka, kb, 70 AS d1, 60 AS d2, ca1, ca2, cb1, cb2, ts,
               {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s),
{plan_out('src')}"""

ORACLE["scenario_casts"] = f"""WITH {FACT}, {WIDE_SCEN}
SELECT scenario_name, CAST(trunc(ka / 3E0) AS BIGINT) AS warehouse_a_capacity, CAST(kb AS BIGINT) AS warehouse_b_capacity,
       CASE WHEN ka % 2 = 0 THEN NULL ELSE CAST(d1 AS BIGINT) END AS customer_1_demand,
       round(ca1, 6) AS cost_a_to_1, ts AS feature_timestamp,
       CASE WHEN ka % 2 = 0 THEN 'customer_1_demand' ELSE '' END AS invalid_inputs
FROM s"""

ORACLE["scenario_missing_costs"] = f"""WITH {FACT}, {WIDE_SCEN},
lane AS (SELECT warehouse, lane_warehouse, customer, avg({COMP}) AS cc FROM fact GROUP BY ALL),
s2 AS (SELECT s.scenario_name, s.wa, s.wb, ka, kb, d1, d2,
              (SELECT cc FROM lane WHERE warehouse = s.wa AND lane_warehouse = s.wb AND customer = 'Customer_AUTOMOBILE') AS ca1,
              (SELECT cc FROM lane WHERE warehouse = s.wa AND lane_warehouse = s.wb AND customer = 'Customer_BUILDING') AS ca2,
              (SELECT cc FROM lane WHERE warehouse = s.wb AND lane_warehouse = s.wa AND customer = 'Customer_AUTOMOBILE') AS cb1,
              (SELECT cc FROM lane WHERE warehouse = s.wb AND lane_warehouse = s.wa AND customer = 'Customer_BUILDING') AS cb2,
              {NO_TS} AS ts
       FROM s),
src AS (SELECT *, {SQL_MISSING} AS err, 'sql_input' AS source, 'sql' AS mode FROM s2),
{plan_out('src', 'wa AS warehouse_a, wb AS warehouse_b,')}"""

ORACLE["scenario_default_name"] = f"""WITH {FACT}, {WIDE_SCEN},
s2 AS (SELECT coalesce(CASE WHEN ka % 2 = 0 THEN scenario_name END,
                       'scenario_' || CAST(row_number() OVER (ORDER BY wa, wb) - 1 AS VARCHAR)) AS scenario_name,
              wa, wb, ka, kb, d1, d2, ca1, ca2, cb1, cb2, ts FROM s),
src AS (SELECT *, {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s2),
{plan_out('src', 'wa AS warehouse_a, wb AS warehouse_b,')}"""

PLAN_NAMED = f"""{LINES_2XN},
named AS (SELECT plan.*, sc.wa, sc.wb FROM plan JOIN sc ON sc.scenario_name = plan.scenario_name)"""

ORACLE["warehouse_utilization"] = f"""WITH {FACT}, {PLAN_NAMED},
per AS (SELECT scenario_name, max(wa) AS wa, max(wb) AS wb, sum(shipment_from_a) AS ua, sum(shipment_from_b) AS ub,
               max(capacity_a) AS ka, max(capacity_b) AS kb FROM named GROUP BY scenario_name),
lng AS (SELECT scenario_name, wa AS warehouse, ua AS used, ka AS capacity FROM per
        UNION ALL SELECT scenario_name, wb, ub, kb FROM per)
SELECT scenario_name, warehouse, round(used, 6) AS used, round(capacity, 6) AS capacity,
       round(used / nullif(capacity, 0), 6) AS utilization_rate FROM lng"""

ORACLE["customer_satisfaction"] = f"""WITH {FACT}, {PLAN_NAMED}
SELECT scenario_name, customer, round(shipment_from_a + shipment_from_b, 6) AS received, round(demand, 6) AS demand,
       round((shipment_from_a + shipment_from_b) / nullif(demand, 0), 6) AS satisfaction_rate FROM named"""

ORACLE["shipments_nonzero"] = f"""WITH {FACT}, {PLAN_NAMED},
legs AS (SELECT scenario_name, customer, wa AS warehouse, shipment_from_a AS quantity, cost_from_a AS cost_per_unit FROM named
         UNION ALL SELECT scenario_name, customer, wb, shipment_from_b, cost_from_b FROM named)
SELECT scenario_name, customer, warehouse, round(quantity, 6) AS quantity, round(cost_per_unit, 6) AS cost_per_unit,
       round(quantity * cost_per_unit, 6) AS shipment_cost
FROM legs WHERE quantity > 0"""

ORACLE["plan_detail"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT *, {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s),
pr AS (WITH {plan_out('src')})
SELECT scenario_name, optimal_cost, feasible, warehouse_a_utilization, warehouse_b_utilization,
       cost_matrix_source, execution_mode FROM pr"""

ORACLE["plan_summary_line"] = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT scenario_name, floor(ka / 4) AS ka, floor(kb / 4) AS kb, d1, d2, ca1, ca2, cb1, cb2, ts,
               {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s),
{solve_2x2_sql('src')}
SELECT scenario_name, ok AS feasible, CASE WHEN err IS NULL THEN source ELSE 'error' END AS cost_matrix_source,
       mode AS execution_mode,
       CASE WHEN ok THEN printf('$%.2f', ca1 * x1 + ca2 * (t - x1) + cb1 * (e1 - x1) + cb2 * (e2 - (t - x1)))
            ELSE 'N/A' END AS display_cost
FROM r3"""

ORACLE["plan_source_counts"] = f"""WITH {FACT}, {WIDE_SCEN},
m AS (SELECT CASE WHEN ka % 2 = 0 THEN 'override' ELSE 'override_only' END AS src FROM s)
SELECT 'execution_mode' AS attribute, 'python' AS value, count(*) AS n FROM m
UNION ALL
SELECT 'cost_matrix_source', src, count(*) FROM m GROUP BY src"""

ORACLE["routes_with_constraints"] = f"""WITH {FACT}, {ROUTES},
rc AS (SELECT warehouse, count(*) AS capacity FROM fact GROUP BY warehouse),
rd AS (SELECT customer, CAST(floor(count(*) / 20) AS BIGINT) AS demand FROM fact GROUP BY customer)
SELECT routes.customer, routes.warehouse, round(cc, 6) AS cost_per_unit, rc.capacity, rd.demand,
       CASE WHEN rc.capacity IS NULL THEN 'no capacity for ' || routes.warehouse
            WHEN rd.demand IS NULL THEN 'no demand for ' || routes.customer END AS error
FROM routes LEFT JOIN rc ON rc.warehouse = routes.warehouse LEFT JOIN rd ON rd.customer = routes.customer"""

ORACLE["constraint_mismatches"] = f"""WITH {FACT},
recv AS (SELECT DISTINCT lane_warehouse AS w FROM (SELECT lane_warehouse FROM fact GROUP BY warehouse, customer, lane_warehouse HAVING count(*) >= 5)),
dem AS (SELECT DISTINCT customer FROM fact WHERE lane_warehouse = warehouse)
SELECT 'route without capacity' AS problem, warehouse AS name FROM (SELECT DISTINCT warehouse FROM fact) WHERE warehouse NOT IN (SELECT w FROM recv)
UNION ALL SELECT 'route without demand', customer FROM (SELECT DISTINCT customer FROM fact) WHERE customer NOT IN (SELECT customer FROM dem)
UNION ALL SELECT 'capacity without route', w FROM recv WHERE w NOT IN (SELECT warehouse FROM fact)
UNION ALL SELECT 'demand without route', customer FROM dem WHERE customer NOT IN (SELECT customer FROM fact)"""

SQL_FN = f"""WITH {FACT}, {WIDE_SCEN},
src AS (SELECT *, {SQL_MISSING} AS err, 'sql_input' AS source, 'sql' AS mode FROM s),
pr AS (WITH {plan_out('src')})"""

ORACLE["plan_sql_function"] = f"""{SQL_FN}
SELECT * FROM pr"""

ORACLE["result_extract"] = f"""{SQL_FN}
SELECT scenario_name AS result_scenario_name, optimal_cost, shipment_a_to_1, shipment_a_to_2, shipment_b_to_1,
       shipment_b_to_2, warehouse_a_utilization, warehouse_b_utilization, feasible FROM pr"""

ORACLE["batch_optimize_sql"] = f"""WITH {FACT}, {ROUTES}, {GLOBAL_M},
vals AS (SELECT * FROM (VALUES ('peak_season', 100, 80, 90, 80), ('off_season', 100, 80, 50, 40),
                               ('fuel_price_hike', 100, 80, 70, 60), ('new_warehouse', 150, 80, 70, 60))
                AS t(scenario_name, ka, kb, d1, d2)),
src AS (SELECT vals.*, g1 AS ca1, g2 AS ca2, g3 AS cb1, g4 AS cb2, gts AS ts,
               CASE WHEN g1 IS NULL OR g2 IS NULL OR g3 IS NULL OR g4 IS NULL THEN 'missing' END AS err,
               'sql_input' AS source, 'sql' AS mode
        FROM vals CROSS JOIN gm),
pr AS (WITH {plan_out('src')})
SELECT optimal_cost, shipment_a_to_1, shipment_a_to_2, shipment_b_to_1, shipment_b_to_2, warehouse_a_utilization,
       warehouse_b_utilization, scenario_name AS result_scenario_name, feasible FROM pr"""

ORACLE["what_if_override"] = f"""WITH {FACT}, {WIDE_SCEN}, {GLOBAL_M},
src AS (SELECT s.scenario_name, ka, kb, d1, d2, 7.5E0 AS ca1, g2 AS ca2, g3 AS cb1, g4 AS cb2, gts AS ts,
               CASE WHEN g2 IS NULL OR g3 IS NULL OR g4 IS NULL THEN 'missing' END AS err,
               'sql_input' AS source, 'sql' AS mode
        FROM s CROSS JOIN gm),
pr AS (WITH {plan_out('src')})
SELECT scenario_name, optimal_cost, feasible, shipment_a_to_1, shipment_a_to_2, shipment_b_to_1, shipment_b_to_2
FROM pr"""

ORACLE["scenario_cross_features"] = f"""WITH {FACT}, {WIDE_SCEN}
SELECT s.scenario_name, s.ka AS warehouse_a_capacity, s.kb AS warehouse_b_capacity,
       s.d1 AS customer_1_demand, s.d2 AS customer_2_demand,
       round(max(CASE WHEN f.warehouse = 'Warehouse_00' AND f.customer = 'Customer_AUTOMOBILE' THEN f.cc END), 6) AS cost_a_to_1,
       round(max(CASE WHEN f.warehouse = 'Warehouse_00' AND f.customer = 'Customer_BUILDING' THEN f.cc END), 6) AS cost_a_to_2,
       round(max(CASE WHEN f.warehouse = 'Warehouse_01' AND f.customer = 'Customer_AUTOMOBILE' THEN f.cc END), 6) AS cost_b_to_1,
       round(max(CASE WHEN f.warehouse = 'Warehouse_01' AND f.customer = 'Customer_BUILDING' THEN f.cc END), 6) AS cost_b_to_2,
       max(f.ts) AS feature_timestamp
FROM s CROSS JOIN routes f
GROUP BY s.scenario_name, s.ka, s.kb, s.d1, s.d2"""

ORACLE["plan_feasibility"] = f"""WITH {FACT}, {LINES_2XN}
SELECT scenario_name, bool_and(feasible) AS feasible, round(sum(demand), 6) AS total_demand,
       round(sum(shipment_from_a) + sum(shipment_from_b), 6) AS total_shipped
FROM plan GROUP BY scenario_name"""


SNAPS = """
cand AS (SELECT *, unnest([date_trunc('month', last_updated),
                           date_trunc('month', last_updated) + INTERVAL 1 MONTH,
                           date_trunc('month', last_updated) + INTERVAL 2 MONTH]) AS snapshot_ts FROM fact),
snaps AS (SELECT * FROM cand WHERE snapshot_ts >= last_updated AND snapshot_ts <= last_updated + INTERVAL 30 DAY)"""

ORACLE["features_on_date"] = f"""WITH {FACT}, {SNAPS}
{FEATURE_SELECT.replace('FROM fact', 'FROM snaps').replace('SELECT warehouse, customer,', 'SELECT warehouse, customer, snapshot_ts,')}
WHERE snapshot_ts >= TIMESTAMP '2000-07-01' AND snapshot_ts < TIMESTAMP '2000-07-02'
GROUP BY warehouse, customer, snapshot_ts"""

ORACLE["feature_asof"] = f"""WITH {FACT}, {SNAPS},
hist AS (SELECT warehouse, customer, snapshot_ts, avg({COMP}) AS composite_cost, count(*) AS sample_count
         FROM snaps GROUP BY warehouse, customer, snapshot_ts),
spine AS (SELECT DISTINCT warehouse, customer, last_updated + INTERVAL 10 DAY AS ts FROM fact)
SELECT spine.warehouse, spine.customer, spine.ts, hist.snapshot_ts, round(hist.composite_cost, 6) AS composite_cost,
       hist.sample_count
FROM spine ASOF LEFT JOIN hist
  ON spine.warehouse = hist.warehouse AND spine.customer = hist.customer AND spine.ts >= hist.snapshot_ts"""

ORACLE["feature_recompute_asof"] = f"""WITH {FACT},
spine AS (SELECT DISTINCT warehouse, customer, date_trunc('month', last_updated) + INTERVAL 14 DAY + INTERVAL 12 HOUR AS ts
          FROM fact),
m AS (SELECT spine.ts, fact.* FROM spine JOIN fact
        ON fact.warehouse = spine.warehouse AND fact.customer = spine.customer
       AND fact.last_updated >= spine.ts - INTERVAL 30 DAY AND fact.last_updated <= spine.ts)
{FEATURE_SELECT.replace('FROM fact', 'FROM m').replace('SELECT warehouse, customer,', 'SELECT warehouse, customer, ts,')}
GROUP BY warehouse, customer, ts
UNION ALL
SELECT spine.warehouse, spine.customer, spine.ts, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM spine WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.warehouse = spine.warehouse AND m.customer = spine.customer
                                               AND m.ts = spine.ts)"""

ORACLE["resolve_asof"] = f"""WITH {FACT}, {WIDE_SCEN}, {SNAPS},
hist AS (SELECT warehouse, customer, snapshot_ts, avg({COMP}) AS cc FROM snaps GROUP BY warehouse, customer, snapshot_ts),
sts AS (SELECT s.*, TIMESTAMP '1996-01-01' + to_days(CAST(ka % 1500 AS INTEGER)) AS fts FROM s),
spine AS (SELECT scenario_name, fts AS ts, 'a1' AS slot, wa AS warehouse, 'Customer_AUTOMOBILE' AS customer FROM sts
          UNION ALL SELECT scenario_name, fts, 'a2', wa, 'Customer_BUILDING' FROM sts
          UNION ALL SELECT scenario_name, fts, 'b1', wb, 'Customer_AUTOMOBILE' FROM sts
          UNION ALL SELECT scenario_name, fts, 'b2', wb, 'Customer_BUILDING' FROM sts),
found AS (SELECT spine.scenario_name, spine.slot, hist.cc FROM spine ASOF LEFT JOIN hist
            ON spine.warehouse = hist.warehouse AND spine.customer = hist.customer AND spine.ts >= hist.snapshot_ts),
piv AS (SELECT scenario_name, max(CASE WHEN slot = 'a1' THEN cc END) AS x1c, max(CASE WHEN slot = 'a2' THEN cc END) AS x2c,
               max(CASE WHEN slot = 'b1' THEN cc END) AS y1c, max(CASE WHEN slot = 'b2' THEN cc END) AS y2c
        FROM found GROUP BY scenario_name),
s2 AS (SELECT sts.scenario_name, wa, wb, ka, kb, d1, d2, piv.x1c AS ca1, piv.x2c AS ca2, piv.y1c AS cb1, piv.y2c AS cb2,
              fts AS ts
       FROM sts LEFT JOIN piv ON piv.scenario_name = sts.scenario_name),
src AS (SELECT *, {MISSING_FEATURE} AS err, 'feature_store' AS source, 'python' AS mode FROM s2),
{plan_out('src', 'wa AS warehouse_a, wb AS warehouse_b,')}"""


ORACLE["constraints_json"] = f"""WITH {FACT}
SELECT 'warehouse' AS party, warehouse AS name, CAST(count(*) AS DOUBLE) AS value FROM fact GROUP BY warehouse
UNION ALL
SELECT 'customer', customer, CAST(floor(count(*) / 20) AS DOUBLE) FROM fact GROUP BY customer"""

ORACLE["route_costs_csv"] = f"""WITH {FACT}, {ROUTES}
SELECT warehouse, customer, round(cc, 6) AS cost_per_unit FROM routes"""

ORACLE["feature_publish"] = f"""WITH {FACT}
SELECT f.*, '1.0' AS version FROM ({FEATURE_SELECT} GROUP BY warehouse, customer) f"""

ORACLE["feature_read"] = ORACLE["features_all"]

ORACLE["feature_lookup"] = f"""WITH {FACT},
feats AS ({FEATURE_SELECT} GROUP BY warehouse, customer),
spine AS (SELECT DISTINCT lane_warehouse AS warehouse, customer FROM fact)
SELECT spine.warehouse, spine.customer, avg_distance_cost, avg_fuel_cost, avg_time_cost, avg_capacity_factor,
       avg_seasonal_factor, avg_priority_factor, composite_cost, fuel_price_volatility, min_fuel_price,
       max_fuel_price, sample_count, feature_timestamp
FROM spine LEFT JOIN feats ON feats.warehouse = spine.warehouse AND feats.customer = spine.customer"""

DAY_SELECT = FEATURE_SELECT.replace("SELECT warehouse, customer,", "SELECT warehouse, customer, day,")
ORACLE["rolling_features_30d"] = f"""WITH {FACT},
days AS (SELECT DISTINCT warehouse, customer, CAST(last_updated AS DATE) AS day FROM fact),
m AS (SELECT days.day, fact.* FROM days JOIN fact ON fact.warehouse = days.warehouse AND fact.customer = days.customer
        AND fact.last_updated >= days.day - INTERVAL 29 DAY AND fact.last_updated < days.day + INTERVAL 1 DAY)
{DAY_SELECT.replace('FROM fact', 'FROM m')}
GROUP BY warehouse, customer, day"""
ORACLE["stream_rolling_features"] = ORACLE["rolling_features_30d"]

ORACLE["stream_daily_features"] = f"""WITH {FACT},
m AS (SELECT CAST(last_updated AS DATE) AS day, * FROM fact)
{DAY_SELECT.replace('FROM fact', 'FROM m')}
GROUP BY warehouse, customer, day"""

ORACLE["features_30d_partitioned"] = ORACLE["features_30d"]

ORACLE["stream_late_rows"] = f"""WITH {FACT},
newest AS (SELECT max(last_updated) AS t FROM fact WHERE last_updated >= TIMESTAMP '1995-01-01'),
m AS (SELECT *, last_updated < TIMESTAMP '1995-01-01'
             AND date_trunc('day', last_updated) + INTERVAL 1 DAY <= (SELECT t FROM newest) - INTERVAL 1 DAY AS late FROM fact)
SELECT warehouse, customer, count(*) FILTER (NOT late) AS n_on_time, count(*) FILTER (late) AS n_late
FROM m GROUP BY warehouse, customer"""


def _half_up(sql: str, digits: int = 6) -> str:
    """Rewrite ``round(x, 6)`` as a decimal round half up.

    Spark rounds a double half up on its shortest decimal form; rounding the
    binary value instead can flip exact decimal ties (1.0665625 -> 1.066562).
    Going through DECIMAL first gives the decimal behaviour in the oracle too.
    """
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + len(key):k - 1]
        expr, _, places = inner.rpartition(",")
        out.append(sql[i:j])
        out.append(f"CAST(round(CAST({_half_up(expr.strip(), digits)} AS DECIMAL(38, 9)), "
                   f"{places.strip()}) AS DOUBLE)")
        i = k


ORACLE = {name: _half_up(sql) for name, sql in ORACLE.items()}


ORACLE["stream_scenarios"] = ORACLE["plan_2x2"]
