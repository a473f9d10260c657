"""Two warehouses x two customers: the wide scenario planner.

Every scenario row is solved by a closed-form rule written as Catalyst
expressions, so a batch of scenarios is one projection: no shuffle, no Python
worker, and it runs unchanged on a streaming frame.

Rule (costs >= 0, so shipping exactly the demand is optimal):
  p_j = costA_j - costB_j, D = d_1 + d_2,
  feasible iff K_A >= 0, K_B >= 0 and D <= K_A + K_B;
  want = sum of d_j with p_j < 0; T = min(max(want, D - K_B, 0), K_A, D);
  A serves customers in ascending (p_j, j) order until T units are placed,
  B ships the rest.
For a fixed total T from A the cheapest split fills the smallest p first; the
cost as a function of T is convex piecewise linear with slopes p ascending, so
its minimum is ``want`` clamped to the capacity-feasible interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import cast_scenarios
from ..operators.matrix import cost_matrix_wide
from ..operators.scenarios import default_scenario_names
from ..schemas import (BASE_CONSTRAINTS, CAPACITY_COLUMNS, COST_COLUMNS, DEFAULT_COSTS, DEFAULT_ROUTES,
                       DEMAND_COLUMNS, MESSAGES, PLAN_RESULT_SCHEMA)

def _zero() -> Column:
    return F.lit(0.0)


def solve_2x2(ka: Column, kb: Column, d1: Column, d2: Column,
              ca1: Column, ca2: Column, cb1: Column, cb2: Column) -> dict[str, Column]:
    """Optimal plan of one scenario, as Columns (shipments as doubles)."""
    ka, kb = ka.cast("double"), kb.cast("double")
    d1 = F.greatest(d1.cast("double"), _zero())   # a negative demand asks for nothing
    d2 = F.greatest(d2.cast("double"), _zero())
    total = d1 + d2
    feasible = (ka >= 0) & (kb >= 0) & (total <= ka + kb)
    p1, p2 = ca1 - cb1, ca2 - cb2
    want = F.when(p1 < 0, d1).otherwise(_zero()) + F.when(p2 < 0, d2).otherwise(_zero())
    from_a = F.least(F.greatest(want, total - kb, _zero()), ka, total)
    x1 = F.when(p1 <= p2, F.least(d1, from_a)).otherwise(from_a - F.least(d2, from_a))
    x2 = from_a - x1
    y1, y2 = d1 - x1, d2 - x2
    cost = ca1 * x1 + ca2 * x2 + cb1 * y1 + cb2 * y2
    return {
        "feasible": feasible,
        "optimal_cost": cost,
        "shipment_a_to_1": x1, "shipment_a_to_2": x2,
        "shipment_b_to_1": y1, "shipment_b_to_2": y2,
        # utilisation in percent; an empty warehouse (capacity 0) reports 0
        "warehouse_a_utilization": F.coalesce(F.try_divide(x1 + x2, ka) * F.lit(100.0), _zero()),
        "warehouse_b_utilization": F.coalesce(F.try_divide(y1 + y2, kb) * F.lit(100.0), _zero()),
    }


def _first_message(*pairs) -> Column:
    """First message whose condition holds (null when none does)."""
    out = F.lit(None).cast("string")
    for cond, msg in reversed(pairs):
        out = F.when(cond, msg).otherwise(out)
    return out


def plan_2x2(scenarios: DataFrame, features: DataFrame | None = None, mode: str = "python",
             routes=DEFAULT_ROUTES, defaults: dict | None = None, base_constraints: dict | None = None,
             keep: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """Cheapest shipment plan per scenario row (batch inference, DataFrame -> DataFrame).

    ``mode="python"``: costs from the feature store, optionally overridden per
    row (``use_feature_store`` and the ``cost_*`` columns decide the source,
    see ``resolve_costs``). ``mode="sql"``: all four costs come pre-joined.

    ``features``: feature rows (long) to build the global matrix from, or
    None when the scenarios already carry per-row feature costs in
    ``fs_cost_a_to_1 .. fs_cost_b_to_2`` (e.g. after an as-of lookup).
    ``keep``: extra input columns to pass through.
    ``order_by``: columns that order the scenarios totally; with them a scenario without a
    name (null, or no such column) is called ``scenario_<position>``, in error rows too.
    """
    if order_by:
        scenarios = default_scenario_names(scenarios, order_by)
    if mode not in ("python", "sql"):
        raise ValueError(f"mode must be 'python' or 'sql', got {mode!r}")
    defaults = {**DEFAULT_COSTS, **(defaults or {})}
    base = base_constraints or BASE_CONSTRAINTS
    wa, wb, c1, c2 = routes
    base_values = {
        "warehouse_a_capacity": base["warehouses"].get(wa), "warehouse_b_capacity": base["warehouses"].get(wb),
        "customer_1_demand": base["customers"].get(c1), "customer_2_demand": base["customers"].get(c2),
    }
    keep = keep or []
    df = cast_scenarios(scenarios)
    present = set(scenarios.columns)

    # -- constraints: scenario values replace the base configuration --------
    limits, errors = {}, []
    for name in CAPACITY_COLUMNS + DEMAND_COLUMNS:
        if name in present:
            limits[name] = F.col(name)
            errors.append((F.col(name).isNull() & ~F.array_contains("_invalid_inputs", name),
                           F.lit(MESSAGES["null"].format(name))))
        else:
            limits[name] = F.lit(base_values[name]).cast("bigint")
    errors.insert(0, (F.size("_invalid_inputs") > 0,
                      F.concat(F.lit(MESSAGES["invalid"]), F.array_join("_invalid_inputs", ", "))))

    # -- costs by source -----------------------------------------------------
    cost_cols, source, cost_errors = resolve_costs(df, present, features, mode, routes, defaults)
    errors.extend(cost_errors)
    negative = F.array_compact(F.array(*[F.when(cost_cols[c] < 0, F.lit(c)) for c in COST_COLUMNS]))
    errors.append((F.size(negative) > 0,
                   F.concat(F.lit(MESSAGES["negative"]), F.array_join(negative, ", "))))
    error = _first_message(*errors)

    name = F.col("scenario_name") if "scenario_name" in present else F.lit(None).cast("string")
    ts = F.col("feature_timestamp") if "feature_timestamp" in present else F.lit(None).cast("timestamp_ntz")
    if "fs_feature_timestamp" in df.columns and "feature_timestamp" not in present:
        ts = F.col("fs_feature_timestamp")

    # Stage 1: resolved inputs, each computed once (later projections refer to
    # them by name instead of repeating the expressions).
    staged = df.select(
        *keep, name.alias("scenario_name"), ts.alias("feature_timestamp"),
        *[limits[c].alias(f"_{c}") for c in CAPACITY_COLUMNS + DEMAND_COLUMNS],
        *[cost_cols[c].alias(f"_{c}") for c in COST_COLUMNS],
        source.alias("_source"), error.alias("error"))
    # Stage 2: the closed-form plan.
    plan = solve_2x2(*[F.col(f"_{c}") for c in CAPACITY_COLUMNS + DEMAND_COLUMNS + COST_COLUMNS])
    solved = F.col("error").isNull() & plan["feasible"]
    staged = staged.select("*", F.coalesce(solved, F.lit(False)).alias("_solved"),
                           *[v.alias(f"_plan_{k}") for k, v in plan.items() if k != "feasible"])
    ok, solved = F.col("error").isNull(), F.col("_solved")
    out = {
        "scenario_name": F.col("scenario_name"),
        "optimal_cost": F.when(solved, F.col("_plan_optimal_cost")),
        "feasible": solved,
        **{k: F.when(solved, F.col(f"_plan_{k}")).otherwise(_zero())
           for k in ["shipment_a_to_1", "shipment_a_to_2", "shipment_b_to_1", "shipment_b_to_2",
                     "warehouse_a_utilization", "warehouse_b_utilization"]},
        "cost_matrix_source": F.when(ok, F.col("_source")).otherwise(F.lit("error")),
        "feature_timestamp": F.col("feature_timestamp"),
        "execution_mode": F.lit(mode),
        "error": F.col("error"),
    }
    return staged.select(*keep, *[out[f.name].cast(f.dataType).alias(f.name) for f in PLAN_RESULT_SCHEMA.fields])


def resolve_costs(df: DataFrame, present: set, features: DataFrame | None, mode: str,
                  routes=DEFAULT_ROUTES, defaults: dict | None = None):
    """Choose the four route costs per row and name their source.

    python mode ("present" = the column exists in the frame):
      use_feature_store and some cost_* present -> feature costs, present
          non-null values replace them                       -> 'override'
      use_feature_store, no cost_* present     -> feature costs -> 'feature_store'
      not use_feature_store, some present      -> present values, absent or
          null ones take the defaults 10/12/15/8             -> 'override_only'
      not use_feature_store, none present      -> error row
    sql mode: all four must be present and non-null          -> 'sql_input'
    A feature cost that is missing (route without features) makes an error row.
    Returns (cost columns, source column, [(condition, message)]).
    """
    defaults = defaults or DEFAULT_COSTS
    errors = []
    if mode == "sql":
        missing = F.array_compact(F.array(*[
            F.when(F.col(c).isNull(), F.lit(c)) if c in present else F.lit(c) for c in COST_COLUMNS]))
        errors.append((F.size(missing) > 0,
                       F.concat(F.lit(MESSAGES["prejoined"]),
                                F.array_join(missing, ", "))))
        costs = {c: (F.col(c) if c in present else F.lit(None).cast("double")) for c in COST_COLUMNS}
        return costs, F.lit("sql_input"), errors

    use_fs = F.coalesce(F.col("use_feature_store").cast("boolean"), F.lit(True)) \
        if "use_feature_store" in present else F.lit(True)
    has_override = any(c in present for c in COST_COLUMNS)
    feature = _feature_costs(df, features, routes)
    costs = {}
    for c in COST_COLUMNS:
        given = F.col(c) if c in present else F.lit(None).cast("double")
        costs[c] = F.when(use_fs, F.coalesce(given, feature[c])).otherwise(
            F.coalesce(given, F.lit(float(defaults[c]))))
    if has_override:
        source = F.when(use_fs, F.lit("override")).otherwise(F.lit("override_only"))
    else:
        source = F.when(use_fs, F.lit("feature_store")).otherwise(F.lit("error"))
        errors.append((~use_fs, F.lit(MESSAGES["no_costs"])))
    missing_feature = F.array_compact(F.array(*[F.when(costs[c].isNull(), F.lit(c)) for c in COST_COLUMNS]))
    errors.append((use_fs & (F.size(missing_feature) > 0),
                   F.concat(F.lit(MESSAGES["no_feature"]), F.array_join(missing_feature, ", "))))
    return costs, source, errors


def _feature_costs(df: DataFrame, features: DataFrame | None, routes) -> dict[str, Column]:
    if features is None:
        if all(f"fs_{c}" in df.columns for c in COST_COLUMNS):
            return {c: F.col(f"fs_{c}") for c in COST_COLUMNS}
        return {c: F.lit(None).cast("double") for c in COST_COLUMNS}
    # Global matrix: a one-row aggregate attached as scalar subqueries, which
    # Catalyst merges into one subquery evaluated once and shipped as a value.
    matrix = cost_matrix_wide(features, routes)
    return {c: matrix.select(c).scalar() for c in COST_COLUMNS}
