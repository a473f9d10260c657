"""Cost matrices: long route costs <-> wide matrices.

The matrix is kept long (warehouse, customer, cost_per_unit) inside the
engine; wide shapes are produced only at the edge, for the two-warehouse
scenario interface or for display.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_ROUTES
from ..session import hand_off


def _route_value(w: str, c: str, value: str):
    return F.max(F.when((F.col("warehouse") == w) & (F.col("customer") == c), F.col(value)))


def cost_matrix_wide(features: DataFrame, routes=DEFAULT_ROUTES, value: str = "composite_cost",
                     ts_col: str | None = "feature_timestamp") -> DataFrame:
    """One-row matrix ``cost_a_to_1 .. cost_b_to_2`` (+ newest feature time) by
    conditional max over the routes of ``routes = (wa, wb, c1, c2)``.

    A global aggregate: partial per partition, one row out, whatever the input size.
    """
    wa, wb, c1, c2 = routes
    aggs = [
        _route_value(wa, c1, value).alias("cost_a_to_1"),
        _route_value(wa, c2, value).alias("cost_a_to_2"),
        _route_value(wb, c1, value).alias("cost_b_to_1"),
        _route_value(wb, c2, value).alias("cost_b_to_2"),
    ]
    if ts_col:
        aggs.append(F.max(ts_col).alias("feature_timestamp"))
    return features.agg(*aggs)


def costs_by_warehouse(features: DataFrame, customers: tuple[str, str], value: str = "composite_cost",
                       ts_col: str = "feature_timestamp") -> DataFrame:
    """Per warehouse: cost to customer 1, cost to customer 2, newest feature time.
    Joined twice (as warehouse A and B) to price pairs of warehouses."""
    c1, c2 = customers
    return features.groupBy("warehouse").agg(
        F.max(F.when(F.col("customer") == c1, F.col(value))).alias("cost_to_1"),
        F.max(F.when(F.col("customer") == c2, F.col(value))).alias("cost_to_2"),
        F.max(ts_col).alias("feature_timestamp"),
    )


def cost_matrix_cells(features: DataFrame, value: str = "composite_cost") -> DataFrame:
    """warehouse, cells: a map customer -> value, one row for each warehouse. Cells are counted
    as they are gathered: a route that occurs more than once would be ambiguous and is an error.
    A null customer is the cell ``null``."""
    cell = features.groupBy("warehouse", F.coalesce("customer", F.lit("null")).alias("customer")) \
        .agg(F.max(value).alias("v"), F.count(F.lit(1)).alias("n"))
    twice = F.concat(F.lit("route ("), F.coalesce("warehouse", F.lit("null")), F.lit(", "), F.col("customer"),
                     F.lit(") occurs "), F.col("n").cast("string"), F.lit(" times"))
    checked = cell.select("warehouse", "customer", F.when(F.col("n") > 1, F.raise_error(twice)).otherwise(F.col("v")).alias("v"))
    return checked.groupBy("warehouse").agg(F.map_from_entries(F.collect_list(F.struct("customer", "v"))).alias("cells"))


def cost_matrix_pivot(features: DataFrame, customers: list[str] | None = None,
                      value: str = "composite_cost") -> DataFrame:
    """Warehouse x customer matrix (one column per customer).

    Every customer of ``features`` gets a column; ``customers`` picks some instead. The cells
    are gathered once and written; the names of the columns are read from them.
    """
    rows = hand_off(cost_matrix_cells(features, value), "matrix-cells")
    if customers is None:
        header = rows.select(F.explode(F.map_keys("cells")).alias("c")).distinct().orderBy("c")
        customers = [r["c"] for r in header.toLocalIterator()]
    return rows.select("warehouse", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in customers])


def cost_matrix_long(wide: DataFrame, id_col: str = "warehouse", value: str = "cost_per_unit") -> DataFrame:
    """Unpivot a warehouse x customer matrix back to long route costs."""
    value_cols = [c for c in wide.columns if c != id_col]
    return (wide.unpivot([id_col], value_cols, "customer", value)
            .where(F.col(value).isNotNull()))


def route_costs_dedup(route_costs: DataFrame) -> DataFrame:
    """Full-row de-duplication of long route costs."""
    return route_costs.dropDuplicates()
