"""Route-cost features: per-observation cost terms aggregated per route.

One feature row per route (warehouse, customer) with the averages of the cost
terms, price statistics, the sample count and the newest observation time.
The aggregation is a partial (map-side) hash aggregate followed by a single
shuffle on the route key, so a route holding a large share of the facts only
ever ships one partial row per input partition.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs
from ..schemas import LOOKBACK_DAYS, ROUTE_KEYS


def ts_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime, date or ISO text (constant-folded,
    so comparisons with it reach the Parquet scan as pushed filters)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def lookback_filter(facts: DataFrame, as_of, lookback_days: int = LOOKBACK_DAYS,
                    ts_col: str = "last_updated") -> DataFrame:
    """Observations in ``[as_of - lookback_days, as_of]``.

    ``as_of`` is an explicit argument (not the wall clock) so results repeat.
    """
    end = ts_literal(as_of)
    start = end - F.make_dt_interval(F.lit(lookback_days))
    return facts.where((F.col(ts_col) >= start) & (F.col(ts_col) <= end))


def day_filter(features: DataFrame, day, ts_col: str = "feature_timestamp") -> DataFrame:
    """Rows whose timestamp falls on calendar ``day``, written as a half-open
    range so it pushes down (instead of ``to_date(ts) = day``)."""
    start = ts_literal(day)
    return features.where((F.col(ts_col) >= start) & (F.col(ts_col) < start + F.expr("INTERVAL 1 DAY")))


def with_cost_components(facts: DataFrame) -> DataFrame:
    """Append the per-observation cost terms (distance, fuel, time, capacity
    factor and composite cost)."""
    return facts.select(
        "*",
        costs.distance_cost().alias("distance_cost"),
        costs.fuel_cost().alias("fuel_cost"),
        costs.time_cost().alias("time_cost"),
        costs.capacity_factor().alias("capacity_factor"),
        costs.composite_cost().alias("calculated_cost"),
    )


def feature_aggregates() -> list[Column]:
    """The aggregate list of one feature row (order = feature schema)."""
    return [
        F.avg(costs.distance_cost()).alias("avg_distance_cost"),
        F.avg(costs.fuel_cost()).alias("avg_fuel_cost"),
        F.avg(costs.time_cost()).alias("avg_time_cost"),
        F.avg(costs.capacity_factor()).alias("avg_capacity_factor"),
        F.avg("seasonal_factor").alias("avg_seasonal_factor"),
        F.avg("priority_multiplier").alias("avg_priority_factor"),
        F.avg(costs.composite_cost()).alias("composite_cost"),
        F.stddev_samp("fuel_price_per_liter").alias("fuel_price_volatility"),
        F.min("fuel_price_per_liter").alias("min_fuel_price"),
        F.max("fuel_price_per_liter").alias("max_fuel_price"),
        F.count(F.lit(1)).alias("sample_count"),
        F.max("last_updated").alias("feature_timestamp"),
    ]


def route_features(facts: DataFrame, as_of=None, lookback_days: int | None = LOOKBACK_DAYS,
                   keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Cost-matrix features per route.

    With ``as_of`` the facts are restricted to the look-back window ending at
    ``as_of``; without it every observation counts.
    """
    if as_of is not None and lookback_days is not None:
        facts = lookback_filter(facts, as_of, lookback_days)
    return facts.groupBy(*keys).agg(*feature_aggregates())


def feature_lookup(spine: DataFrame, features: DataFrame, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Retrieve feature values for the routes of a spine; spine rows without a
    feature row are kept with nulls."""
    return spine.join(features, on=keys, how="left")


# ---------------------------------------------------------------------------
# Mergeable partial statistics.
#
# Several consumers (features, capacities, lanes, demands) read the same
# facts. Aggregating the facts once at a finer grain and merging from that
# small table scans the (large) fact input once instead of once per consumer.
# Averages merge as sum/count. The price deviation is kept as the moments
# (n, mean, M2 = sum of squared distances from the mean) and never as a sum of
# squares, which would cancel for prices that are large against their spread.
# ---------------------------------------------------------------------------
_AVG_TERMS = {
    "avg_distance_cost": lambda: costs.distance_cost(),
    "avg_fuel_cost": lambda: costs.fuel_cost(),
    "avg_time_cost": lambda: costs.time_cost(),
    "avg_capacity_factor": lambda: costs.capacity_factor(),
    "avg_seasonal_factor": lambda: F.col("seasonal_factor"),
    "avg_priority_factor": lambda: F.col("priority_multiplier"),
    "composite_cost": lambda: costs.composite_cost(),
}
ADDED = ["n", *[f"{p}_{k}" for k in _AVG_TERMS for p in "sc"]]
PARTIAL_COLUMNS = [*ADDED, "fuel_n", "fuel_mean", "fuel_m2", "min_fuel_price", "max_fuel_price", "feature_timestamp"]


def partial_aggregates() -> list[Column]:
    """The aggregates of a partial row (``PARTIAL_COLUMNS``); they work on streams too."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, term in _AVG_TERMS.items():
        aggs += [F.sum(term()).alias(f"s_{name}"), F.count(term()).alias(f"c_{name}")]
    fuel = F.col("fuel_price_per_liter")
    return aggs + [F.count(fuel).alias("fuel_n"), F.avg(fuel).alias("fuel_mean"),
                   F.coalesce(F.var_samp(fuel) * (F.count(fuel) - 1), F.lit(0.0)).alias("fuel_m2"),
                   F.min(fuel).alias("min_fuel_price"), F.max(fuel).alias("max_fuel_price"),
                   F.max("last_updated").alias("feature_timestamp")]


def route_partials(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial feature statistics per ``keys`` (a refinement of the route key)."""
    return facts.groupBy(*keys).agg(*partial_aggregates())


def shifted_moments(n: Column, off: Column, m2: Column, centre: Column) -> tuple[Column, Column, Column]:
    """(n, mean, M2) of merged moments from their aggregates around a common ``centre``:
    ``n`` = sum of n, ``off`` = sum of n * (mean - centre), ``m2`` = sum of M2 + n * (mean - centre)**2.
    Stable as long as the centre lies among the means."""
    return n, centre + F.try_divide(off, n), F.greatest(m2 - F.coalesce(F.try_divide(off * off, n), F.lit(0.0)), F.lit(0.0))


def centred(partials: DataFrame, centre: Column) -> DataFrame:
    """``partials`` with _centre and the terms _off and _sq that add up around it."""
    d = F.coalesce(F.col("fuel_mean") - F.col("_centre"), F.lit(0.0))
    return (partials.withColumn("_centre", centre).withColumn("_off", F.col("fuel_n") * d)
            .withColumn("_sq", F.col("fuel_m2") + F.col("fuel_n") * d * d))


def mean_price(w=None) -> Column:
    """Mean price of the partial rows of a group, or of window ``w``."""
    total, n = F.sum(F.col("fuel_mean") * F.col("fuel_n")), F.sum("fuel_n")
    return F.try_divide(total.over(w), n.over(w)) if w is not None else F.try_divide(total, n)


def roll_up_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial rows of the coarser ``keys`` from finer ones.

    The squared distances need the group's mean first. It comes from a window over
    the partial rows of the group, which the aggregation then reads in the same
    partitions: one shuffle, and the input is evaluated once. A group's partial rows
    are as many as its finer keys, whatever the number of facts behind them."""
    rows = centred(partials, mean_price(Window.partitionBy(*keys)))
    grouped = rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ADDED], F.sum("fuel_n").alias("fuel_n"), F.max("_centre").alias("_centre"),
        F.sum("_off").alias("_off"), F.sum("_sq").alias("_sq"), F.min("min_fuel_price").alias("min_fuel_price"),
        F.max("max_fuel_price").alias("max_fuel_price"), F.max("feature_timestamp").alias("feature_timestamp"))
    _, mean, m2 = shifted_moments(F.col("fuel_n"), F.col("_off"), F.col("_sq"), F.col("_centre"))
    return grouped.withColumn("fuel_mean", mean).withColumn("fuel_m2", m2).select(*keys, *PARTIAL_COLUMNS)


def merge_moments(states: Column) -> Column:
    """One struct (n, mean, m2) from an array of them, folded pair by pair. For short
    arrays (the days of a window), where no common centre is at hand."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a, b):
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.when(b["n"] == 0, a).otherwise(F.struct(
            n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2")))
    return F.aggregate(states, zero, add)


def windowed_partials(daily: DataFrame, keys: list[str], day_index: Column, first: int, last: int,
                      keep: list[str]) -> DataFrame:
    """For every row the merge of the partial rows of its ``keys`` whose ``day_index`` is
    within [own + first, own + last]: keys, ``keep``, PARTIAL_COLUMNS. Rows with a null n ask
    without adding anything. The rows of a window are one for each day at most (two with those
    that ask), so the fold of the moments stays short."""
    w = Window.partitionBy(*keys).orderBy(day_index).rangeBetween(first, last)
    states = F.collect_list(F.when(F.col("fuel_n") > 0, F.struct(
        F.col("fuel_n").alias("n"), F.col("fuel_mean").alias("mean"), F.col("fuel_m2").alias("m2")))).over(w)
    rows = daily.select(
        *keys, *keep, *[F.sum(c).over(w).alias(c) for c in ADDED], states.alias("_states"),
        F.min("min_fuel_price").over(w).alias("min_fuel_price"), F.max("max_fuel_price").over(w).alias("max_fuel_price"),
        F.max("feature_timestamp").over(w).alias("feature_timestamp")).withColumn("_m", merge_moments(F.col("_states")))
    return (rows.withColumn("fuel_n", F.col("_m.n")).withColumn("fuel_mean", F.when(F.col("_m.n") > 0, F.col("_m.mean")))
            .withColumn("fuel_m2", F.col("_m.m2")).select(*keys, *keep, *PARTIAL_COLUMNS))


def finished(partials: DataFrame, keep: list[str]) -> DataFrame:
    """Feature rows (feature schema) of partial rows, one for one."""
    vol = F.when(F.col("fuel_n") > 1, F.sqrt(F.col("fuel_m2") / (F.col("fuel_n") - 1)))
    return partials.select(
        *keep, *[F.try_divide(F.col(f"s_{k}"), F.col(f"c_{k}")).alias(k) for k in _AVG_TERMS],
        vol.alias("fuel_price_volatility"), "min_fuel_price", "max_fuel_price", F.col("n").alias("sample_count"), "feature_timestamp")


def merge_partials(partials: DataFrame, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Feature rows (feature schema) from ``route_partials`` rows."""
    return finished(roll_up_partials(partials, keys), keys)
