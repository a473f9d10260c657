"""Point-in-time features: snapshot history, as-of lookup and recompute.

As-of lookup (latest snapshot at or before each spine timestamp, per route) is a
sorted union: spine rows and snapshots stand in one frame, cut into (route, time
bucket) groups, and each spine row takes the last snapshot before it in its group.
The latest snapshot of the earlier buckets, the "carry-in", comes from a table with
one row per (route, bucket). No group holds more than one bucket of a route, no
row meets all snapshots of its route, and nothing is gathered into arrays.

Point-in-time recompute merges three parts for each spine row: the whole days
between the two ends of its look-back (a moving range over day partials), and the
parts of the first and last day (running merges within one day). A spine row gives
three rows whatever the look-back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import LOOKBACK_DAYS, ROUTE_KEYS
from ..session import hand_off
from .features import (ADDED, PARTIAL_COLUMNS, centred, feature_aggregates, mean_price, merge_partials, roll_up_partials,
                       route_partials, shifted_moments, windowed_partials)


def _day_index(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def _month_starts(at: Column, lookback_days: int) -> Column:
    """The calendar-month starts within [at, at + look-back]."""
    limit = at + F.make_dt_interval(F.lit(lookback_days))
    candidates = F.sequence(F.date_trunc("month", at).cast("timestamp_ntz"), limit, F.expr("INTERVAL 1 MONTH"))
    return F.filter(candidates, lambda m: (m >= at) & (m <= limit))


def snapshot_span(at: Column, lookback_days: int = LOOKBACK_DAYS) -> dict[str, Column]:
    """first_snapshot and last_snapshot: the first and the last of ``_month_starts``, null if
    there are none. Observations of one span belong to the same snapshots."""
    month = F.date_trunc("month", at).cast("timestamp_ntz")
    first = F.when(at == month, month).otherwise(month + F.expr("INTERVAL 1 MONTH"))
    last = F.date_trunc("month", at + F.make_dt_interval(F.lit(lookback_days))).cast("timestamp_ntz")
    return {"first_snapshot": F.when(first <= last, first), "last_snapshot": F.when(first <= last, last)}


def monthly_snapshots(facts: DataFrame, lookback_days: int = LOOKBACK_DAYS,
                      keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Feature snapshots at every calendar-month start ``snapshot_ts``, each
    over the observations in [snapshot_ts - lookback, snapshot_ts].

    An observation at t belongs to the month starts in [t, t + lookback], a
    number fixed by the look-back.
    """
    tagged = facts.select("*", F.explode(_month_starts(F.col("last_updated"), lookback_days)).alias("snapshot_ts"))
    return tagged.groupBy(*keys, "snapshot_ts").agg(*feature_aggregates())


def snapshots_from_partials(seen: DataFrame, lookback_days: int = LOOKBACK_DAYS, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """``monthly_snapshots`` from partial rows per (keys or finer, last_updated), or per (keys or
    finer, ``snapshot_span`` of that look-back)."""
    starts = (F.sequence("first_snapshot", "last_snapshot", F.expr("INTERVAL 1 MONTH")) if "first_snapshot" in seen.columns
              else _month_starts(F.col("last_updated"), lookback_days))
    tagged = seen.select(*keys, *PARTIAL_COLUMNS, F.explode(starts).alias("snapshot_ts"))
    return merge_partials(tagged, [*keys, "snapshot_ts"])


def asof_join(spine: DataFrame, snapshots: DataFrame, keys: list[str], spine_ts: str = "ts",
              snap_ts: str = "snapshot_ts", payload: list[str] | None = None,
              bucket_days: int = 31) -> DataFrame:
    """For every spine row, the payload of the latest snapshot of the same keys
    with ``snap_ts <= spine_ts`` (nulls when there is none; of snapshots at the same
    time the one with the greatest payload). Spine rows are kept, repeated ones too. A
    spine row with a null key or time has no snapshot.

    ``bucket_days``: a bucket of a route is handled by one task, so choose it
    shorter the more snapshots and spine rows a route has.
    """
    payload = payload or [c for c in snapshots.columns if c not in keys and c != snap_ts]
    bucket = F.floor(_day_index(F.to_date("_at")) / F.lit(bucket_days))
    found = (snapshots.where(F.col(snap_ts).isNotNull()).dropna(subset=keys)
             .select(*keys, F.col(snap_ts).alias("_at"), F.struct(F.col(snap_ts).alias("_ts"), *payload).alias("_snap")))
    asks = spine.select(*keys, F.col(spine_ts).alias("_at"), F.struct(*spine.columns).alias("_row"))
    both = hand_off(found.unionByName(asks, allowMissingColumns=True).withColumn("_b", bucket), "asof-union")

    per_bucket = both.groupBy(*keys, "_b").agg(F.max("_snap").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*keys, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carry")).where("_carry is not null")

    # of rows at one time the snapshots come first
    up_to = (Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_row").isNotNull(), "_snap")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = both.withColumn("_in", F.last("_snap", ignorenulls=True).over(up_to)).where("_row is not null")
    out = inside.join(carry, [*keys, "_b"], "left").withColumn("_chosen", F.coalesce("_in", "_carry"))
    return out.select("_row.*", F.col("_chosen._ts").alias(snap_ts), *[F.col(f"_chosen.{c}").alias(c) for c in payload])


def _running(rows: DataFrame, keys: list[str], newest_first: bool) -> DataFrame:
    """Partial columns merged over the rows of the same day up to and including each row's
    time (from it on, with ``newest_first``)."""
    day = Window.partitionBy(*keys, "_day")
    w = (day.orderBy(F.col("_at").desc() if newest_first else F.col("_at"))
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    terms = centred(rows, mean_price(day))
    run = terms.select(
        *keys, "_ask", "_centre", *[F.sum(c).over(w).alias(c) for c in ADDED], F.sum("fuel_n").over(w).alias("fuel_n"),
        F.sum("_off").over(w).alias("_off"), F.sum("_sq").over(w).alias("_sq"),
        F.min("min_fuel_price").over(w).alias("min_fuel_price"), F.max("max_fuel_price").over(w).alias("max_fuel_price"),
        F.max("feature_timestamp").over(w).alias("feature_timestamp"))
    _, mean, m2 = shifted_moments(F.col("fuel_n"), F.col("_off"), F.col("_sq"), F.col("_centre"))
    return (run.where("_ask is not null and n > 0").withColumn("fuel_mean", mean).withColumn("fuel_m2", m2)
            .select(*keys, "_ask", *PARTIAL_COLUMNS))


def recompute_from_partials(spine: DataFrame, seen: DataFrame, keys: list[str] = ROUTE_KEYS, spine_ts: str = "ts",
                            lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """``recompute_asof`` from partial rows per (keys, last_updated). ``seen`` is read
    several times: pass a written table, not a long plan."""
    if lookback_days < 1:
        raise ValueError("a look-back of one day at least")
    ts = F.col("_ask")
    start = ts - F.make_dt_interval(F.lit(lookback_days))
    # equal spine rows ask for one and the same feature row
    asks = spine.select(*keys, F.col(spine_ts).alias("_ask")).where("_ask is not null").distinct()
    seen = seen.withColumn("_day", F.to_date("last_updated"))

    # whole days: every day strictly between those of the two ends
    days = roll_up_partials(seen, [*keys, "_day"])
    points = asks.select(*keys, F.to_date("_ask").alias("_day")).distinct().withColumn("_asks", F.lit(True))
    line = days.unionByName(points, allowMissingColumns=True)
    whole = windowed_partials(line, keys, _day_index(F.col("_day")), -(lookback_days - 1), -1, ["_day", "_asks"]) \
        .where("_asks and n > 0").drop("_asks") if lookback_days > 1 else None

    # the two ends: rows of the spine in between the observations of the same day
    observed = seen.withColumnRenamed("last_updated", "_at")
    ends = asks.select(*keys, F.to_date(ts).alias("_day"), ts.alias("_at"), "_ask")
    starts = asks.select(*keys, F.to_date(start).alias("_day"), start.alias("_at"), "_ask")
    parts = [_running(observed.unionByName(ends, allowMissingColumns=True), keys, False),
             _running(observed.unionByName(starts, allowMissingColumns=True), keys, True)]
    if whole is not None:
        parts.append(asks.withColumn("_day", F.to_date("_ask")).join(whole, [*keys, "_day"]).drop("_day"))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    feats = merge_partials(merged, [*keys, "_ask"]).withColumnRenamed("_ask", spine_ts)
    return spine.join(feats, [*keys, spine_ts], "left")


def recompute_asof(spine: DataFrame, facts: DataFrame, keys: list[str] = ROUTE_KEYS, spine_ts: str = "ts",
                   lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Features recomputed from the raw facts in [ts - lookback, ts] for every
    spine row (route, ts). Facts are read once, into partial rows per (route,
    observation time)."""
    seen = hand_off(route_partials(facts, [*keys, "last_updated"]), "observations")
    return recompute_from_partials(spine, seen, keys, spine_ts, lookback_days)
