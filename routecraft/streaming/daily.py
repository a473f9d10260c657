"""Incremental route features.

Observations arrive as files. A streaming job keeps one partial row per (route,
day) with everything a feature row needs: count, sums and counts of the seven
averaged terms, the price moments (n, mean, M2), min/max price and newest time. A
day is emitted once the watermark (one day of allowed lateness) passes its end.
Rolling features are then a moving range over the day rows of each route, whose
number is bounded by the time span, not by the number of observations.

``upsert`` has the other way: a store of day rows that every micro-batch adds to,
safe to replay, with late rows kept aside instead of dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import PARTIAL_COLUMNS, finished, partial_aggregates, roll_up_partials, windowed_partials
from ..plans.two_by_two import plan_2x2
from ..schemas import LOOKBACK_DAYS, ROUTE_KEYS


def daily_partials(facts: DataFrame, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Batch form of the daily partial rows."""
    return facts.groupBy(*keys, F.to_date("last_updated").alias("day")).agg(*partial_aggregates())


def stream_daily_partials(facts_stream: DataFrame, keys: list[str] = ROUTE_KEYS,
                          lateness: str = "1 day") -> DataFrame:
    """Streaming daily partials: watermark + tumbling one-day windows."""
    events = facts_stream.withColumn("event_time", F.col("last_updated").cast("timestamp"))
    return (events.withWatermark("event_time", lateness)
            .groupBy(*keys, F.window("event_time", "1 day").alias("w"))
            .agg(*partial_aggregates())
            .select(*keys, F.to_date(F.col("w.start")).alias("day"), *PARTIAL_COLUMNS))


def run_daily_partials(spark, source_path: str, schema, sink_path: str, checkpoint_path: str) -> None:
    """Process every file available now into the Parquet sink, then stop."""
    stream = spark.readStream.schema(schema).parquet(source_path)
    query = (stream_daily_partials(stream).writeStream.outputMode("append").format("parquet")
             .option("path", sink_path).option("checkpointLocation", checkpoint_path)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def with_open_days(sink: DataFrame, facts: DataFrame, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """The days that the stream has emitted, and those still open behind the watermark,
    aggregated from the facts after the last emitted day."""
    last = sink.agg(F.max("day").alias("d")).first()["d"]
    tail = facts if last is None else facts.where(
        F.col("last_updated") >= F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return sink.unionByName(daily_partials(tail, keys))


def daily_features(daily: DataFrame, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """All feature columns of every (route, day); several partial rows of a day are merged."""
    return finished(roll_up_partials(daily, [*keys, "day"]), [*keys, "day"])


def rolling_features(daily: DataFrame, lookback_days: int = LOOKBACK_DAYS,
                     keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """Per route and day with observations: all feature columns over the ``lookback_days``
    calendar days that end with it (the day itself and the ones before). ``daily`` has one
    partial row for each (route, day)."""
    idx = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    return finished(windowed_partials(daily, keys, idx, -(lookback_days - 1), 0, ["day"]), [*keys, "day"])


def stream_plans(scenario_stream: DataFrame, warehouse_costs: DataFrame) -> DataFrame:
    """Plan streamed two-customer scenarios against static per-warehouse costs
    (stream-static equi-joins, then the stateless 2x2 projection)."""
    a = warehouse_costs.select(F.col("warehouse").alias("warehouse_a"), F.col("cost_to_1").alias("fs_cost_a_to_1"),
                               F.col("cost_to_2").alias("fs_cost_a_to_2"), F.col("feature_timestamp").alias("_ts_a"))
    b = warehouse_costs.select(F.col("warehouse").alias("warehouse_b"), F.col("cost_to_1").alias("fs_cost_b_to_1"),
                               F.col("cost_to_2").alias("fs_cost_b_to_2"), F.col("feature_timestamp").alias("_ts_b"))
    priced = scenario_stream.join(a, "warehouse_a", "left").join(b, "warehouse_b", "left") \
        .withColumn("fs_feature_timestamp", F.greatest("_ts_a", "_ts_b")).drop("_ts_a", "_ts_b")
    return plan_2x2(priced, keep=["warehouse_a", "warehouse_b"])
