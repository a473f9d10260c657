"""What a task holds or reads when the tables grow; tables of own rows."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from routecraft import catalog
from routecraft.operators.asof import monthly_snapshots, snapshot_span, snapshots_from_partials
from routecraft.operators.features import route_partials
from routecraft.schemas import FACT_SCHEMA
from routecraft.session import shared_folder


def write_tables(spark, path, orders=400, days=365):
    """A few nations and segments, orders dealt over the days, four line items each."""
    def put(name, rows):
        rows.write.parquet(f"{path}/{name}.parquet")
    put("supplier", spark.range(6).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey")))
    segment = F.when(F.col("id") % 2 == 0, "AUTOMOBILE").otherwise("BUILDING")
    put("customer", spark.range(8).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).alias("c_nationkey"), segment.alias("c_mktsegment")))
    put("orders", spark.range(orders).select(
        F.col("id").alias("o_orderkey"), (F.col("id") * 5 % 8).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
        (F.lit("1996-01-01").cast("date") + (F.col("id") * 7 % days).cast("int")).cast("timestamp_ntz").alias("o_orderdate")))
    put("lineitem", spark.range(4 * orders).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 6).alias("l_suppkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber")))


def written(spark, name):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/routecraft/{name}-*"))


@pytest.mark.parametrize("lookback", [30, 200])
def test_snapshots_from_spans(spark, lookback):
    rng = random.Random(lookback)
    t0 = dt.datetime(2023, 12, 1)
    times = [t0 + dt.timedelta(seconds=rng.randrange(150 * 86400)) for _ in range(200)]
    times += [dt.datetime(2024, m, 1) for m in range(1, 6)] + [dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 1, 1, 0, 0, 1), None]
    facts = spark.createDataFrame([(f"w{i % 2}", "c", 10.0, 1.0 + i % 9, 8.0, 0.8, 1.0, 1.0, 1.0, 1.0, t) for i, t in enumerate(times)], FACT_SCHEMA)
    span = snapshot_span(F.col("last_updated"), lookback)
    seen = route_partials(facts.withColumns(span), ["warehouse", "customer", *span])
    assert seen.agg(F.sum("n")).first()[0] == len(times)
    got = {(r.warehouse, r.snapshot_ts): r for r in snapshots_from_partials(seen, lookback).collect()}
    want = monthly_snapshots(facts, lookback).collect()
    assert len(got) == len(want) > 0
    for r in want:
        for c in r.__fields__:
            g = got[r.warehouse, r.snapshot_ts][c]
            assert g == r[c] or g == pytest.approx(r[c], rel=1e-9, abs=1e-9), c


def test_resolve_asof_groups_by_months(spark, tmp_path):
    write_tables(spark, str(tmp_path))
    before = written(spark, "observations")
    assert catalog.REGISTRY["resolve_asof"](spark, str(tmp_path)).count() == 3
    seen = spark.read.parquet(*(written(spark, "observations") - before))
    lanes = seen.select(*catalog.LANE).distinct().count()
    assert seen.agg(F.sum("n")).first()[0] == 1600
    assert seen.count() <= lanes * 12 * 3  # per month: its start, one snapshot, two or none


def test_streamed_files_follow_the_rows(spark, tmp_path, monkeypatch):
    write_tables(spark, str(tmp_path))
    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    before = written(spark, "stream_rolling")
    got = catalog.REGISTRY["stream_rolling_features"](spark, str(tmp_path)).drop("feature_timestamp")
    want = catalog.REGISTRY["rolling_features_30d"](spark, str(tmp_path)).drop("feature_timestamp")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    run, = written(spark, "stream_rolling") - before
    rows = [r[0] for r in spark.read.parquet(f"{run}/facts").groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(rows) == 1600 and len(rows) > 12 and max(rows) < 400  # of 16 files
    assert spark.read.parquet(f"{run}/store/clock").count() == 2
