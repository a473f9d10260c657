"""Moments, rolling features, late rows, replayed batches, the day-partitioned table."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from routecraft.operators.asof import asof_join, monthly_snapshots, recompute_asof, snapshots_from_partials
from routecraft.operators.features import merge_partials, roll_up_partials, route_features, route_partials
from routecraft.schemas import FACT_SCHEMA
from routecraft.sources.fact import create_fact_table, fact_from_tpch, read_fact_days, replace_days
from routecraft.streaming.daily import daily_partials, rolling_features
from routecraft.streaming.upsert import add_batch, compact, read_clock, read_days, read_late, run_upserts
from tests.conftest import SF001

T0 = dt.datetime(2024, 1, 1)
MEASURES = [f.name for f in FACT_SCHEMA.fields][2:-1]


def facts(spark, rows):
    """rows: (warehouse, customer, price, time); the other measures follow from the price."""
    return spark.createDataFrame(
        [(w, c, 10.0, p, 8.0 + i % 3, 0.8, 1.0, 1.0, 0.9 + (i % 5) / 19, 1.0, t) for i, (w, c, p, t) in enumerate(rows)], FACT_SCHEMA)


def large_prices(n, seed, days=90):
    """Prices near 1e9 that differ by about 0.01, on irregular times."""
    rng = random.Random(seed)
    return [(f"w{rng.randrange(2)}", "c", 1e9 + rng.random() * 0.02, T0 + dt.timedelta(seconds=rng.randrange(days * 86400))) for _ in range(n)]


def features_of(rows):
    """(volatility, count, min, max) of rows (price, ...)."""
    p = [r[2] for r in rows]
    return (statistics.stdev([x - 1e9 for x in p]) if len(p) > 1 else None, len(p), min(p), max(p))


def same(got, want):
    assert (got.sample_count, got.min_fuel_price, got.max_fuel_price) == want[1:]
    assert (got.fuel_price_volatility is None) == (want[0] is None)
    if want[0] is not None:
        assert got.fuel_price_volatility == pytest.approx(want[0], rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("lookback", [1, 7, 30])
def test_rolling_moments_of_large_prices(spark, lookback):
    rows = large_prices(400, lookback)
    got = rolling_features(daily_partials(facts(spark, rows)), lookback).collect()
    assert len(got) == len({(r[0], r[3].date()) for r in rows})
    for g in got:
        same(g, features_of([r for r in rows if r[0] == g.warehouse and 0 <= (g.day - r[3].date()).days < lookback]))


@pytest.mark.parametrize("lookback", [1, 2, 30, 200])
def test_recompute_against_brute_force(spark, lookback):
    rows = large_prices(300, lookback) + [("w0", "c", 1e9, T0 + dt.timedelta(days=5))] * 3
    rng = random.Random(1)
    asks = [("w0", "c", r[3]) for r in rows[:20]] + [("w1", "c", T0 + dt.timedelta(seconds=rng.randrange(120 * 86400))) for _ in range(20)]
    asks += [("w0", "c", T0 + dt.timedelta(days=d)) for d in (-3, 0, 5, 5 + lookback, 400)] + [("none", "c", T0), (None, "c", T0), ("w0", "c", None)]
    spine = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "i int, warehouse string, customer string, ts timestamp_ntz")
    got = {r.i: r for r in recompute_asof(spine, facts(spark, rows), lookback_days=lookback).collect()}
    assert len(got) == len(asks)
    for i, (w, c, ts) in enumerate(asks):
        seen = [r for r in rows if r[0] == w and ts is not None and ts - dt.timedelta(days=lookback) <= r[3] <= ts]
        if seen:
            same(got[i], features_of(seen))
        else:
            assert got[i].sample_count is None, asks[i]


def test_recompute_equals_features(spark):
    f = fact_from_tpch(spark, SF001)
    at = dt.datetime(1997, 3, 5)
    spine = f.select("warehouse", "customer", F.lit(at).cast("timestamp_ntz").alias("ts")).distinct()
    got = {(r.warehouse, r.customer): r for r in recompute_asof(spine, f).where("sample_count is not null").collect()}
    want = route_features(f, as_of=at).collect()
    assert len(got) == len(want) > 0
    for r in want:
        for c in r.__fields__:
            g = got[r.warehouse, r.customer][c]
            assert g == r[c] or g == pytest.approx(r[c], rel=1e-9, abs=1e-9), c


def test_snapshots_from_partials(spark):
    f = fact_from_tpch(spark, SF001)
    a = {(r.warehouse, r.customer, r.snapshot_ts): r for r in monthly_snapshots(f).collect()}
    b = snapshots_from_partials(route_partials(f, ["warehouse", "customer", "last_updated"])).collect()
    assert len(a) == len(b)
    for r in b:
        assert r.composite_cost == pytest.approx(a[r.warehouse, r.customer, r.snapshot_ts].composite_cost)
        assert r.sample_count == a[r.warehouse, r.customer, r.snapshot_ts].sample_count


def test_roll_up_reads_its_input_once(spark):
    f = fact_from_tpch(spark, SF001)
    plan = merge_partials(route_partials(f, ["warehouse", "customer", "last_updated"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == 4  # lineitem, orders, customer, supplier


def test_empty_groups_and_null_prices(spark):
    f = facts(spark, [("a", "c", None, T0), ("a", "c", None, T0), ("b", "c", 2.0, T0), ("b", "c", None, T0), (None, "c", 1.0, T0), (None, "c", 3.0, T0)])
    got = {r.warehouse: r for r in merge_partials(roll_up_partials(route_partials(f, ["warehouse", "customer", "seasonal_factor"]), ["warehouse", "customer"])).collect()}
    assert got["a"].fuel_price_volatility is None and got["a"].min_fuel_price is None and got["a"].sample_count == 2
    assert got["b"].fuel_price_volatility is None and got["b"].max_fuel_price == 2.0
    assert got[None].fuel_price_volatility == pytest.approx(2 ** 0.5)
    assert merge_partials(route_partials(f.limit(0), ["warehouse", "customer"])).count() == 0


def test_asof_many_snapshots_of_one_route(spark):
    n = 1_000_000
    second = F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id * 60)")
    snaps = spark.range(n).select(F.lit("w").alias("warehouse"), F.lit("c").alias("customer"), second.alias("snapshot_ts"), F.col("id").alias("v"))
    spine = spark.range(-5, n, 997).select("id", F.lit("w").alias("warehouse"), F.lit("c").alias("customer"),
                                           F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, 0, 0, id * 60 + 30)").alias("ts"))
    out = asof_join(spine, snaps, ["warehouse", "customer"], bucket_days=7)
    assert out.where("v is null").count() == 1 and out.where("v <> id").count() == 0 and out.count() == spine.count()
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_asof_ties_gaps_and_nulls(spark):
    d = lambda *a: dt.datetime(2024, *a)
    snaps = spark.createDataFrame([("a", d(1, 1), 1), ("a", d(1, 1), 5), ("a", d(6, 1), 7), ("b", None, 9), (None, d(1, 1), 8)], "k string, snapshot_ts timestamp_ntz, v int")
    spine = spark.createDataFrame([(1, "a", d(1, 1)), (2, "a", d(5, 31)), (3, "a", d(12, 1)), (4, "b", d(5, 1)), (5, None, d(5, 1)), (6, "a", None),
                                   (7, "a", dt.datetime(2023, 1, 1)), (1, "a", d(1, 1))], "i int, k string, ts timestamp_ntz")
    got = sorted((r.i, r.v) for r in asof_join(spine, snaps, ["k"], bucket_days=10).collect())
    assert got == [(1, 5), (1, 5), (2, 5), (3, 7), (4, None), (5, None), (6, None), (7, None)]
    assert asof_join(spine, snaps.limit(0), ["k"]).where("v is null").count() == 8
    assert asof_join(spine.limit(0), snaps, ["k"]).count() == 0


def batch(spark, rows):
    return facts(spark, [("w", "c", p, t) for p, t in rows])


def test_late_rows_are_kept(spark, tmp_path):
    day = lambda n, h=0: T0 + dt.timedelta(days=n, hours=h)
    source, store, ckpt = (str(tmp_path / x) for x in ("facts", "store", "ckpt"))
    batches = [[(1.0, day(0)), (2.0, day(10, 5))], [(3.0, day(9, 1)), (4.0, day(8, 23)), (5.0, day(9, 4)), (6.0, day(11)), (7.0, None)], [(8.0, day(8)), (9.0, day(10, 1))]]
    for rows in batches:
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
        run_upserts(spark, source, FACT_SCHEMA, store, ckpt)
    # newest 10d5h less a day: days that ended by 9d5h, so up to day 8, are late in the second batch
    late = sorted(r.fuel_price_per_liter for r in read_late(spark, store, FACT_SCHEMA).collect())
    assert late == [4.0, 7.0, 8.0]
    on_time = read_days(spark, store)
    assert on_time.agg(F.sum("n")).first()[0] + len(late) == sum(map(len, batches))
    assert {r.batch_id: (r.on_time, r.late) for r in read_clock(spark, store).collect()} == {0: (2, 0), 1: (3, 2), 2: (1, 1)}
    assert {r.day.day - 1: r.n for r in on_time.collect()} == {0: 1, 9: 2, 10: 2, 11: 1}


def test_replay_and_compaction_change_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    add = add_batch(store)
    rng = random.Random(2)
    rows = [[(1e9 + rng.random(), T0 + dt.timedelta(hours=rng.randrange(24 * (b + 1), 24 * (b + 3)))) for _ in range(60)] for b in range(4)]
    frames = [batch(spark, r) for r in rows]

    def state():
        days = sorted(map(tuple, read_days(spark, store).select("warehouse", "customer", "day", "n", "fuel_n", "min_fuel_price", "max_fuel_price", F.round("fuel_mean", 4), F.round("fuel_m2", 3)).collect()))
        return days, sorted(map(tuple, read_late(spark, store, FACT_SCHEMA).collect())), sorted(map(tuple, read_clock(spark, store).collect()))
    for i, f in enumerate(frames):
        add(f, i)
    first = state()
    for i in (3, 1, 0, 3):
        add(frames[i], i)
        assert state() == first
    compact(spark, store, 2)
    assert state() == first
    compact(spark, store, 2)
    add(frames[1], 1)
    assert state() == first
    add(frames[0], 4)  # a new batch after a base
    assert state()[0] != first[0] or state()[1] != first[1]


def test_fact_days_prune_and_replace(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = [("w", "c", float(i), T0 + dt.timedelta(days=i % 40, hours=i % 24)) for i in range(400)]
    create_fact_table(facts(spark, rows), path)
    near = read_fact_days(spark, path, first="2024-01-11", last="2024-01-20")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_day" in plan and "2024-01-11" in plan
    assert near.count() == 100 and read_fact_days(spark, path).count() == 400
    one, other = (route_features(f, as_of="2024-01-20", lookback_days=9).first() for f in (near, facts(spark, rows)))
    for c in one.__fields__:
        assert one[c] == other[c] or one[c] == pytest.approx(other[c], rel=1e-9), c
    replace_days(facts(spark, [("w", "c", 1.0, T0 + dt.timedelta(days=3))]), path)
    assert read_fact_days(spark, path, "2024-01-04", "2024-01-04").count() == 1 and read_fact_days(spark, path).count() == 391
