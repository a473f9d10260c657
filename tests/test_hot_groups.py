"""Running totals and positions over rows that span many partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from routecraft.operators.matrix import cost_matrix_long, cost_matrix_pivot
from routecraft.operators.running import running_total
from routecraft.operators.scenarios import with_position


def rows(spark, n):
    """A hot group, tied order values and a carried column of uneven width."""
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 3).cast("string"))).alias("g"),
        F.floor(F.col("id") / 7).alias("o"), "id", (F.col("id") % 5).alias("v"),
        F.repeat(F.lit("x"), ((F.col("id") % 97) * (F.col("id") % 3)).cast("int")).alias("wide"))


def test_running_total_equals_window(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = rows(spark, 500_000)
        got = running_total(df, ["g"], ["o", "id"], "v", "before", totals={"all": ("sum", F.col("v"))})
        w = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, -1)
        want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("before"),
                         F.sum("v").over(Window.partitionBy("g")).alias("all"))
        cols = ["id", "g", "before", "all"]
        assert got.count() == 500_000
        assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_positions_are_distinct(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = with_position(rows(spark, 300_000), ["id"])
        assert got.where("_position <> id").count() == 0
        assert got.count() == 300_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_pivot_keeps_new_customers(spark):
    df = spark.createDataFrame([("w1", "a", 1.0), ("w1", "new", 2.0), ("w2", "a", 3.0)], "warehouse string, customer string, composite_cost double")
    assert cost_matrix_long(cost_matrix_pivot(df)).count() == 3


def test_two_constraint_documents(spark, tmp_path):
    from routecraft.sources.files import read_constraints_json
    (tmp_path / "c.json").write_text('{"warehouses": {"a": {"capacity": 1.0}}}\n{"warehouses": {"b": {"capacity": 2.0}}, "customers": {"x": {"demand": 1.0}}}\n')
    caps, dems = read_constraints_json(spark, str(tmp_path))
    assert (caps.count(), dems.count()) == (2, 1)


def test_equal_spine_rows_do_not_double(spark):
    from routecraft.operators.asof import recompute_asof
    from routecraft.sources.fact import seed_facts
    f = seed_facts(spark)
    one = f.select("warehouse", "customer", F.max("last_updated").over(Window.partitionBy("warehouse", "customer")).alias("ts")).distinct()
    got = recompute_asof(one.unionAll(one), f).groupBy("sample_count").count().collect()
    single = recompute_asof(one, f).groupBy("sample_count").count().collect()
    assert {r[0]: r[1] for r in got} == {r[0]: 2 * r[1] for r in single}


def test_variance_merge_with_large_mean(spark):
    from routecraft.operators.features import merge_partials, route_partials
    from routecraft.sources.fact import seed_facts
    f = seed_facts(spark).withColumn("fuel_price_per_liter", F.lit(1e9) + (F.monotonically_increasing_id() % 3) * 0.01)
    f = f.withColumn("part", F.monotonically_increasing_id() % 2).cache()
    got = {(r[0], r[1]): r[2] for r in merge_partials(route_partials(f, ["warehouse", "customer", "part"])).select("warehouse", "customer", "fuel_price_volatility").collect()}
    want = f.groupBy("warehouse", "customer").agg(F.stddev_samp("fuel_price_per_liter").alias("s")).collect()
    assert all(abs(got[r[0], r[1]] - r[2]) < 1e-4 for r in want)
