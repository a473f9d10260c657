"""A store of day rows that a stream adds to, safe to replay.

Each micro-batch writes below the store, in folders named by its batch id:

    days/batch_id=N    partial rows per (route, day) of the batch's rows in time
    late/batch_id=N    the batch's rows that came too late, as they are
    clock/batch_id=N   the newest observation time of the batch, and its row counts

A batch overwrites its own folders and reads only those of lower ids, so running it
again, after a failure or by hand, changes nothing. A row is late if its day had
ended by the newest time of the *earlier* batches less the allowed lateness, the
rule by which a watermark drops rows; here they are counted and kept. Rows without
an observation time are late too, as they belong to no day.

Readers merge the partial rows of a (route, day) over the batches (``read_days``);
``compact`` folds the batches up to an id into a base folder, so that their number
stays small. The base is named by that id and used only once it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import PARTIAL_COLUMNS, roll_up_partials
from ..schemas import ROUTE_KEYS
from .daily import daily_partials

CLOCK = "newest timestamp_ntz, on_time bigint, late bigint, batch_id bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[int]:
    """Ids N of the complete folders ``path/batch_id=N`` (a few names, read on the driver)."""
    if not _exists(spark, path):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    ids = [int(n.split("=")[1]) for n in names if n.startswith("batch_id=")]
    return sorted(i for i in ids if _exists(spark, f"{path}/batch_id={i}/_SUCCESS"))


def _read(spark: SparkSession, store: str, kind: str, schema) -> DataFrame:
    """The rows of all complete batches, with batch_id."""
    ids = _children(spark, f"{store}/{kind}")
    if not ids:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{store}/{kind}").parquet(*[f"{store}/{kind}/batch_id={i}" for i in ids])
    return rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))


def read_clock(spark: SparkSession, store: str) -> DataFrame:
    """newest, on_time and late of each batch_id."""
    return _read(spark, store, "clock", CLOCK)


def read_late(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """The rows that came too late, with the batch_id they came in."""
    return _read(spark, store, "late", T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))


def add_batch(store: str, lateness_days: int = 1, keys: list[str] = ROUTE_KEYS):
    """The ``foreachBatch`` function that adds a micro-batch to the store."""
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_clock(spark, store).where(F.col("batch_id") < batch_id).agg(F.max("newest").alias("t")).first()["t"]
        day_end = F.date_trunc("day", "last_updated").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
        late = F.col("last_updated").isNull()
        if before is not None:
            late = late | (day_end <= F.lit(before).cast("timestamp_ntz") - F.make_dt_interval(F.lit(lateness_days)))
        tagged = batch.withColumn("_late", late)
        tagged.where("_late").drop("_late").write.mode("overwrite").parquet(f"{store}/late/batch_id={batch_id}")
        daily_partials(tagged.where("not _late"), keys).write.mode("overwrite").parquet(f"{store}/days/batch_id={batch_id}")
        tagged.agg(F.max("last_updated").alias("newest"), F.count_if(~F.col("_late")).alias("on_time"),
                   F.count_if("_late").alias("late")).write.mode("overwrite").parquet(f"{store}/clock/batch_id={batch_id}")
    return add


def run_upserts(spark: SparkSession, source: str, schema: T.StructType, store: str, checkpoint: str,
                lateness_days: int = 1, files_per_batch: int | None = None) -> None:
    """Add every file that is there now to the store, then stop."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (reader.parquet(source).writeStream.foreachBatch(add_batch(store, lateness_days))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def _parts(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    bases = [i for i in _children(spark, f"{store}/base") if upto is None or i <= upto]
    ids = [i for i in _children(spark, f"{store}/days") if (not bases or i > bases[-1]) and (upto is None or i <= upto)]
    paths = [f"{store}/base/batch_id={i}" for i in bases[-1:]] + [f"{store}/days/batch_id={i}" for i in ids]
    if not paths:
        raise ValueError(f"no batch in {store}")
    return spark.read.parquet(*paths)


def read_days(spark: SparkSession, store: str, keys: list[str] = ROUTE_KEYS) -> DataFrame:
    """One partial row for each (route, day) over all batches."""
    return roll_up_partials(_parts(spark, store).select(*keys, "day", *PARTIAL_COLUMNS), [*keys, "day"])


def compact(spark: SparkSession, store: str, upto: int, keys: list[str] = ROUTE_KEYS) -> None:
    """Fold the batches up to ``upto`` into one base; readers then skip their folders."""
    if upto in _children(spark, f"{store}/base"):
        return
    rows = roll_up_partials(_parts(spark, store, upto).select(*keys, "day", *PARTIAL_COLUMNS), [*keys, "day"])
    rows.write.mode("overwrite").parquet(f"{store}/base/batch_id={upto}")
