"""Session helpers: one place that knows the settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the package assumes. Timestamps are NTZ and the
# comparisons against the SQL oracle need a fixed zone.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # tasks that list the folders of a partitioned table, instead of one for each folder
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # rows of long texts go to Python: a batch of the default 10,000 would be large
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "routecraft", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (UI off, loopback driver). Being
    local, it may use a scratch folder of this machine as its shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="routecraft-shared-"))
    )
    for key, value in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_engine_conf(spark: SparkSession) -> list[str]:
    """Set the engine's settings on a given session; returns the settings that
    did not take (static in this deployment or locked by the caller)."""
    refused = []
    for key, value in ENGINE_CONF.items():
        try:
            spark.conf.set(key, value)
        except Exception:  # noqa: BLE001 - reported to the caller, not hidden
            refused.append(key)
            continue
        if spark.conf.get(key, None) != value:
            refused.append(key)
    return refused


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: ``spark.checkpoint.dir``,
    else ``spark.sql.warehouse.dir``. A path without a scheme, or with ``file:``,
    is accepted as it stands when it was set (clusters may mount one shared
    file system); the default warehouse, a folder of the driver's machine, is
    accepted on a local master only."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    given = context.getConf().get("spark.sql.warehouse.dir", None)
    if not context.master.startswith("local") and (not given or given.startswith("file:")):
        raise RuntimeError(
            "no shared folder: set spark.checkpoint.dir to a folder that the driver and all executors can reach "
            f"(the warehouse {warehouse} is local to one machine)")
    return warehouse.rstrip("/")


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder, as given (not unique)."""
    return "/".join([shared_folder(spark), "routecraft", *parts])


def run_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique to this call, so that runs
    side by side never touch each other's files."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


# paths of the hand-off tables that the innermost ``settled`` will remove
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def hand_off(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: every
    consumer sees the same rows, and the lineage is cut on storage that outlives
    any executor."""
    path = run_path(df.sparkSession, name)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows of ``make()``, handed off. The tables that were handed off on the way are
    removed then: the result is read from its own table and nothing else is. Only paths
    of this very call go; an outer ``settled`` removes this result in its turn."""
    passing: list[str] = []
    try:
        token = _PASSING.set(passing)
        try:
            df = make()
        finally:
            _PASSING.reset(token)
        return hand_off(df, name)
    finally:
        for path in passing:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
