"""Readers for the parquet tables of a data folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazily read ``<data_dir>/<name>.parquet``; projections and filters
    applied later are pushed into this scan by Catalyst."""
    return spark.read.parquet(os.path.join(data_dir, f"{name}.parquet"))
