"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import hand_off, run_path, settled

__all__ = ["fold_ascii", "fresh", "hand_off", "row_key", "run_path", "settled", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row: its id and whole text. Rows equal in both are one and
    get one decision; rows that share an id but not the text stay apart."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.col(text).isNull())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
