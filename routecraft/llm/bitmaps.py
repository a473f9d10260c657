"""Bitmaps of a fixed number of cells: a filter whose size never grows with the data.

A cell is set if any key falls into it, so a test by bitmap lets every member
through and, the fuller the bitmap, more of the others; an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 63  # bits used of a long, so that no sign bit is involved
ROW_CELLS = 1 << 24  # cells of the filters that whole rows pass


def _cell(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells))


def bitmap_words(df: DataFrame, key: str, cells: int) -> DataFrame:
    """word, bits: the set words of the bitmap (at most cells / 63 rows)."""
    return (df.select(_cell(F.col(key), cells).alias("_c"))
            .select(F.floor(F.col("_c") / WORD_BITS).cast("int").alias("word"),
                    F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_c"), F.lit(WORD_BITS)).cast("int")).alias("b"))
            .groupBy("word").agg(F.bit_or("b").alias("bits")))


def dense_cells(rows: DataFrame, size: int) -> DataFrame:
    """Rows (word, bits) as one row with an array ``cells`` of ``size`` longs, 0 where no row is."""
    dense = (rows.sparkSession.range(size).select(F.col("id").cast("int").alias("word"))
             .join(rows, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
    chunk = (dense.groupBy(F.floor(F.col("word") / 1024).cast("int").alias("chunk"))
             .agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("part")))
    return chunk.agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "part")))["part"]).alias("cells"))


def bitmap_column(df: DataFrame, key: str, cells: int) -> Column:
    """The bitmap as a scalar array column, for use in any other frame."""
    return dense_cells(bitmap_words(df, key, cells), -(-cells // WORD_BITS)).scalar()


def in_bitmap(bitmap: Column, key: Column, cells: int) -> Column:
    cell = _cell(key, cells)
    return F.bit_get(F.get(bitmap, F.floor(cell / WORD_BITS).cast("int")), F.pmod(cell, F.lit(WORD_BITS)).cast("int")) == 1


def numpy_bitmap(df: DataFrame, key: str, cells: int) -> np.ndarray:
    """A bitmap for tests in Python tasks, by the low bits of the (already mixed)
    64-bit key; ``cells`` is a power of two and bounds what the driver gets."""
    rows = (df.select(F.expr(f"{key} & {cells - 1}L").alias("_c"))
            .select(F.floor(F.col("_c") / 32).cast("int").alias("word"),
                    F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("_c"), F.lit(32)).cast("int")).alias("b"))
            .groupBy("word").agg(F.bit_or("b").alias("bits")).toArrow())
    out = np.zeros(cells // 32, np.uint32)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def numpy_test(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be members."""
    c = keys & np.uint64(len(bitmap) * 32 - 1)
    return (bitmap[(c >> np.uint64(5)).astype(np.int64)] >> (c & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
