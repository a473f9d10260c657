"""Ordered running totals inside groups that may be very large.

``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task. A
group holding a large share of all rows would then be sorted and scanned by a
single core. Here the rows are range-partitioned on (group, order), so a hot
group is cut into contiguous slices on several tasks; each slice computes its
local running total, and the totals of the earlier slices of the same group
(a table of at most groups + slices rows) are added as an offset.

The slice number of a row is stored with the row: two evaluations of a range
partitioning need not cut alike, so the cut is made once, written to the shared
folder, and both the local totals and the offsets read it from there.

Whole-group totals (``totals``) are merged from the same slice table, so the
caller needs no second aggregation and no second pass over its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hand_off

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def running_total(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str,
                  out_col: str, exclusive: bool = True, totals: dict[str, tuple[str, Column]] | None = None,
                  slices: int | None = None, skew_safe: bool = True) -> DataFrame:
    """Add ``out_col`` = sum of ``value_col`` over the rows of the same group
    that come earlier in ``order_cols`` order (``exclusive``) or up to and
    including the row. ``order_cols`` must order the rows of a group totally.

    ``totals``: name -> (kind, expression) with kind in sum/max/min, added as
    whole-group aggregates on every row.
    """
    totals = totals or {}
    frame_end = -1 if exclusive else Window.currentRow
    if not skew_safe:
        w = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, frame_end)
        wg = Window.partitionBy(*group_cols)
        return df.select("*", F.coalesce(F.sum(value_col).over(w), F.lit(0)).alias(out_col),
                         *[_MERGE[k](e).over(wg).alias(n) for n, (k, e) in totals.items()])

    ranged = (df.repartitionByRange(slices, *group_cols, *order_cols) if slices
              else df.repartitionByRange(*group_cols, *order_cols))
    ranged = hand_off(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    # local totals inside each (group, slice); a slice is a contiguous run
    w_local = (Window.partitionBy(*group_cols, "_slice").orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, frame_end))
    local = ranged.withColumn("_local", F.coalesce(F.sum(value_col).over(w_local), F.lit(0)))
    # one small table: per (group, slice) partial sums -> offsets and group totals
    slice_sums = ranged.groupBy(*group_cols, "_slice").agg(
        F.sum(value_col).alias("_slice_sum"),
        *[_MERGE[k](e).alias(f"_part_{n}") for n, (k, e) in totals.items()])
    w_off = Window.partitionBy(*group_cols).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*group_cols)
    offsets = slice_sums.select(
        *group_cols, "_slice",
        F.coalesce(F.sum("_slice_sum").over(w_off), F.lit(0)).alias("_offset"),
        *[_MERGE[k](F.col(f"_part_{n}")).over(w_all).alias(n) for n, (k, _) in totals.items()])
    l, o = local.alias("l"), offsets.alias("o")
    same = F.col("l._slice") == F.col("o._slice")
    for c in group_cols:  # a null group is a group
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    return l.join(o, same).select(
        "l.*", *[F.col(f"o.{n}") for n in totals], (F.col("o._offset") + F.col("l._local")).alias(out_col)
    ).drop("_slice", "_local")
