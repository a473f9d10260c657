"""Casts with the conversion rules of the scenario interface.

Capacities and demands are truncated to whole units (-7.9 -> -7); text that
is not a number becomes null and is reported as an error row by the planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CAPACITY_COLUMNS, COST_COLUMNS, DEMAND_COLUMNS


def to_units(col: Column) -> Column:
    """Truncating conversion to a whole number of units (bigint): -7.9 -> -7;
    NaN, '100.5' and non-numeric text -> null."""
    return col.try_cast("bigint")


def to_cost(col: Column) -> Column:
    """Conversion of a unit cost to double; NaN and unparsable text -> null."""
    d = col.try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def to_timestamp_ntz(col: Column, dtype: T.DataType) -> Column:
    """ISO-8601 text or timestamp -> timestamp without time zone; unparsable -> null."""
    if isinstance(dtype, T.StringType):
        return col.try_cast("timestamp_ntz")
    return col.cast("timestamp_ntz")


def cast_scenarios(df: DataFrame) -> DataFrame:
    """Apply the scenario conversions to whichever scenario columns exist.

    Adds ``_invalid_inputs`` listing the columns whose non-null input failed to
    convert, so the planner can turn them into error rows.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    bad = []
    for name, dtype in types.items():
        c = F.col(name)
        if name in CAPACITY_COLUMNS or name in DEMAND_COLUMNS:
            conv = to_units(c)
        elif name in COST_COLUMNS:
            conv = to_cost(c)
        elif name == "feature_timestamp":
            conv = to_timestamp_ntz(c, dtype)
        else:
            out.append(c)
            continue
        out.append(conv.alias(name))
        # a NaN cost is a missing value, not one that cannot be converted
        read = c.try_cast("double") if name in COST_COLUMNS else conv
        bad.append(F.when(c.isNotNull() & read.isNull(), F.lit(name)))
    invalid = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.select(*out, invalid.alias("_invalid_inputs"))
