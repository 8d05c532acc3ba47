"""Cleaning: missing-value fills, tolerant casts, numeric matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from facsimile.functions.names import named
from facsimile.functions.fmt import is_blank, moment_of, to_number, whole_moment
from facsimile.operators.profile import medians, num
from facsimile.schema import BLANK_FILL, ColumnSpec, kind_of, numeric_columns


def fill_unknown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, empty and whitespace-only strings become 'Unknown'."""
    cols = set(columns)
    return df.select(*[
        (F.when(named(c).isNull() | is_blank(named(c)), F.lit(BLANK_FILL)).otherwise(named(c)).alias(c)
         if c in cols else named(c)) for c in df.columns])


def fill_median(df: DataFrame, columns: list[str], values: dict | None = None) -> DataFrame:
    """Missing numbers (NaN too), dates and timestamps become the column's exact median.

    A whole-number column becomes double, since its median may lie between two values.
    Dates and timestamps keep their type; a median between two days is the earlier one, and one
    between two timestamps is theirs to the microsecond.  Medians are computed only for
    the columns asked for; pass ``values`` (numbers; microseconds or days of the epoch) to reuse them.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [c for c in df.columns if c in set(columns)]
    numbers = df.select(*[(whole_moment(named(c), types[c]) if kind_of(types[c]) == "temporal" else named(c)).alias(c) for c in cols])
    vals = values if values is not None else medians(numbers, cols)
    out = []
    for c in df.columns:
        if c not in cols or vals.get(c) is None:
            out.append(named(c))
        elif kind_of(types[c]) == "temporal":
            out.append(F.coalesce(named(c), moment_of(vals[c], types[c])).alias(c))
        else:
            filled = F.coalesce(num(c, types[c]), F.lit(float(vals[c])))
            out.append((filled.cast(types[c]) if isinstance(types[c], FractionalType) else filled).alias(c))
    return df.select(*out)


def fill_empty_columns(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """A column with no value at all becomes the constant 0."""
    empty = {s.name for s in specs if s.count == 0}
    return df.select(*[(F.lit(0).alias(c) if c in empty else named(c)) for c in df.columns])


def to_text(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = set(columns)
    return df.select(*[(named(c).cast("string").alias(c) if c in cols else named(c)) for c in df.columns])


def coerce_numeric(df: DataFrame, column: str, fill: str = "median") -> DataFrame:
    """``to_numeric(errors='coerce')``: text to double, unparsable -> null, then filled
    with the median of the parsed values (``fill='median'``) or 0 (``fill='zero'``)."""
    parsed = df.withColumn(column, to_number(named(column)))
    if fill == "zero":
        return parsed.withColumn(column, F.coalesce(named(column), F.lit(0.0)))
    return fill_median(parsed, [column])


def downcast_float(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numbers to 32-bit float (loses integers above 2**24; opt-in)."""
    cols = set(columns if columns is not None else numeric_columns(df))
    return df.select(*[(named(c).cast("float").alias(c) if c in cols else named(c)) for c in df.columns])


def numeric_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric columns only, as double, missing -> 0 (input of PCA and similarity)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = columns if columns is not None else numeric_columns(df)
    return df.select(*[F.coalesce(num(c, types[c]), F.lit(0.0)).alias(c) for c in cols])
