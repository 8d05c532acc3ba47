"""Type formatting: year-like columns to integers, other numbers to 2 decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from facsimile.functions.names import named
from facsimile.functions.fmt import round2, round_year
from facsimile.operators.profile import profile
from facsimile.schema import ColumnSpec, is_short_year_name


def year_rules(df: DataFrame, specs: list[ColumnSpec] | None = None) -> DataFrame:
    """(column, by_name, by_value, is_year) for the numeric columns."""
    if specs is None:
        _, specs = profile(df)
    rows = [(s.name, s.year_by_name, s.year_by_value, s.is_year) for s in specs if s.kind == "numeric"]
    return df.sparkSession.createDataFrame(rows, "column string, by_name boolean, by_value boolean, is_year boolean")


def format_types(df: DataFrame, specs: list[ColumnSpec] | None = None, rule: str = "full",
                 floats_only: bool = False, keep_int: bool = False) -> DataFrame:
    """G6 in one projection.

    ``rule='full'``: year by name or by value; ``rule='short'``: only the names year/yr
    or the value rule (the display formatter).  ``floats_only`` touches only float
    columns (the comparison table); otherwise ints become 2-decimal doubles too unless
    ``keep_int``.  The rule is decided on ``specs`` -- by default the table's own
    profile; pass the source's specs to format a synthetic table by the source's rule.
    """
    if specs is None:
        _, specs = profile(df)
    by = {s.name: s for s in specs}
    out = []
    for f in df.schema.fields:
        c, dt = f.name, f.dataType
        s = by.get(c)
        is_float = isinstance(dt, (T.DoubleType, T.FloatType))
        is_num = isinstance(dt, T.NumericType)
        if s is None or not is_num or s.kind != "numeric":
            out.append(named(c))
            continue
        year = (is_short_year_name(c) or s.year_by_value) if rule == "short" else s.is_year
        if floats_only and not is_float:
            out.append(named(c))
        elif year:
            out.append(round_year(named(c)).alias(c))
        elif keep_int and not is_float:
            out.append(named(c))
        else:
            out.append(round2(named(c)).alias(c))
    return df.select(*out)
