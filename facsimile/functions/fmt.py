"""Rounding, casting and blank tests shared by cleaning and formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace-only: (?U) makes \s match Unicode spaces such as the no-break space.
BLANK_PATTERN = r"(?U)^\s*$"
LEADING_SPACE = r"(?U)^\s+"
TRAILING_SPACE = r"(?U)\s+$"


def round2(c: Column) -> Column:
    """Two decimals, half to even (numpy ``round(2)``), as double."""
    return F.bround(c.cast("double"), 2)


def round_year(c: Column) -> Column:
    """Year cast: half-even to an integer, nulls stay null."""
    return F.bround(c.cast("double"), 0).cast("bigint")


def is_blank(c: Column) -> Column:
    """Empty or whitespace-only.  The regex only runs when the first character is a
    space of some kind, so ordinary text costs one short check."""
    return (c == F.lit("")) | (F.substring(c, 1, 1).rlike(r"(?U)\s") & c.rlike(BLANK_PATTERN))


def strip(c: Column) -> Column:
    """Python ``str.strip()``: removes tabs and no-break spaces too (``trim`` does not)."""
    return F.regexp_replace(F.regexp_replace(c, LEADING_SPACE, ""), TRAILING_SPACE, "")


def to_number(c: Column) -> Column:
    """pandas ``to_numeric(errors='coerce')``: unparsable text becomes null.

    The cast alone also reads Java's literals ('1d', '10F', '0x1p3'), which are text here.
    """
    return F.when(~c.cast("string").rlike(r"(?i)[0-9.][df]\s*$|0x"), c.try_cast("double"))


def percent_text(part: Column, whole: Column | None = None, digits: int = 1) -> Column:
    """A share as text, '12.5%'; with ``whole`` the part of it ('0.0%' of nothing).  Rounded half up on the value's own digits."""
    share = part if whole is None else F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
    return F.concat(F.round(share * 100, digits).cast(f"decimal(38,{digits})").cast("string"), F.lit("%"))


def ratio_text(part: Column, whole: Column, digits: int = 2) -> Column:
    """How many times ``whole`` goes into ``part`` as text, '1.25x'; '0.00x' of nothing."""
    times = F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
    return F.concat(F.round(times, digits).cast(f"decimal(38,{digits})").cast("string"), F.lit("x"))


def whole_moment(c: Column, dt: T.DataType) -> Column:
    """Days or microseconds of the epoch as a double, which holds them exactly for the years 1685 to 2255."""
    return (F.unix_date(c) if isinstance(dt, T.DateType) else F.unix_micros(c.cast("timestamp"))).cast("double")


def moment_of(value: float | Column, dt: T.DataType) -> Column:
    """The date or timestamp of so many days or microseconds; of a part of one, the earlier."""
    whole = F.lit(math.floor(value)) if isinstance(value, float) else F.floor(value)
    if isinstance(dt, T.DateType):
        return F.date_from_unix_date(whole.cast("int"))
    return F.timestamp_micros(whole.cast("long")).cast(dt)
