"""Literal numeric arrays and maps built as one SQL expression.

``F.array(*[F.lit(v) for v in values])`` costs one driver-to-JVM call per value; the
quantile passes and the copula carry hundreds of knots per column, which made plan
construction slower than the jobs themselves.  Here the whole constant is one
expression string, parsed once in the JVM and folded to a single literal by the
optimizer.  Doubles are written with Python's shortest round-trip form, which the JVM
parses back to the same bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_double(v: float) -> str:
    v = float(v)
    if math.isnan(v):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(v):
        return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
    text = repr(abs(v)).upper() + "D"
    return f"(-{text})" if math.copysign(1.0, v) < 0 else text


def sql_long(v: int) -> str:
    return f"CAST({int(v)} AS BIGINT)"


def double_array(values) -> Column:
    """array<double> literal."""
    if not values:
        return F.expr("CAST(array() AS ARRAY<DOUBLE>)")
    return F.expr("array(" + ", ".join(sql_double(v) for v in values) + ")")


def long_array(values) -> Column:
    if not values:
        return F.expr("CAST(array() AS ARRAY<BIGINT>)")
    return F.expr("array(" + ", ".join(sql_long(v) for v in values) + ")")


def long_to_longs_map(entries: dict[int, list[int]]) -> Column:
    """map<bigint, array<bigint>> literal."""
    body = ", ".join(f"{sql_long(k)}, array({', '.join(sql_long(x) for x in v)})" for k, v in entries.items())
    return F.expr(f"map({body})")


def sql_string(v: str) -> str:
    """Exact text literal for any characters: UTF-8 bytes as a hex binary, cast back."""
    return f"CAST(X'{v.encode('utf-8').hex()}' AS STRING)"


def _sql_value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return sql_long(v)
    if isinstance(v, float):
        return sql_double(v)
    if isinstance(v, str):
        return sql_string(v)
    raise TypeError(f"no SQL literal for {type(v).__name__}")


def const_map(entries: dict) -> Column | None:
    """map literal from a dict of str/int keys to int/float/str values (None values
    become typed nulls of the other values' type).  Returns None for an empty dict or a
    None key, which a map cannot hold; callers keep their own path for those."""
    if not entries or any(k is None for k in entries):
        return None
    present = [v for v in entries.values() if v is not None]
    if any(isinstance(v, float) for v in present):
        vals = {k: (None if v is None else float(v)) for k, v in entries.items()}
        null = "CAST(NULL AS DOUBLE)"
    else:
        vals = dict(entries)
        null = "CAST(NULL AS BIGINT)" if all(isinstance(v, int) for v in present) else "CAST(NULL AS STRING)"
    body = ", ".join(f"{_sql_value(k)}, {null if v is None else _sql_value(v)}" for k, v in vals.items())
    return F.expr(f"map({body})")


def string_array(values: list[str]) -> Column:
    """array<string> literal (exact for any characters)."""
    if not values:
        return F.expr("CAST(array() AS ARRAY<STRING>)")
    return F.expr("array(" + ", ".join(sql_string(v) for v in values) + ")")
