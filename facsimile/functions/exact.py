"""Exact sums of doubles, the same on any partitioning.

A double is a whole number of halves, quarters, ... so a sum of doubles has an exact
value.  Here every finite value is taken apart into three whole numbers on the scale
of its size (bins of 18 powers of two); whole numbers add up exactly in any order, and
the few sums per bin are put together as fractions on the driver.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18       # powers of two in a bin: a column's values lie in 117 bins at most


def _bin(x: Column) -> Column:
    """Number of the bin of a finite value other than 0, else null."""
    return F.when((x != 0) & (F.abs(x) < float("inf")), F.floor(F.log2(F.abs(x)) / F.lit(float(BITS))).cast("int"))


def _parts(x: Column, k: int) -> list[Column]:
    """Three whole numbers, signed: |x| = (a + b / 2**27 + c / 2**53) * 2**(18 k).

    The logarithm may miss a bin's limit by its last bit, so the scaled value is between
    a half and 2**18 (or just above); its last bit is worth 2**-53 at least.
    """
    half = -BITS * k // 2
    r = F.abs(x) * F.lit(2.0 ** half) * F.lit(2.0 ** (-BITS * k - half))      # powers of two: exact
    a = F.floor(r)
    f = (r - a) * F.lit(2.0 ** 27)
    b = F.floor(f)
    c = ((f - b) * F.lit(2.0 ** 26)).cast("long")
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    return [sign * a, sign * b, sign * c]


def exact_means(df: DataFrame, columns: list[str], by: str | None = None) -> dict[tuple, float | None]:
    """{(group, column): mean} of double columns, correctly rounded; group None without ``by``.

    Nulls do not count.  A column with an infinite value has an infinite mean, or NaN
    with both.  Two jobs: which bins there are, then sums of longs per partition, added up
    as decimals, so no number of rows overflows.  ``by`` has a few groups.
    """
    keys = [F.col(by).alias("g")] if by else [F.lit(None).cast("string").alias("g")]
    x = {c: F.col(c) for c in columns}
    seen = df.groupBy(*keys).agg(*[e for i, c in enumerate(columns) for e in (
        F.count(x[c]).alias(f"n{i}"), F.collect_set(_bin(x[c])).alias(f"b{i}"),       # at most 117 numbers
        F.count_if(x[c] == float("inf")).alias(f"p{i}"), F.count_if(x[c] == -float("inf")).alias(f"m{i}"))]).collect()
    bins = {i: sorted({k for r in seen for k in r[f"b{i}"]}) for i in range(len(columns))}
    sums = {}
    wanted = [(i, k, j) for i in bins for k in bins[i] for j in range(3)]
    if wanted:
        exprs = []
        for i, c in enumerate(columns):
            own = _bin(x[c])
            for k in bins[i]:
                exprs += [F.sum(F.when(own == k, p)).alias(f"s{i}_{k + 200}_{j}") for j, p in enumerate(_parts(x[c], k))]
        part = df.groupBy(*keys, F.spark_partition_id().alias("pid")).agg(*exprs)
        whole = part.groupBy("g").agg(*[F.sum(F.col(f"s{i}_{k + 200}_{j}").cast("decimal(28,0)")).alias(f"s{i}_{k + 200}_{j}") for i, k, j in wanted])
        for r in whole.collect():
            for i in bins:
                sums[r["g"], i] = sum(
                    (Fraction(int(r[f"s{i}_{k + 200}_{j}"] or 0)) * Fraction(2) ** (BITS * k - (0, 27, 53)[j]) for k in bins[i] for j in range(3)),
                    Fraction(0))
    out = {}
    for r in seen:
        for i, c in enumerate(columns):
            n, up, down = r[f"n{i}"], r[f"p{i}"], r[f"m{i}"]
            if not n:
                value = None
            elif up or down:
                value = math.nan if up and down else math.inf if up else -math.inf
            else:
                value = float(sums.get((r["g"], i), Fraction(0)) / n)
            out[r["g"], c] = value
    if not by and not seen:
        out = {(None, c): None for c in columns}
    return out
