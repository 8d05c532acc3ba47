"""Literal arrays built as one SQL expression must carry the exact doubles."""

import math

from hypothesis import given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from facsimile.functions.consts import double_array, long_array, long_to_longs_map


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=300))
def test_double_array_exact(spark, values):
    got = spark.range(1).select(double_array(values).alias("a")).first()["a"]
    assert len(got) == len(values)
    for v, g in zip(values, got):
        assert v == g and math.copysign(1.0, v) == math.copysign(1.0, g)


def test_special_values_and_longs(spark):
    r = spark.range(1).select(double_array([math.inf, -math.inf, -0.0, 5e-324, math.nan]).alias("a"),
                              long_array([0, -7, 2 ** 62]).alias("b"),
                              long_to_longs_map({3: [1, 2], 400000: [9]}).alias("m")).first()
    a = r["a"]
    assert a[:2] == [math.inf, -math.inf] and math.copysign(1.0, a[2]) < 0 and a[3] == 5e-324
    assert math.isnan(a[4])
    assert r["b"] == [0, -7, 2 ** 62] and r["m"] == {3: [1, 2], 400000: [9]}


def test_folded_to_one_literal(spark):
    plan = spark.range(3).select(double_array([0.5, 1.5]).alias("a"))._jdf.queryExecution().optimizedPlan()
    assert "array(" not in plan.toString().lower()


def test_const_map_text_keys_exact(spark):
    from facsimile.functions.consts import const_map
    keys = ["a", "O'Brien", "back\\slash", "tab\tand\nnewline", "ünï €", "1-URGENT", ""]
    m = const_map({k: i * 10 for i, k in enumerate(keys)})
    df = spark.createDataFrame([(k,) for k in keys] + [("missing",)], "k string")
    got = {r["k"]: r["v"] for r in df.select("k", m[F.col("k")].alias("v")).collect()}
    assert got == {**{k: i * 10 for i, k in enumerate(keys)}, "missing": None}
    assert const_map({}) is None and const_map({None: 1}) is None
    pid = spark.range(3).select(const_map({0: 5, 1: 7, 2: 9})[F.col("id")].alias("v")).collect()
    assert [r["v"] for r in pid] == [5, 7, 9]


def test_string_array_exact(spark):
    from facsimile.functions.consts import string_array
    vals = ["a", "O'Brien", "back\\slash", "tab\tand\nnewline", "ünï €", ""]
    assert spark.range(1).select(string_array(vals).alias("a")).first()["a"] == vals
