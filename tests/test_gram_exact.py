"""Blocked correlations, exact means, typed modes and types, against pandas, fractions and brute force."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facsimile.functions.exact import exact_means
from facsimile.operators import gram, profile


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("block", [256, 3])
def test_correlations_are_those_of_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    monkeypatch.setattr(gram, "PAIRS_PER_PASS", 2 if block == 3 else 64)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 7))
    x[:, 1] += x[:, 0]
    x[:, 2] += 1e6                      # far from 0
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 6] = 5.0                       # constant
    pdf = pd.DataFrame(x, columns=[f"c.{i}" for i in range(7)])
    pdf["k"] = rng.choice(["a", "b", None], 1500, p=[0.9, 0.09, 0.01])
    df = frame(spark, pdf).repartition(6)
    cols = [f"c.{i}" for i in range(7)]
    got = gram.correlations(df, cols, "k").toPandas()
    for k in ("a", "b"):
        want = pdf[pdf.k == k][cols].corr().to_numpy()
        have = got[got.g == k].pivot(index="i", columns="j", values="corr").to_numpy()
        assert np.allclose(have, want, atol=1e-8, equal_nan=True)
    assert got.g.isna().sum() == 49
    whole = gram.correlations(df, cols).toPandas().pivot(index="i", columns="j", values="corr").to_numpy()
    assert np.allclose(whole, pdf[cols].corr().to_numpy(), atol=1e-8, equal_nan=True)
    assert gram.correlations(df.limit(0), cols).count() == 0


def test_many_columns_are_planned_quickly(spark):
    import time
    wide = spark.createDataFrame(pd.DataFrame(np.random.default_rng(0).normal(size=(40, 600)), columns=[f"w{i}" for i in range(600)]))
    start = time.time()
    out = gram.correlations(wide, wide.columns)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - start < 20
    assert out.count() == 360_000


VALUES = {
    "normal": np.random.default_rng(0).normal(size=400),
    "wide": np.random.default_rng(1).normal(size=400) * 10.0 ** np.random.default_rng(2).integers(-300, 300, 400),
    "tiny": np.array([3e-19, 4e-19] * 200),
    "cancel": np.array([1e300, -1e300, 1.5, 5e-324] * 100),
    "powers": 2.0 ** np.random.default_rng(3).integers(-1074, 1023, 400) * np.random.default_rng(4).choice([-1, 1], 400),
    "below": np.nextafter(2.0 ** (18 * np.random.default_rng(5).integers(-50, 50, 400)), 0),
    "zero": np.zeros(400), "most": np.full(400, 1.7976931348623157e308),
}


def test_means_are_exact_on_any_partitioning(spark):
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in VALUES.values()))), ", ".join(f"{k} double" for k in VALUES))
    want = {c: float(sum(map(Fraction, v.tolist()), Fraction(0)) / len(v)) for c, v in VALUES.items()}
    for parts in (1, 7):
        assert exact_means(df.repartition(parts), list(VALUES)) == {(None, c): m for c, m in want.items()}
    assert exact_means(df.limit(0), ["tiny"]) == {(None, "tiny"): None}
    odd = spark.createDataFrame([(0, 1.0, math.inf), (0, None, 1.0), (1, 2.0, math.inf), (1, 4.0, -math.inf)], "g int, a double, b double")
    got = exact_means(odd, ["a", "b"], "g")
    assert got[0, "a"] == 1.0 and got[1, "a"] == 3.0 and got[0, "b"] == math.inf and math.isnan(got[1, "b"])


def test_describe_with_infinite_values(spark):
    x = [1.0, 2.0, math.inf, None, 4.0, -math.inf, 3.0]
    got = profile.describe(spark.createDataFrame([(v, 3e-19 if i % 2 else 4e-19) for i, v in enumerate(x)], "x double, y double")).collect()
    r = {q["column"]: q for q in got}
    assert r["x"]["count"] == 6 and r["x"]["min"] == -math.inf and r["x"]["max"] == math.inf and math.isnan(r["x"]["mean"])
    assert (r["x"]["p25"], r["x"]["p50"], r["x"]["p75"]) == (1.25, 2.5, 3.75)
    assert r["y"]["mean"] == float((4 * Fraction(4e-19) + 3 * Fraction(3e-19)) / 7)


def test_modes_and_tops_keep_types(spark):
    rows = [(9, "b", 1.5)] * 3 + [(10, "a", -2.5)] * 3 + [(11, None, None)] * 2 + [(None, "c", 0.0)] * 3
    df = spark.createDataFrame(rows, "n int, `s.t` string, d double")
    assert {r["column"]: (r["mode"], r["mode_count"]) for r in profile.modes(df, df.columns).collect()} == {
        "n": ("9", 3), "s.t": ("a", 3), "d": ("-2.5", 3)}
    got = [tuple(r) for r in profile.top_values(df, ["n", "s.t"], 2).collect()]
    assert sorted(got) == [("n", 1, "9", 3), ("n", 2, "10", 3), ("s.t", 1, "a", 3), ("s.t", 2, "b", 3)]
    assert profile.top_values(df.limit(0), ["n"], 2).count() == 0


@pytest.mark.parametrize("values, want", [
    (["1", " 2 ", "-3"], "bigint"), (["1", "2.5", "1e5"], "double"), (["1d", "2"], "string"), (["TRUE", "false"], "boolean"),
    (["2020-01-31"], "date"), (["2020-02-30"], "string"), (["2020-01-01", "2020-01-01 10:00:00"], "timestamp"),
    (["2020-01-01T10:00:00.5"], "timestamp"), (["true", "1"], "string"), ([None, None], None), (["99999999999999999999"], "double")])
def test_type_of_text_values(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    r = profile.type_profile(df).first()
    assert (r["read_as"], r["non_null"], r["missing"]) == (want, sum(v is not None for v in values), sum(v is None for v in values))


def test_type_of_numbers(spark):
    df = spark.createDataFrame([(1.0, 1.5, None), (None, 2.0, None)], "a double, b double, c double")
    assert [r["read_as"] for r in profile.type_profile(df).orderBy("position").collect()] == ["bigint", "double", None]
