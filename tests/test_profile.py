import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facsimile.operators import profile as P
from facsimile.schema import is_year_name


def test_describe_matches_pandas(spark, tables):
    li = tables("lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"]
    got = {r["column"]: r for r in P.describe(li, cols).collect()}
    pdf = li.select(*cols).toPandas()
    d = pdf.describe()
    for c in cols:
        for k, m in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                     ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
            assert math.isclose(got[c][k], d.loc[m, c], rel_tol=1e-9, abs_tol=1e-9), (c, k)


@pytest.mark.parametrize("limit", [10, 100, 10 ** 6])
def test_exact_quantiles_bracket_rounds(spark, tables, limit):
    """Force the narrowing rounds with a tiny group limit; results must stay exact."""
    li = tables("lineitem", "/root/testdata/sf0.01")
    cols = ["l_extendedprice", "l_orderkey", "l_quantity"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = P.exact_quantiles(li, cols, probs, group_limit=limit, accuracy=200)
    pdf = li.select(*cols).toPandas()
    for c in cols:
        for p in probs:
            assert math.isclose(got[(c, p)], float(np.quantile(pdf[c], p)), rel_tol=1e-12), (c, p)


def test_quantiles_with_nulls_and_ties(spark):
    vals = [None, 1.0, 1.0, 1.0, 2.0, None, 5.0, float("nan"), 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = P.exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], group_limit=1, accuracy=50)
    s = pd.Series([v for v in vals if v is not None and not math.isnan(v)])
    for p in (0.25, 0.5, 0.75):
        assert math.isclose(got[("x", p)], s.quantile(p))


def test_profile_edges(spark):
    df = spark.createDataFrame([(None, 3.0, 5.0, None), (None, 3.0, None, "a")],
                               "all_null double, constant double, one_row double, s string")
    n, specs = P.profile(df)
    by = {s.name: s for s in specs}
    assert n == 2
    assert by["all_null"].count == 0 and by["all_null"].mean is None
    assert by["constant"].std == 0.0
    assert by["one_row"].count == 1 and by["one_row"].std is None
    assert by["s"].nulls == 1 and by["s"].distinct == 2   # 'a' and the fill 'Unknown'


def test_distinct_50_51_exact(spark):
    df = spark.createDataFrame([(f"v{i}", f"w{i % 50}") for i in range(51)], "a string, b string")
    _, specs = P.profile(df)
    by = {s.name: s for s in specs}
    assert by["a"].distinct == 51 and by["a"].distinct_exact
    assert by["b"].distinct == 50


def test_year_names():
    assert [is_year_name(n) for n in ["year", "yr", "fiscal_year", "year_built", "update_count", "yr_built"]] == \
        [True, True, True, True, True, False]


def test_year_values(spark):
    rows = [(1900.0, 1899.9, float(1900 + i % 199), float(1900 + i % 200), None if i == 0 else 2100.0, 2100.1)
            for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    _, specs = P.profile(df)
    by = {s.name: s.year_by_value for s in specs}
    assert by == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": False}


def test_frequencies_and_mode(spark, tables):
    part = tables("part")
    got = {(r["column"], r["value"]): r["count"] for r in P.value_frequencies(part, ["p_brand"]).collect()}
    pdf = part.select("p_brand").toPandas()
    assert got == {("p_brand", k): v for k, v in pdf["p_brand"].value_counts().items()}
    m = P.modes(part, ["p_brand"]).first()
    assert m["mode"] == pdf["p_brand"].mode()[0]


def test_histogram_matches_numpy(spark, tables):
    ev = tables("events", "/root/testdata/sf0.01")
    h = P.histogram(ev, ["value"]).orderBy("bin").collect()
    counts, edges = np.histogram(ev.select("value").toPandas()["value"], bins=20)
    assert [r["count"] for r in h] == counts.tolist()
    assert np.allclose([r["lo"] for r in h], edges[:-1])


def test_correlation_matrix_matches_pandas(spark, tables):
    li = tables("lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    got = {(r["col_i"], r["col_j"]): r["corr"] for r in P.correlation_matrix(li, cols).collect()}
    ref = li.select(*cols).toPandas().corr()
    for a in cols:
        for b in cols:
            assert math.isclose(got[(a, b)], ref.loc[a, b], abs_tol=1e-12)


def test_correlation_pairwise_nulls_and_constant(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 6.5, 5.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, k double")
    got = {(r["col_i"], r["col_j"]): r["corr"] for r in P.correlation_matrix(df, ["a", "b", "k"]).collect()}
    ref = pd.DataFrame(rows, columns=["a", "b", "k"]).corr()
    assert math.isclose(got[("a", "b")], ref.loc["a", "b"], abs_tol=1e-12)
    assert got[("a", "k")] is None   # zero variance: null, never an ANSI error


def test_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, "x")], "a double, b string")
    got = {r["column"]: r["missing"] for r in P.missing_by_column(df).collect()}
    assert got == {"a": 1, "b": 1}


def test_many_probabilities_forced_rounds(spark, tables):
    from statistics import NormalDist
    li = tables("lineitem", "/root/testdata/sf0.01")
    probs = [NormalDist().cdf(-4 + 0.05 * k) for k in range(161)]
    got = P.exact_quantiles(li, ["l_extendedprice", "l_orderkey"], probs, group_limit=50, accuracy=500)
    pdf = li.select("l_extendedprice", "l_orderkey").toPandas()
    for c in ("l_extendedprice", "l_orderkey"):
        ref = np.quantile(pdf[c], probs)
        assert np.allclose([got[(c, p)] for p in probs], ref, rtol=1e-12, atol=1e-9)
