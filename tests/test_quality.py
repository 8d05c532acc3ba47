import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.operators import quality as Qy


def _np_shape(o, s):
    """H8 by numpy: the mean over columns of the correlation of both sides' counts in twenty bins of the
    original's range, none below 0; columns that are constant or flat in counts say nothing, and 0.7 if none says anything."""
    def counts(x, lo, hi):
        return np.histogram(x, np.linspace(lo, hi, 21))[0]

    scores = []
    for c in o.columns:
        pair = [counts(t[c], o[c].min(), o[c].max()) for t in (o, s)] if min(o[c].std(), s[c].std()) > 0 else [np.zeros(20)] * 2
        if np.ptp(pair[0]) and np.ptp(pair[1]):
            scores.append(float(np.clip(np.corrcoef(*pair)[0, 1], 0, None)))
    return sum(scores) / len(scores) if scores else 0.7


def test_identical_tables_score_one(spark, tables):
    ev = tables("events").select("event_id", "user_id", "value")
    p = {r["column"]: r for r in Qy.mean_std_preservation(ev, ev).collect()}
    assert all(math.isclose(r["mean_preservation"], 1.0) and math.isclose(r["std_preservation"], 1.0)
               for r in p.values())
    u = Qy.utility_fidelity(ev, ev).first()
    assert math.isclose(u["utility_score"], 1.0) and math.isclose(u["fidelity_score"], 1.0)
    assert math.isclose(Qy.corr_preservation(ev, ev).first()[0], 1.0)


def test_similarity_matches_numpy(spark, tables):
    ev = tables("events", "/root/testdata/sf0.01").select("event_id", "user_id", "value")
    a, b = ev.where(F.col("event_id") % 2 == 0), ev.where(F.col("event_id") % 2 == 1)
    o, s = a.toPandas().astype(float), b.toPandas().astype(float)
    got = Qy.similarity_summary(a, b).first()
    mean_sim = np.mean(1 - np.abs(o.mean() - s.mean()) / (np.abs(o.mean()) + 1e-10))
    std_sim = np.mean(1 - np.abs(o.std() - s.std()) / (np.abs(o.std()) + 1e-10))
    assert math.isclose(got["mean_similarity"], mean_sim, rel_tol=1e-9)
    assert math.isclose(got["std_similarity"], std_sim, rel_tol=1e-9)
    assert math.isclose(got["shape_similarity"], _np_shape(o, s), rel_tol=1e-9)


def test_corr_preservation_matches_numpy(spark, tables):
    li = tables("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    a, b = li.limit(3000), li.orderBy(F.desc("l_extendedprice")).limit(3000)
    o, s = a.toPandas(), b.toPandas()
    ref = np.corrcoef(o.corr().values.flatten(), s.corr().values.flatten())[0, 1]
    assert math.isclose(Qy.corr_preservation(a, b).first()[0], ref, rel_tol=1e-9)


def test_zero_mean_and_overall_name(spark):
    o = spark.createDataFrame([(-1.0, 1.0), (1.0, 2.0)], "x double, overall double")
    s = spark.createDataFrame([(0.5, 1.0), (0.5, 2.0)], "x double, overall double")
    rows = {r["column"]: r for r in Qy.mean_std_preservation(o, s).collect()}
    assert set(rows) == {"x", "overall", "__overall__"}
    assert math.isclose(rows["x"]["mean_preservation"], 1 - 0.5 / 1e-10)


def test_preconditions(spark):
    a = spark.createDataFrame([(1.0, "x")] * 10, "p double, t string")
    b = spark.createDataFrame([(1.0,)] * 10, "q double")
    with pytest.raises(ValueError):
        Qy.similarity_summary(a, b)                      # no common numeric column
    with pytest.raises(ValueError):
        Qy.similarity_summary(a, a)                      # only one numeric column
    c = spark.createDataFrame([(1.0, 2.0)] * 4, "p double, q double")
    with pytest.raises(ValueError):
        Qy.similarity_summary(c, c)                      # fewer than 5 rows


def test_out_of_range_synthetic_skips_shape(spark):
    o = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "x double, y double")
    s = spark.createDataFrame([(1000.0 + i, 500.0 + i % 3) for i in range(50)], "x double, y double")
    assert Qy.similarity_summary(o, s).first()["shape_similarity"] == 0.7


def test_structure_and_bands(spark, tables):
    o = tables("orders")
    r = Qy.structure_compare(o, o.limit(10)).first()
    assert r["original_rows"] == o.count() and r["synthetic_rows"] == 10 and r["all_columns_kept"]
    empty = o.limit(0)
    assert Qy.structure_compare(empty, o).first()["size_ratio"] == 0.0
    df = spark.createDataFrame([(0.85,), (0.8,), (0.7,), (0.2,)], "v double")
    assert [r[0] for r in df.select(Qy.band(F.col("v"))).collect()] == ["good", "good", "medium", "low"]


def test_privacy_label_and_tier(spark):
    df = spark.createDataFrame([("Low", 150000), ("Medium", 60000), ("High", 50000), ("x", 1)], "l string, n long")
    got = [tuple(r) for r in df.select(Qy.privacy_label(F.col("l")), Qy.size_tier(F.col("n"))).collect()]
    assert got == [("Medium-Low", "large"), ("Medium", "medium"), ("High", "small"), ("Medium", "small")]
