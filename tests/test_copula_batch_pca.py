import math

import numpy as np
from pyspark.sql import functions as F

from facsimile.operators import synth
from facsimile.operators.copula import fit_copula, synthesize_copula
from facsimile.operators.pca import pca_scores, pca_variance
from facsimile.plans.batch import batch_status, synthesize_batch
from facsimile.plans.generate import synthesize
from facsimile.schema import SynthConfig


def _correlated(tables):
    li = tables("lineitem", "/root/testdata/sf0.01")
    return li.select(F.col("l_extendedprice").alias("a"),
                     (F.col("l_extendedprice") * 0.3 + F.col("l_quantity") * 700).alias("b"),
                     F.col("l_discount").alias("c"), "l_returnflag")


def test_copula_keeps_correlation_and_marginals(spark, tables):
    src = _correlated(tables)
    out = synthesize_copula(src, SynthConfig(seed=4))
    o, s = src.toPandas(), out.toPandas()
    assert len(s) == len(o)
    co, cs = o[["a", "b", "c"]].corr(), s[["a", "b", "c"]].corr()
    assert abs(co.loc["a", "b"] - cs.loc["a", "b"]) < 0.05
    assert abs(cs.loc["a", "c"]) < 0.05
    for c in ["a", "b", "c"]:
        assert abs(s[c].mean() / o[c].mean() - 1) < 0.02
        assert abs(s[c].std() / o[c].std() - 1) < 0.05
    po = o["l_returnflag"].value_counts(normalize=True)
    ps = s["l_returnflag"].value_counts(normalize=True)
    assert set(po.index) == set(ps.index) and (abs(po - ps) < 0.02).all()


def test_independent_sampler_loses_correlation(spark, tables):
    src = _correlated(tables)
    s = synth.synthesize_independent(src, SynthConfig(seed=4)).toPandas()
    assert abs(s[["a", "b"]].corr().iloc[0, 1]) < 0.05


def test_copula_reproducible_across_partitions(spark, tables):
    src = _correlated(tables)
    model = fit_copula(src)
    assert np.allclose(model.corr, model.corr.T)
    a = synthesize_copula(src.coalesce(1), SynthConfig(seed=9, num_samples=500, keep_id=True))
    b = synthesize_copula(src.repartition(5), SynthConfig(seed=9, num_samples=500, keep_id=True))
    ra, rb = sorted(tuple(r) for r in a.collect()), sorted(tuple(r) for r in b.collect())
    assert len(ra) == len(rb) == 500
    # knots come from an approximate sketch, so allow last-digit differences only
    for x, y in zip(ra, rb):
        assert x[0] == y[0] and x[4] == y[4]
        assert all(math.isclose(p, q, rel_tol=1e-3, abs_tol=0.02) for p, q in zip(x[1:4], y[1:4]))


def test_synthesize_reports_method(spark, tables):
    src = _correlated(tables).limit(2000)
    df, method = synthesize(src, SynthConfig(method="auto", num_samples=100))
    assert method == "copula" and df.count() == 100
    df, method = synthesize(src, SynthConfig(method="independent", num_samples=100), columns=["a", "zz"])
    assert method == "independent" and df.columns == ["a"]


def test_batch_status_and_per_dataset_draws(spark, tables):
    o = tables("orders").select(F.col("o_orderpriority").alias("dataset"), "o_totalprice", "o_orderstatus")
    out = synthesize_batch(o, config=SynthConfig(method="independent", num_samples=300))
    st = {r["dataset"]: r for r in batch_status(o, out).collect()}
    assert set(st) == {r[0] for r in o.select("dataset").distinct().collect()}
    assert all(r["status"] == "Success" and r["synthetic_rows"] == 300 for r in st.values())
    # a dataset's categorical draws only use that dataset's values
    src_pairs = {(r[0], r[1]) for r in o.select("dataset", "o_orderstatus").distinct().collect()}
    got_pairs = {(r[0], r[1]) for r in out.select("dataset", "o_orderstatus").distinct().collect()}
    assert got_pairs <= src_pairs


def test_batch_distributed_lookup_matches(spark, tables, monkeypatch):
    o = tables("orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderstatus")
    a = sorted(tuple(r) for r in synthesize_batch(o).collect())
    monkeypatch.setattr(synth, "DRIVER_FREQ_LIMIT", 0)
    b = sorted(tuple(r) for r in synthesize_batch(o).collect())
    assert a == b


def test_pca_matches_numpy(spark, tables):
    li = tables("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    x = li.toPandas().values
    xc = x - x.mean(axis=0)
    _, sv, vt = np.linalg.svd(xc, full_matrices=False)
    ratio = (sv ** 2) / (sv ** 2).sum()
    got = [r["explained_variance_ratio"] for r in pca_variance(li).orderBy("component").collect()]
    assert np.allclose(got, ratio[:2], rtol=1e-6)
    sc = pca_scores(li, li).where(F.col("side") == "original").toPandas()
    ref = xc @ vt[:2].T
    for j in range(2):
        s = 1.0 if vt[j][np.abs(vt[j]).argmax()] >= 0 else -1.0
        assert np.allclose(np.sort(sc[f"pc{j + 1}"].values), np.sort(ref[:, j] * s), atol=1e-6)


def test_copula_draws_reach_the_source_range(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from facsimile.operators.copula import _latent_frame, sample_copula
    rng = np.random.default_rng(1)
    vals = np.exp(rng.normal(size=30_000)).round(6)
    vals[:2] = 500.0, -40.0         # the extremes, far outside the outer knots
    src = spark.createDataFrame([(float(v), float(w)) for v, w in zip(vals, rng.normal(size=30_000))], "a double, b double")
    model = fit_copula(src)
    lo, hi = model.knots["a"][0], model.knots["a"][-1]
    assert model.ends["a"] == (-40.0, 500.0) and lo > -40 and hi < 500
    z = _latent_frame(src, model, {f.name: f.dataType for f in src.schema.fields}).agg(F.min("z0"), F.max("z0")).first()
    assert z[0] < -4 and z[1] > 4
    got = sample_copula(src, model, 600_000, seed=3, fast=True).select(F.col("a").cast("double"))
    out = got.where((F.col("a") < lo - 0.01) | (F.col("a") > hi + 0.01)).toPandas()["a"]
    assert 10 <= len(out) <= 90 and out.nunique() == len(out)       # 38 expected, spread and not on one knot
    assert out.between(-40, 500).all() and out.max() > hi + 0.8 * (500 - hi) and out.min() < lo - 0.8 * (lo + 40)
