from pyspark.sql import functions as F

from facsimile.plans.batch import run_batch
from facsimile.plans.generate import run_generation
from facsimile.schema import SynthConfig
from facsimile.sources import io


def test_generation_flow(spark, tables, tmp_path):
    src = tables("orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    io.write_csv(src.coalesce(1), str(tmp_path / "in"))
    fake, method, report = run_generation(spark, str(tmp_path / "in"), str(tmp_path / "out"),
                                          SynthConfig(method="copula", num_samples=500))
    assert method == "copula" and fake.count() == 500
    assert set(fake.columns) == set(src.columns)
    r = {(x["section"], x["column"], x["metric"]): x["value"] for x in report.collect()}
    assert r[("structure", None, "synthetic_rows")] == 500.0
    assert r[("preservation", "__overall__", "mean_preservation")] > 0.8
    assert io.read_json(spark, str(tmp_path / "out" / "synthetic_json")).count() == 500


def test_batch_flow(spark, tables, tmp_path):
    o = tables("orders").select("o_totalprice", "o_orderstatus")
    for k in range(3):
        io.write_csv(o.where(F.col("o_totalprice") % 3 == k).coalesce(1), str(tmp_path / f"part{k}"))
    files = [str(p) for k in range(3) for p in (tmp_path / f"part{k}").glob("*.csv")]
    (tmp_path / "broken.csv").write_text("o_totalprice,o_orderstatus\n1,F,extra,fields\n")
    st = run_batch(spark, files + [str(tmp_path / "broken.csv")], str(tmp_path / "out"))
    rows = {r["dataset"]: r for r in st.collect()}
    assert sum(1 for r in rows.values() if r["status"] == "Success") == 3
    assert rows["broken_synthetic.csv"]["status"].startswith("Error")
    assert all(k.endswith("_synthetic.csv") for k in rows)
