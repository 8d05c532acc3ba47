"""Copulas of many datasets, latent correlations, mixed files, workbooks, the registry and the report's limits."""

import io as _io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facsimile.functions.latent import PROBS, Marginal, latent_correlation
from facsimile.operators import copula_groups as CG
from facsimile.operators import quality
from facsimile.operators.clean import fill_median
from facsimile.operators.copula import fit_copula, synthesize_copula
from facsimile.operators.encode import preprocess
from facsimile.operators.synth import synthesize_independent
from facsimile.plans.batch import run_batch, synthesize_batch
from facsimile.plans.generate import select_strict, synthesize
from facsimile.registry import Registry
from facsimile.schema import SynthConfig
from facsimile.sources import io


@pytest.mark.parametrize("rho", [-0.8, 0.3, 0.95])
def test_latent_correlation_undoes_steps(rho):
    z = np.random.default_rng(0).multivariate_normal([0, 0], [[1, rho], [rho, 1]], 100_000)
    for cuts in (([-0.5, 0.2], [0.3]), ([0.0], [0.0]), ([-1.0, 0.0, 1.0], None)):
        own, scores = [], []
        for k, t in enumerate(cuts):
            if t is None:
                own.append(Marginal(len(z), knots=np.quantile(z[:, k], PROBS), ends=(z[:, k].min(), z[:, k].max())))
                scores.append(own[-1].scores(z[:, k]))
            else:
                v = np.searchsorted(t, z[:, k])
                own.append(Marginal(len(z), values=list(range(len(t) + 1)), cum=np.cumsum(np.bincount(v)) / len(v)))
                scores.append(own[-1].scores(v))
        r = np.corrcoef(scores)
        assert abs(r[0, 1]) < abs(rho) + 0.01 and latent_correlation(r, own)[0, 1] == pytest.approx(rho, abs=0.02)


def datasets(spark, names=("a", "b", None, "d'x.csv"), n=1500):
    rng = np.random.default_rng(0)
    parts = []
    for name, rho in zip(names, (0.9, -0.7, 0.0, 0.5)):
        z = rng.multivariate_normal([0, 0], [[1, rho], [rho, 1]], n)
        parts.append(pd.DataFrame({
            "dataset": name, "id": np.exp(z[:, 0]), "x.y": z[:, 1] * 10 + 50, "two": np.where(z[:, 0] > 0.3, 100, 1),
            "cat": np.where(z[:, 1] > 0.5, "hi", "lo"), "free": [f"{name}{int(v)}" for v in rng.integers(0, 90, n)],
            "day": [None if v % 9 == 0 else pd.Timestamp("2020-01-01") + pd.Timedelta(days=int(v)) for v in rng.integers(0, 50, n)],
            "none": np.nan, "one": 5.0}))
    pdf = pd.concat(parts, ignore_index=True)
    kind = "dataset string, id double, `x.y` double, two int, cat string, free string, day timestamp, none double, one double"

    def plain(v):
        if v is pd.NaT or v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    return pdf, spark.createDataFrame([tuple(map(plain, r)) for r in pdf.astype(object).itertuples(index=False)], kind)


def test_datasets_keep_their_own_correlations(spark, monkeypatch):
    pdf, df = datasets(spark)
    fake, status = CG.synthesize_groups(df)
    got = fake.toPandas()
    assert fake.columns == ["dataset", "_id", "id", "x.y", "two", "cat", "free", "day", "none", "one"]
    assert {(r[0], r[1], r[2], r[3]) for r in status.collect()} == {(n, 1500, 1500, "Success") for n in ("a", "b", None, "d'x.csv")}
    for name in ("a", "b", None, "d'x.csv"):
        a, b = (p[p.dataset.isna()] if name is None else p[p.dataset == name] for p in (pdf, got))
        assert sorted(b._id) == list(range(1500))
        want = np.corrcoef(np.log(a.id), a["x.y"])[0, 1]
        assert np.corrcoef(np.log(b.id.clip(lower=0.005)), b["x.y"])[0, 1] == pytest.approx(want, abs=0.06)
        assert set(b.two) == {1.0, 100.0} and np.corrcoef(b.two, b["x.y"])[0, 1] == pytest.approx(np.corrcoef(a.two, a["x.y"])[0, 1], abs=0.08)
        assert (b.cat == "hi").mean() == pytest.approx((a.cat == "hi").mean(), abs=0.05)
        assert set(b.free) <= set(a.free) and set(b.day) <= set(a.day.dropna()) and b.none.isna().all() and set(b.one) == {5.0}
        assert a.id.min() - 0.01 <= b.id.min() and b.id.max() <= a.id.max() + 0.01
    # dealt over several tasks, and drawn in small chunks: the same rows
    for key, value in (("HOT_ROWS", 100), ("HOT_PARTS", 1000), ("CHUNK", 128), ("CHUNKS", 2)):
        monkeypatch.setattr(CG, key, value)
    again = CG.synthesize_groups(df.repartition(7))[0].toPandas()
    order = ["dataset", "_id"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))


def test_a_dataset_that_fails_does_not_stop_the_others(spark, monkeypatch):
    _, df = datasets(spark, n=200)
    real = CG._marginal

    def broken(rows):
        if any(r[3] == "b3" for r in rows) or rows[0][5] == 199:
            raise ValueError("no model for this one")
        return real(rows)

    monkeypatch.setattr(CG, "_marginal", broken)
    df = df.where("dataset <> 'b' or dataset is null").unionByName(df.where("dataset = 'b'").limit(199)).drop("day")
    fake, status = CG.synthesize_groups(df)
    state = {r["dataset"]: (r["synthetic_rows"], r["status"]) for r in status.collect()}
    assert state == {"a": (200, "Success"), None: (200, "Success"), "d'x.csv": (200, "Success"), "b": (0, "Error: ValueError: no model for this one")}
    assert {r[0]: r[1] for r in fake.groupBy("dataset").count().collect()} == {"a": 200, None: 200, "d'x.csv": 200}


def test_many_datasets_in_a_fixed_number_of_jobs(spark):
    def jobs(n):
        df = spark.range(0, 20 * n).select((F.col("id") % n).cast("string").alias("dataset"), (F.xxhash64("id") % 1000).alias("x"))
        spark.sparkContext.setJobGroup(f"n{n}", "")
        fake, status = CG.synthesize_groups(df)
        assert fake.count() == 20 * n and status.where("status = 'Success'").count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"n{n}"))

    few, many = jobs(3), jobs(300)
    spark.sparkContext.setJobGroup("other", "")
    assert many <= few + 6      # the adaptive planner's own jobs may differ


def test_empty_batch(spark):
    _, df = datasets(spark, n=20)
    fake, status = CG.synthesize_groups(df.limit(0))
    assert fake.count() == 0 and status.count() == 0


@pytest.mark.parametrize("method", ["independent", "copula"])
def test_columns_called_id_and_dotted(spark, method):
    rows = [(i, float(i % 40) + 0.5 * (i % 7), "ab"[i % 2], f"t{i % 70}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, `a.b` double, `c d.e` string, `free text.` string")
    fake, used = synthesize(df, SynthConfig(method=method, keep_id=True))
    assert used == method and fake.columns == ["_id", *df.columns] and fake.count() == 400
    assert {r[0] for r in fake.select("`c d.e`").distinct().collect()} == {"a", "b"}
    batch = synthesize_batch(df.withColumn("dataset", F.lit("k")), config=SynthConfig(method=method))
    assert batch.columns == ["dataset", "_id", *df.columns] and batch.count() == 400
    rep = quality.quality_report(df, fake.select(*[F.col(f"`{c}`") for c in df.columns]), used)
    assert rep.where("section = 'structure' and metric = 'method'").first()["note"] == method
    with pytest.raises(ValueError, match="no such columns"):
        select_strict(df, ["a.b", "zz"])
    assert select_strict(df, ["a.b", "id"]).columns == ["a.b", "id"]


def test_default_method_is_the_copula(spark):
    df = spark.createDataFrame([(float(i), float(i) + 0.1 * (i % 3)) for i in range(300)], "a double, b double")
    fake, used = synthesize(df)
    x = fake.toPandas()
    assert used == "copula" and np.corrcoef(x.a, x.b)[0, 1] > 0.99


def test_draws_of_few_values(spark):
    df = spark.createDataFrame([(1 if i % 3 else 100, float(i % 3) - 1.0, float(i)) for i in range(3000)], "n int, h double, c double")
    out = synthesize_copula(df, SynthConfig(num_samples=20_000)).toPandas()
    assert set(out.n) == {1.0, 100.0} and set(out.h) == {-1.0, 0.0, 1.0}
    assert (out.n == 100).mean() == pytest.approx(1 / 3, abs=0.02)
    model = fit_copula(df)
    assert abs(model.corr[0, 1]) > 0.9 and model.steps("n") and not model.steps("c")      # n is 100 just where h is least


def test_null_dataset_in_the_independent_batch(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 2.0, "b"), ("k", 5.0, "c")], "dataset string, x double, s string")
    got = synthesize_batch(df, config=SynthConfig(method="independent"))
    assert {r[0]: r[1] for r in got.groupBy("dataset").count().collect()} == {None: 2, "k": 1}
    assert {r["s"] for r in got.where("dataset is null").collect()} <= {"a", "b"}


def test_files_of_different_layouts(spark, tmp_path):
    files = {"a.csv": "x,y\n1,p\n2,q\n", "b.csv": "y,x\nr,3\n", "c.csv": "x,z\n4,\"line\nbreak, and \"\"quotes\"\"\"\n", "d.csv": "x,y\n", "e.csv": "",
             "f.csv": "x,y\n1,2,3\n5,s\n", "g h.csv": " y , x \nt,6\n", "i.csv": "x,x\n7,8\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in files] + [str(tmp_path / "gone.csv")]
    data, status = io.read_csv_files(spark, paths)
    assert {(r["dataset"], r["status"]) for r in status.collect()} == {
        ("a.csv", "Loaded"), ("b.csv", "Loaded"), ("c.csv", "Loaded"), ("d.csv", "Error: no rows"), ("e.csv", "Error: no header"),
        ("f.csv", "Error: 1 malformed rows"), ("g h.csv", "Loaded"), ("i.csv", "Loaded"), ("gone.csv", "Error: no such file")}
    got = sorted((r["dataset"], r["x"], r["y"], r["z"], r["x.1"]) for r in data.collect())
    assert got == [("a.csv", 1, "p", None, None), ("a.csv", 2, "q", None, None), ("b.csv", 3, "r", None, None),
                   ("c.csv", 4, None, 'line\nbreak, and "quotes"', None), ("g h.csv", 6, "t", None, None), ("i.csv", 7, None, None, 8)]
    none, status = io.read_csv_files(spark, [str(tmp_path / "gone.csv")])
    assert none.count() == 0 and status.count() == 1


def test_csv_of_several_lines_and_the_splittable_read(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('id,text\n1,"two\nlines"\n2,plain\n3,"say ""so"""\n')
    assert [tuple(r) for r in io.read_csv(spark, str(p)).collect()] == [(1, "two\nlines"), (2, "plain"), (3, 'say "so"')]
    with pytest.raises(ValueError, match="several lines"):
        io.read_csv(spark, str(p), splittable=True)
    q = tmp_path / "u.csv"
    q.write_text('id,text\n2,plain\n3,"say ""so"""\n4,1d\n')
    assert [tuple(r) for r in io.read_csv(spark, str(q), splittable=True).collect()] == [(2, "plain"), (3, 'say "so"'), (4, "1d")]


def test_batch_of_mixed_and_bad_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    for k in range(4):
        x = rng.normal(size=200)
        cols = {"x": x, "y": 2 * x + 0.1 * rng.normal(size=200)} | ({"z": x - 1} if k == 3 else {})
        pd.DataFrame(cols)[sorted(cols, reverse=k == 1)].to_csv(tmp_path / f"f{k}.csv", index=False)
    (tmp_path / "bad.csv").write_text("x,y\n1,2,3\n")
    st = run_batch(spark, [str(tmp_path / n) for n in ("f0.csv", "f1.csv", "f2.csv", "f3.csv", "bad.csv")], str(tmp_path / "out"))
    got = {r["dataset"]: (r["original_rows"], r["synthetic_rows"], r["status"]) for r in st.collect()}
    assert got == {**{f"f{k}_synthetic.csv": (200, 200, "Success") for k in range(4)}, "bad_synthetic.csv": (1, 0, "Error: 1 malformed rows")}
    two = io.read_batch(spark, str(tmp_path / "out" / "layout=0")).toPandas()
    assert set(two.columns) == {"dataset", "x", "y"} and len(two) == 600
    assert all(np.corrcoef(g.x, g.y)[0, 1] > 0.98 for _, g in two.groupby("dataset"))


def book(sheets, first="sheet1.xml", styles="", rels=True):
    buf = _io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buf, "w") as z:
        for name, rows in sheets.items():
            body = ""
            for i, r in rows:
                cells = "".join(c for c in r)
                body += f'<row r="{i}">{cells}</row>'
            z.writestr(f"xl/worksheets/{name}", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        if rels:
            z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                                          '<sheets><sheet name="one" sheetId="2" r:id="rId9"/><sheet name="two" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                                     f'<Relationship Id="rId1" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="worksheets/{first}"/></Relationships>')
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
    return buf.getvalue()


def text(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def number(ref, v, style=0):
    return f'<c r="{ref}" s="{style}"><v>{v}</v></c>'


def test_workbooks(spark, tmp_path):
    styles = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd;@"/><numFmt numFmtId="165" formatCode="0.0&quot; days&quot;"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>')
    # the first sheet is sheet7.xml; row 3 is short, row 4 is left out
    one = [(1, [text("A1", " name "), text("B1", "day"), text("C1", "n")]), (2, [text("A2", "a"), number("B2", 43831, 1), number("C2", 1.5, 3)]),
           (3, [text("A3", "b")]), (5, [text("A5", "c"), number("B5", 43831.75, 2), number("C5", 3, 3)])]
    (tmp_path / "one.xlsx").write_bytes(book({"sheet7.xml": one, "sheet1.xml": [(1, [text("A1", "wrong")])]}, "sheet7.xml", styles))
    # names in another order and one more
    two = [(1, [text("A1", "n"), text("B1", "name"), text("C1", "more")]), (2, [number("A2", 9), text("B2", "d"), text("C2", "x")])]
    (tmp_path / "two.xlsx").write_bytes(book({"sheet1.xml": two}, rels=False))
    df = io.read_excel(spark, str(tmp_path))
    assert df.columns == ["name", "day", "n", "more", "source_file"] and dict(df.dtypes)["day"] == "timestamp_ntz" and dict(df.dtypes)["n"] == "double"
    got = sorted((r["name"], str(r["day"]), r["n"], r["more"], r["source_file"]) for r in df.collect())
    assert got == [("a", "2020-01-01 00:00:00", 1.5, None, "one.xlsx"), ("b", "None", None, None, "one.xlsx"),
                   ("c", "2020-01-01 18:00:00", 3.0, None, "one.xlsx"), ("d", "None", 9.0, "x", "two.xlsx")]


def test_workbooks_are_built_by_many_tasks_and_parsed_once(spark, tmp_path):
    df = spark.range(0, 900, 1, 1).select("id", F.concat(F.lit("row "), "id").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("part"))
    books = io.workbooks(df, 100)
    paths = [r["path"] for r in books.select("path").collect()]
    assert len({p.split("-")[1] for p in paths}) == 4 and len(set(paths)) == len(paths) == 12
    assert io.workbooks(df.limit(150), 100).count() == 2 and io.workbooks(df.limit(0), 100).count() == 0

    def seen(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(tmp_path / path, "a") as f:
                    f.write("x")
            yield b

    back = io.workbook_table(books.mapInArrow(seen, books.schema)).drop("source_file")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert {f.name: f.read_text() for f in tmp_path.iterdir()} == dict.fromkeys(paths, "x")


def test_medians_of_dates_keep_their_type(spark):
    df = spark.sql("""SELECT * FROM VALUES (DATE '2020-01-01', TIMESTAMP '2020-01-01 00:00:00', TIMESTAMP_NTZ '2020-01-01 00:00:00'), (NULL, NULL, NULL),
                      (DATE '2020-01-04', TIMESTAMP '2020-01-01 00:00:01', TIMESTAMP_NTZ '2020-01-03 00:00:00') t(d, t, n)""")
    out = fill_median(df, ["d", "t", "n"])
    assert out.dtypes == df.dtypes
    assert tuple(map(str, out.where("d = DATE '2020-01-02'").first())) == ("2020-01-02", "2020-01-01 00:00:00.500000", "2020-01-02 00:00:00")
    coded, _ = preprocess(df)
    assert coded.where("d is null or t is null or n is null").count() == 0 and coded.dtypes == df.dtypes


def test_registry_finds_the_same_content(spark, tmp_path):
    reg = Registry(spark, str(tmp_path / "reg"))
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "x").alias("a.b"))
    one = reg.register("my data!", df)
    two = reg.register("my data!", df.repartition(9))
    assert not one.reused and two.reused and one.digest == two.digest and two.rows == 100
    assert spark.table("my_data").count() == 100 and reg.names() == ["my_data"]
    three = reg.register("my data!", df.where("id < 99"))
    assert three.digest != one.digest and not three.reused and len(reg.snapshots("my data!")) == 2
    assert reg.get("my data!", one.digest).count() == 100 and spark.table("my_data").count() == 99
    null = reg.register("n", spark.createDataFrame([(None, "a")], "x string, y string"))
    assert null.digest != reg.register("n", spark.createDataFrame([("a", None)], "x string, y string")).digest
    with pytest.raises(KeyError):
        reg.get("nothing")


def test_report_says_why_a_section_is_missing(spark):
    a = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "a double, s string")
    rows = {(r["section"], r["metric"]): r for r in quality.quality_report(a, a, "copula").collect()}
    assert "not only 'a'" in rows["similarity", "status"]["note"] and rows["structure", "method"]["note"] == "copula"
    assert "two shared numeric columns" in rows["components", "status"]["note"] and ("preservation", "status") in rows


def test_independent_draws_unchanged_by_names(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(50)], "x double, s string")
    a = synthesize_independent(df, SynthConfig(keep_id=True)).toPandas()
    b = synthesize_independent(df, SynthConfig(keep_id=True)).toPandas()
    pd.testing.assert_frame_equal(a.sort_values("id").reset_index(drop=True), b.sort_values("id").reset_index(drop=True))
