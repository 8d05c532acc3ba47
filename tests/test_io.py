import io as _io
import zipfile

from pyspark.sql import functions as F

from facsimile.sources import io


def test_na_tokens_and_types(spark, tmp_path):
    p = tmp_path / "na.csv"
    p.write_text("a,b,c,d\n1,x,1.5,true\nNA,null,N/A,False\nNaN,,2,\n3,y,1e2,TRUE\n")
    df = io.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "double", "d": "boolean"}
    rows = [tuple(r) for r in df.collect()]
    assert rows == [(1, "x", 1.5, True), (None, None, None, False), (None, None, 2.0, None), (3, "y", 100.0, True)]


def _xlsx(rows) -> bytes:
    def cell(ref, v):
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r)
                                                   if v is not None) + "</row>" for i, r in enumerate(rows))
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
             f'spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    buf = _io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return buf.getvalue()


def test_xlsx_header_in_second_row(spark, tmp_path):
    rows = [["Report title"], [" name ", "score ", "year"], ["a", 1.5, 2001], ["b", 2, 2002]]
    for k in range(2):
        (tmp_path / f"book{k}.xlsx").write_bytes(_xlsx(rows))
    df = io.read_excel(spark, str(tmp_path), header_row=1)
    assert df.columns == ["name", "score", "year", "source_file"]
    got = sorted((r["name"], r["score"], r["year"]) for r in df.collect())
    assert got == [("a", 1.5, 2001), ("a", 1.5, 2001), ("b", 2.0, 2002), ("b", 2.0, 2002)]
    assert dict(df.dtypes)["year"] == "bigint"


def test_bad_batch_file_is_reported_and_skipped(spark, tmp_path):
    (tmp_path / "good1.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "good2.csv").write_text("x,y\n3,c\n")
    (tmp_path / "bad.csv").write_text("x,y\n1,a,zzz,qq\n\x00\x01,2,3\n")
    paths = [str(tmp_path / n) for n in ("good1.csv", "good2.csv", "bad.csv")]
    df, status = io.read_csv_files(spark, paths)
    st = {r["dataset"]: r["status"] for r in status.collect()}
    assert st["good1.csv"] == st["good2.csv"] == "Loaded" and st["bad.csv"].startswith("Error")
    assert sorted(r["x"] for r in df.collect()) == [1, 2, 3]


def test_csv_json_roundtrip(spark, tables, tmp_path):
    o = tables("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    io.write_csv(o, str(tmp_path / "c"))
    io.write_json(o, str(tmp_path / "j"))
    a = sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "c")).collect())
    b = sorted(tuple(r) for r in io.read_json(spark, str(tmp_path / "j"), o.columns).collect())
    ref = sorted(tuple(r) for r in o.collect())
    assert a == ref and b == ref


def test_batch_tree(spark, tables, tmp_path):
    o = tables("orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey")
    io.write_batch(o, str(tmp_path / "t"))
    back = io.read_batch(spark, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in back.groupBy("dataset").count().collect()) == \
        sorted(tuple(r) for r in o.groupBy("dataset").count().collect())
