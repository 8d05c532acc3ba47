import pytest
from pyspark.sql import functions as F

from facsimile.operators import clean, encode
from facsimile.operators.profile import profile


def test_blanks_become_unknown(spark):
    vals = [None, "", "  ", "\t", " ", "x", " y "]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r["s"] for r in clean.fill_unknown(df, ["s"]).collect()]
    assert got == ["Unknown"] * 5 + ["x", " y "]


def test_fill_median_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None), (10.0, None)], "x double, e double")
    _, specs = profile(df)
    out = clean.fill_empty_columns(clean.fill_median(df, ["x"]), specs)
    assert [r["x"] for r in out.collect()] == [1.0, 3.0, 3.0, 10.0]
    assert {r["e"] for r in out.collect()} == {0}


def test_numeric_text(spark):
    df = spark.createDataFrame([(" 12 ",), ("1e5",), ("abc",), (None,)], "s string")
    got = [r["s"] for r in clean.coerce_numeric(df, "s").collect()]
    assert got[:2] == [12.0, 100000.0]
    assert got[2] == got[3] == pytest.approx((12.0 + 100000.0) / 2)


def test_binary_encoders(spark):
    rows = [("Yes", "male", "TRUE"), ("no", "F", "false"), (None, "m", "unknown"), ("nan", "female", None),
            ("unknown", "Unknown", "True")]
    df = spark.createDataFrame(rows, "yn string, sex string, tf string")
    out, enc = encode.preprocess(df)
    assert enc.rules == {"yn": "yes_no", "sex": "male_female", "tf": "true_false"}
    got = [tuple(r) for r in out.collect()]
    assert got == [(1, 1, 1), (0, 0, 0), (0, 1, 0), (0, 0, 0), (0, 0, 1)]


def test_label_codes_sorted_trimmed_and_roundtrip(spark):
    vals = ["pear", " apple", "fig ", "apple", None, "pear", " kiwi"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    out, enc = encode.preprocess(df.select("s"))
    assert enc.rules["s"] == "label"
    assert enc.dictionary["s"] == ["Unknown", "apple", "fig", "kiwi", "pear"]
    codes = [r["s"] for r in out.collect()]
    assert codes == [4, 1, 2, 1, 0, 4, 3]
    back = [r["s"] for r in encode.decode(out, enc).collect()]
    assert back == ["pear", "apple", "fig", "apple", "Unknown", "pear", "kiwi"]


def test_card_50_51_choose_label_or_number(spark):
    df = spark.createDataFrame([(f"v{i}", f"w{i % 50}") for i in range(51)], "a string, b string")
    _, specs = profile(df)
    rules = {s.name: encode.choose_encoder(s) for s in specs}
    assert rules == {"a": "to_number", "b": "label"}


def test_decode_unmapped_uses_mode(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "s string")
    enc = encode.fit_encoding(df)
    codes = spark.createDataFrame([(0.4,), (1.6,), (7.0,), (-3.0,)], "s double")
    got = [r["s"] for r in encode.decode(codes, enc).collect()]
    assert got == ["a", "b", "b", "b"]


def test_hash_encode_is_stable(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "s string")
    a = [r[0] for r in df.select(encode.hash_encode(F.col("s"))).collect()]
    b = [r[0] for r in df.repartition(3).select(encode.hash_encode(F.col("s"))).collect()]
    assert a[0] == a[2] and sorted(a) == sorted(b) and all(0 <= v < 10000 for v in a)


def test_whole_number_median_and_java_literals(spark):
    from pyspark.sql import functions as F

    from facsimile.functions.fmt import to_number
    from facsimile.operators.clean import fill_median
    ints = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "n int")
    assert sorted(r[0] for r in fill_median(ints, ["n"]).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    texts = spark.createDataFrame([("1d",), ("10F",), ("0x1p3",), ("1e5",), (" 12 ",), ("-.5",), (None,)], "s string")
    assert [r[0] for r in texts.select(to_number(F.col("s"))).collect()] == [None, None, None, 1e5, 12.0, -0.5, None]
