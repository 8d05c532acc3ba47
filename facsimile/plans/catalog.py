"""The query catalogue: one Spark plan per operator of the inventory, each with the
DuckDB SQL that must give the same rows (where SQL can express it).

Every query reads the given tables (whole tables, no id subsets); derived fixtures --
nulls, blanks, text numbers -- are computed from the table columns.  Doubles are
rounded to 6 decimals on both sides so summation order cannot change a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.operators import clean, encode, formatting, profile, quality, synth
from facsimile.plans import sqlgen as Q
from facsimile.schema import SynthConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (same rule on the SQL side)."""
    return df.select(*[(F.round(F.col(f.name), 6).alias(f.name)
                        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)) for f in df.schema.fields])


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
EV_NUM = ["event_id", "user_id", "value"]


def li_halves(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return li.where(F.col("l_orderkey") % 2 == 0), li.where(F.col("l_orderkey") % 2 == 1)


def ev_halves(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    return ev.where(F.col("event_id") % 2 == 0), ev.where(F.col("event_id") % 2 == 1)


LI_EVEN = "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)"
LI_ODD = "(SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)"
EV_EVEN = "(SELECT * FROM events WHERE event_id % 2 = 0)"
EV_ODD = "(SELECT * FROM events WHERE event_id % 2 = 1)"


# ============================================================ profiling (C*)

@query("profile_describe", Q.describe_sql("lineitem", LI_NUM))
def q_profile_describe(spark, sf_dir):
    return r6(profile.describe(load(spark, sf_dir, "lineitem"), LI_NUM))


def orders_with_nulls(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))


ORDERS_NULLS = ("(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, "
                "o_orderdate, o_orderpriority FROM orders)")
ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("missing_by_column", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM {ORDERS_NULLS}"
    for c in ORDER_COLS))
def q_missing_by_column(spark, sf_dir):
    return profile.missing_by_column(orders_with_nulls(spark, sf_dir))


@query("missing_total",
       f"SELECT ({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in ORDER_COLS)})::BIGINT AS total_missing, "
       f"count(*) AS n_rows, 6 AS n_columns FROM {ORDERS_NULLS}")
def q_missing_total(spark, sf_dir):
    return profile.missing_total(orders_with_nulls(spark, sf_dir))


@query("value_frequencies", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, "
    f"round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS probability FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ["o_orderpriority", "o_orderstatus"]))
def q_value_frequencies(spark, sf_dir):
    return r6(profile.value_frequencies(load(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"]))


@query("mode_by_column", "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS mode, count(*) AS mode_count FROM part "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ["p_brand", "p_type", "p_name"]))
def q_mode_by_column(spark, sf_dir):
    return profile.modes(load(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])


@query("correlation_matrix", Q.corr_matrix_sql("lineitem", LI_CORR))
def q_correlation_matrix(spark, sf_dir):
    return r6(profile.correlation_matrix(load(spark, sf_dir, "lineitem"), LI_CORR))


@query("histogram_20",
       "WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), "
       f"c AS (SELECT {Q.bin_sql('value', 'r.lo', 'r.hi')} AS bin, "
       "count(*) AS count FROM events, r WHERE value BETWEEN r.lo AND r.hi GROUP BY 1) "
       "SELECT 'value' AS \"column\", g.bin, round(g.bin * ((r.hi - r.lo) / CAST(20.0 AS DOUBLE)) + r.lo, 6) AS lo, "
       "round(CASE WHEN g.bin = 19 THEN r.hi ELSE (g.bin + 1) * ((r.hi - r.lo) / CAST(20.0 AS DOUBLE)) + r.lo END, 6) "
       "AS hi, coalesce(c.count, 0) AS count "
       "FROM (SELECT range::INTEGER AS bin FROM range(20)) g CROSS JOIN r LEFT JOIN c ON g.bin = c.bin")
def q_histogram_20(spark, sf_dir):
    return r6(profile.histogram(load(spark, sf_dir, "events"), ["value"]))


TYPED_TEXT = {      # column -> its text in Spark SQL, and in the twin
    "key_text": ("CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)"),
    "price_text": ("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END",
                   "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_totalprice AS VARCHAR) END"),
    "flag_text": ("IF(o_custkey % 2 = 0, 'True', 'false')", "CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'false' END"),
    "day_text": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "time_text": ("IF(o_orderkey % 3 = 0, date_format(o_orderdate, 'yyyy-MM-dd'), date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss'))",
                  "CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"),
    "mixed_text": ("IF(o_orderkey % 7 = 0, o_orderstatus, CAST(o_orderkey AS STRING))",
                   "CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END"),
    "none_text": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
}


def _type_profile_sql() -> str:
    cols = ", ".join(f"{sql} AS {c}" for c, (_, sql) in TYPED_TEXT.items())
    t = f"(SELECT o_orderkey, o_totalprice, o_orderdate, {cols} FROM orders)"
    parts = []
    kinds = [("o_orderkey", "bigint", "numeric"), ("o_totalprice", "double", "numeric"), ("o_orderdate", "timestamp_ntz", "temporal"),
             *((c, "string", "string") for c in TYPED_TEXT)]
    for i, (c, dtype, kind) in enumerate(kinds):
        if kind == "string":
            day = f"(regexp_full_match({c}, '\\d{{4}}-\\d\\d-\\d\\d') AND TRY_CAST({c} AS DATE) IS NOT NULL)"
            stamp = f"(length({c}) > 10 AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL)"
            own = (f"CASE WHEN count({c}) = 0 THEN NULL WHEN bool_and(lower({c}) IN ('true', 'false')) THEN 'boolean' "
                   f"WHEN bool_and(regexp_full_match({c}, '[+-]?\\d+') AND TRY_CAST({c} AS BIGINT) IS NOT NULL) THEN 'bigint' "
                   f"WHEN bool_and(TRY_CAST({c} AS DOUBLE) IS NOT NULL) THEN 'double' WHEN bool_and({day}) THEN 'date' "
                   f"WHEN bool_and({day} OR {stamp}) THEN 'timestamp' ELSE 'string' END")
            src = f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL)"
        else:
            own = f"CASE WHEN count({c}) = 0 THEN NULL WHEN bool_and({c} = floor({c})) THEN 'bigint' ELSE '{dtype}' END" \
                if kind == "numeric" else f"CASE WHEN count({c}) > 0 THEN '{dtype}' END"
            src = t
        parts.append(f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{dtype}' AS dtype, '{kind}' AS kind, "
                     f"(SELECT count({c}) FROM {t}) AS non_null, (SELECT count(*) - count({c}) FROM {t}) AS missing, "
                     f"(SELECT {own} FROM {src}) AS read_as")
    return " UNION ALL ".join(parts)


@query("type_profile", _type_profile_sql())
def q_type_profile(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return profile.type_profile(o.select("o_orderkey", "o_totalprice", "o_orderdate", *[F.expr(e).alias(c) for c, (e, _) in TYPED_TEXT.items()]))


def _top_sql(cols: list[str], table: str, k: int) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", (row_number() OVER (ORDER BY n DESC, {c}))::INTEGER AS rank, CAST({c} AS VARCHAR) AS value, "
        f"n AS count FROM (SELECT {c}, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= {k}" for c in cols)


@query("top_values", _top_sql(["p_size", "p_brand", "p_name"], "part", 12))
def q_top_values(spark, sf_dir):
    return profile.top_values(load(spark, sf_dir, "part"), ["p_size", "p_brand", "p_name"], 12)


@query("mode_typed", "\nUNION ALL\n".join(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS mode, count(*) AS mode_count FROM lineitem "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ["l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate"]))
def q_mode_typed(spark, sf_dir):
    """Many order and supplier keys tie; the smallest number wins, not the first text."""
    return profile.modes(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate"])


# Values of 1e-19 and 1e300 of both signs; the large ones cancel, the small ones have a mean the
# keys give in whole numbers.
@query("describe_exact",
       "WITH k AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) "
       "SELECT count(*) AS count, round(sum(k)::HUGEINT::DOUBLE / count(*), 3) AS tiny_mean_e19, "
       "round(sum(k)::HUGEINT::DOUBLE / count(*), 3) AS wide_mean_e19, max(n)::BIGINT AS n FROM k")
def q_describe_exact(spark, sf_dir):
    from facsimile.functions.exact import exact_means
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey").cast("double")
    # each key's three values: its 1e-19th part and a huge number of both signs, which cancel exactly
    t = o.select(F.explode(F.array(k * 1e-19, F.lit(1e300) * (k + 1), F.lit(-1e300) * (k + 1))).alias("wide"), (k * 1e-19).alias("tiny"))
    m = exact_means(t, ["wide", "tiny"])
    n = o.count()
    # the product with 1e19 is rounded again at 3 places
    return spark.createDataFrame([(n, round(m[None, "tiny"] * 1e19, 3), round(m[None, "wide"] * 3 * 1e19, 3), n)],
                                 "count bigint, tiny_mean_e19 double, wide_mean_e19 double, n bigint")


def _masked(c: str, k: int) -> str:
    return f"CASE WHEN l_orderkey % {k} = 0 THEN NULL ELSE {c} END"


CORR_NULLS = {"l_quantity": 7, "l_extendedprice": 5, "l_discount": 3, "l_tax": 11}
LI_NULLS = "(SELECT " + ", ".join(f"{_masked(c, k)} AS {c}" for c, k in CORR_NULLS.items()) + ", CAST(l_linenumber AS DOUBLE) AS l_linenumber, 1.5::DOUBLE AS flat FROM lineitem)"


@query("correlation_nulls", Q.corr_matrix_sql(LI_NULLS, [*CORR_NULLS, "l_linenumber", "flat"]))
def q_correlation_nulls(spark, sf_dir):
    """Pairwise-complete correlations of columns with nulls of their own, by blocks of columns."""
    li = load(spark, sf_dir, "lineitem")
    t = li.select(*[F.expr(_masked(c, k)).alias(c) for c, k in CORR_NULLS.items()], "l_linenumber", F.lit(1.5).alias("flat"))
    return r6(profile.correlation_matrix(t, t.columns))


# ============================================================ cleaning (D*)

LI_DISC_NULL = "(SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount FROM lineitem)"


@query("impute_median",
       f"SELECT l_orderkey, l_linenumber, round(coalesce(l_discount, (SELECT median(l_discount) FROM {LI_DISC_NULL})), 6)"
       f" AS l_discount FROM {LI_DISC_NULL}")
def q_impute_median(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"))
    return r6(clean.fill_median(li, ["l_discount"]))


ORD_DATES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS stamp, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders)"


@query("impute_datetime",
       f"SELECT o_orderkey, coalesce(stamp, (SELECT make_timestamp(floor(median(epoch_us(stamp)))::BIGINT) FROM {ORD_DATES})) AS stamp, "
       f"coalesce(day, (SELECT DATE '1970-01-01' + floor(median(day - DATE '1970-01-01'))::INTEGER FROM {ORD_DATES})) AS day FROM {ORD_DATES}")
def q_impute_datetime(spark, sf_dir):
    """Missing dates and timestamps become the median and keep their type."""
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("stamp"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate").cast("date")).alias("day"))
    return clean.fill_median(o, ["stamp", "day"])


def blank_priority(c):
    k = F.col("o_orderkey") % 11
    return (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit("")).when(k == 2, F.lit("  "))
            .when(k == 3, F.lit("\t")).otherwise(c))


BLANK_PRIORITY_SQL = ("CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' "
                      "WHEN 3 THEN chr(9) ELSE o_orderpriority END")


@query("impute_unknown",
       f"SELECT o_orderkey, CASE WHEN p IS NULL OR regexp_matches(p, '^\\s*$') THEN 'Unknown' ELSE p END AS o_orderpriority, "
       f"coalesce(s, 'Unknown') AS o_orderstatus FROM (SELECT o_orderkey, {BLANK_PRIORITY_SQL} AS p, "
       f"nullif(o_orderstatus, 'P') AS s FROM orders)")
def q_impute_unknown(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", blank_priority(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return clean.fill_unknown(o, ["o_orderpriority", "o_orderstatus"])


PART_TEXT = "CASE WHEN p_size % 3 = 0 THEN p_brand ELSE substr(p_brand, 7) END"


@query("to_number_coerce",
       f"SELECT p_partkey, round(coalesce(TRY_CAST(t AS DOUBLE), (SELECT median(TRY_CAST(t AS DOUBLE)) FROM "
       f"(SELECT {PART_TEXT} AS t FROM part))), 6) AS value FROM (SELECT p_partkey, {PART_TEXT} AS t FROM part)")
def q_to_number_coerce(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    t = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.substring("p_brand", 7, 1 << 20))
    return r6(clean.coerce_numeric(p.select("p_partkey", t.alias("value")), "value"))


@query("numeric_matrix",
       "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, "
       "round(coalesce(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END, 0), 6) AS o_totalprice "
       "FROM orders")
def q_numeric_matrix(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    o = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
    return r6(clean.numeric_matrix(o))


@query("fill_empty_columns",
       "SELECT p_partkey, 0 AS empty_col, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS FLOAT) AS p_retailprice "
       "FROM part")
def q_fill_empty_columns(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.lit(None).cast("double").alias("empty_col"),
                                           "p_size", "p_retailprice")
    _, specs = profile.profile(p)
    out = clean.fill_empty_columns(p, specs)
    out = clean.to_text(out, ["p_size"])
    return clean.downcast_float(out, ["p_retailprice"])


# ============================================================ encoding (E*)

LABELS_TEXT = ("(SELECT doc_id, CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END AS quality_text, "
               "CASE toxic WHEN 1 THEN 'TRUE' ELSE 'false' END AS toxic_text, "
               "CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'female' END AS sex FROM labels)")


def labels_text(spark, sf_dir):
    lb = load(spark, sf_dir, "labels")
    return lb.select("doc_id",
                     F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("quality_text"),
                     F.when(F.col("toxic") == 1, "TRUE").otherwise("false").alias("toxic_text"),
                     F.when(F.col("doc_id") % 2 == 0, "M").otherwise("female").alias("sex"))


@query("encode_binary",
       f"SELECT CAST(doc_id AS DOUBLE) AS doc_id, CASE lower(quality_text) WHEN 'yes' THEN 1 ELSE 0 END AS quality_text, "
       f"CASE lower(toxic_text) WHEN 'true' THEN 1 ELSE 0 END AS toxic_text, "
       f"CASE WHEN lower(sex) IN ('male', 'm') THEN 1 ELSE 0 END AS sex FROM {LABELS_TEXT}")
def q_encode_binary(spark, sf_dir):
    out, _ = encode.preprocess(labels_text(spark, sf_dir))
    return out


@query("encode_label",
       "SELECT o_orderkey, (dense_rank() OVER (ORDER BY trim(o_orderpriority)) - 1)::INTEGER AS code FROM orders")
def q_encode_label(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    enc = encode.fit_encoding(o.select("o_orderpriority"))
    return o.select("o_orderkey", encode.encode_column("o_orderpriority", "label", enc).alias("code"))


@query("decode_roundtrip", "SELECT o_orderkey, o_orderpriority, o_orderpriority AS decoded FROM orders")
def q_decode_roundtrip(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    enc = encode.fit_encoding(o.select("o_orderpriority"))
    codes = o.select("o_orderkey", "o_orderpriority",
                     encode.encode_column("o_orderpriority", "label", enc).alias("code"))
    return codes.select("o_orderkey", "o_orderpriority",
                        encode.decode_column("o_orderpriority", enc, F.col("code")).alias("decoded"))


ORDERS_PRE = ("(SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, "
              "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, "
              "o_orderpriority FROM orders)")


@query("preprocess_table",
       f"SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, "
       f"(dense_rank() OVER (ORDER BY coalesce(o_orderstatus, 'Unknown')) - 1)::INTEGER AS o_orderstatus, "
       f"round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {ORDERS_PRE})), 6) AS o_totalprice, "
       f"o_orderdate, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority FROM {ORDERS_PRE}")
def q_preprocess_table(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
                 F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
                 "o_orderdate", "o_orderpriority")
    out, _ = encode.preprocess(o)
    return r6(out)


@query("hash_encode",
       "SELECT o_orderkey, (('0x' || substr(md5(CAST(o_orderpriority AS VARCHAR)), 1, 15))::BIGINT % 10000) AS bucket "
       "FROM orders")
def q_hash_encode(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", encode.hash_encode(F.col("o_orderpriority")).alias("bucket"))


# ============================================================ formatting (G*, B6)

ORDERS_YEAR = ("(SELECT o_orderkey, o_custkey, o_totalprice, year(o_orderdate) AS order_year, "
               "CAST(year(o_orderdate) AS DOUBLE) AS o_y, o_orderpriority FROM orders)")


def orders_year(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.year("o_orderdate").alias("order_year"),
                    F.year("o_orderdate").cast("double").alias("o_y"), "o_orderpriority")


def _year_row(c: str, by_name: bool) -> str:
    return (f"SELECT '{c}' AS \"column\", {str(by_name).lower()} AS by_name, "
            f"(coalesce(bool_and({c} BETWEEN 1900 AND 2100), true) AND count(DISTINCT {c}) < 200) AS by_value, "
            f"({str(by_name).lower()} OR (coalesce(bool_and({c} BETWEEN 1900 AND 2100), true) "
            f"AND count(DISTINCT {c}) < 200)) AS is_year FROM {ORDERS_YEAR}")


@query("year_like", "\nUNION ALL\n".join(_year_row(c, n) for c, n in [
    ("o_orderkey", False), ("o_custkey", False), ("o_totalprice", False), ("order_year", True), ("o_y", False)]))
def q_year_like(spark, sf_dir):
    return formatting.year_rules(orders_year(spark, sf_dir))


@query("format_types",
       f"SELECT round_even(CAST(o_orderkey AS DOUBLE), 2) AS o_orderkey, round_even(CAST(o_custkey AS DOUBLE), 2) "
       f"AS o_custkey, round_even(o_totalprice, 2) AS o_totalprice, CAST(round_even(order_year, 0) AS BIGINT) "
       f"AS order_year, CAST(round_even(o_y, 0) AS BIGINT) AS o_y, o_orderpriority FROM {ORDERS_YEAR}")
def q_format_types(spark, sf_dir):
    return formatting.format_types(orders_year(spark, sf_dir))


# ============================================================ random draws and synthesis (R*, F*)

def _sample_sql() -> str:
    from facsimile.operators.synth import SAMPLE_BUILDINGS, SAMPLE_START
    z = Q.z_sql
    u = Q.u_sql
    clipn = lambda s, m, sd, lo, hi: (f"round_even(greatest({Q.d(lo)}, least({Q.d(hi)}, "
                                      f"{Q.d(m)} + {Q.d(sd)} * {z('id', s)})), 2)")
    b = ", ".join(f"'{x}'" for x in SAMPLE_BUILDINGS)
    return (f"SELECT id, TIMESTAMP '{SAMPLE_START}' + to_hours(id) AS timestamp, "
            f"{clipn('energy_consumption', 45, 15, 0, 100)} AS energy_consumption, "
            f"round_even({Q.d(22)} + {Q.d(5)} * {z('id', 'temperature')}, 2) AS temperature, "
            f"{clipn('humidity', 65, 10, 30, 90)} AS humidity, "
            f"CASE WHEN {u('id', 'occupancy')} < {Q.d(1.0 - 0.7)} THEN 0 ELSE 1 END AS occupancy, "
            f"[{b}][floor({u('id', 'building_type')} * 3)::INTEGER + 1] AS building_type, "
            f"round_even({Q.d(0.1)} + ({Q.d(0.3)} - {Q.d(0.1)}) * {u('id', 'energy_price')}, 2) AS energy_price "
            f"FROM (SELECT event_id AS id FROM events)")


@query("sample_generator", _sample_sql())
def q_sample_generator(spark, sf_dir):
    ids = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    return synth.sample_energy_table(ids)


SYN_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _synth_numeric_sql(table: str, cols: list[str], ids: str) -> str:
    stats = ", ".join(f"avg({Q.num(c)}) AS m_{c}, stddev_samp({Q.num(c)}) AS s_{c}" for c in cols)
    sel = ", ".join(f"round_even({Q.normal_col_sql('i.id', c, f's.m_{c}', f's.s_{c}')}, 2) AS {c}" for c in cols)
    return f"SELECT i.id, {sel} FROM {ids} i CROSS JOIN (SELECT {stats} FROM {table}) s"


LI_IDS = "(SELECT unnest(range((SELECT count(*) FROM lineitem))) AS id)"
ORD_IDS = "(SELECT unnest(range((SELECT count(*) FROM orders))) AS id)"


@query("synth_numeric", _synth_numeric_sql("lineitem", SYN_NUM, LI_IDS))
def q_synth_numeric(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(*SYN_NUM)
    return synth.synthesize_independent(li, SynthConfig(keep_id=True))


@query("synth_categorical",
       f"SELECT a.id, a.o_orderpriority, b.o_orderstatus FROM "
       f"{Q.resample_sql(ORD_IDS, 'orders', 'o_orderpriority', 'o_orderpriority')} a JOIN "
       f"{Q.resample_sql(ORD_IDS, 'orders', 'o_orderstatus', 'o_orderstatus')} b ON a.id = b.id")
def q_synth_categorical(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return synth.synthesize_independent(o, SynthConfig(keep_id=True))


@query("synth_table",
       f"SELECT n.id, n.l_quantity, n.l_extendedprice, c.l_returnflag FROM "
       f"({_synth_numeric_sql('lineitem', ['l_quantity', 'l_extendedprice'], LI_IDS)}) n JOIN "
       f"{Q.resample_sql(LI_IDS, 'lineitem', 'l_returnflag', 'l_returnflag')} c ON n.id = c.id")
def q_synth_table(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    return synth.synthesize_independent(li, SynthConfig(keep_id=True))


# ============================================================ quality (H*)

@query("mean_std_preservation",
       f"SELECT \"column\", position, round({Q.pres('orig_mean', 'synth_mean')}, 6) AS mean_preservation, "
       f"round({Q.pres('orig_std', 'synth_std')}, 6) AS std_preservation FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM)} "
       f"UNION ALL SELECT '__overall__', NULL, round(avg({Q.pres('orig_mean', 'synth_mean')}), 6), "
       f"round(avg({Q.pres('orig_std', 'synth_std')}), 6) FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM)}")
def q_mean_std_preservation(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.mean_std_preservation(a, b))


@query("overall_quality",
       f"SELECT round(m, 6) AS mean_preservation, round(s, 6) AS std_preservation, round((m + s) / 2, 6) AS overall_quality "
       f"FROM (SELECT avg({Q.pres('orig_mean', 'synth_mean')}) AS m, avg({Q.pres('orig_std', 'synth_std')}) AS s "
       f"FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM)})")
def q_overall_quality(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.overall_quality(a, b))


@query("pooled_similarity",
       f"SELECT round(1 - avg(abs(orig_mean - synth_mean)) / (avg(abs(orig_mean)) + {Q.d(1e-10)}), 6) AS mean_similarity, "
       f"round(1 - avg(abs(orig_std - synth_std)) / (avg(abs(orig_std)) + {Q.d(1e-10)}), 6) AS std_similarity "
       f"FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM)}")
def q_pooled_similarity(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.pooled_similarity(a, b))


@query("corr_preservation",
       f"SELECT round({Q.corr_expr('a.corr', 'b.corr')}, 6) AS corr_preservation FROM "
       f"({Q.corr_matrix_sql(LI_EVEN, LI_NUM).replace('round(CAST(', '(CAST(').replace(', 6) AS corr', ') AS corr')}) a "
       f"JOIN ({Q.corr_matrix_sql(LI_ODD, LI_NUM).replace('round(CAST(', '(CAST(').replace(', 6) AS corr', ') AS corr')}) b "
       f"ON a.col_i = b.col_i AND a.col_j = b.col_j")
def q_corr_preservation(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.corr_preservation(a, b))


def _shape_sql(orig: str, synth: str, cols: list[str]) -> str:
    per = []
    for c in cols:
        h = Q.hist_sql(orig, synth, c)
        per.append(
            f"SELECT '{c}' AS c, CASE WHEN (SELECT stddev_samp({c}) FROM {orig}) > 0 AND "
            f"(SELECT stddev_samp({c}) FROM {synth}) > 0 THEN (SELECT CASE WHEN r IS NOT NULL THEN greatest({Q.d(0.0)}, r) END "
            f"FROM (SELECT {Q.corr_expr('ho', 'hs')} AS r FROM ({h}))) END AS shape")
    return " UNION ALL ".join(per)


def _similarity_sql(orig: str, synth: str, cols: list[str]) -> str:
    o = f"(SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in cols)} FROM {orig})"
    s = f"(SELECT {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in cols)} FROM {synth})"
    return (f"SELECT avg({Q.pres('orig_mean', 'synth_mean')}) AS mean_similarity, "
            f"avg({Q.pres('orig_std', 'synth_std')}) AS std_similarity, "
            f"(SELECT coalesce(avg(shape), {Q.d(0.7)}) FROM ({_shape_sql(o, s, cols)})) AS shape_similarity "
            f"FROM {Q.stats_pair_sql(o, s, cols)}")


SIM_EV = _similarity_sql(EV_EVEN, EV_ODD, EV_NUM)


@query("similarity_summary",
       f"SELECT round(mean_similarity, 6) AS mean_similarity, round(std_similarity, 6) AS std_similarity, "
       f"round(shape_similarity, 6) AS shape_similarity FROM ({SIM_EV})")
def q_similarity_summary(spark, sf_dir):
    a, b = ev_halves(spark, sf_dir)
    return r6(quality.similarity_summary(a, b))


@query("utility_fidelity",
       f"SELECT round((mean_similarity + std_similarity) / 2, 6) AS utility_score, round(shape_similarity, 6) AS "
       f"fidelity_score FROM ({SIM_EV})")
def q_utility_fidelity(spark, sf_dir):
    a, b = ev_halves(spark, sf_dir)
    return r6(quality.utility_fidelity(a, b))


# The generate -> report lifecycle end to end: the whole of lineitem against its own
# independent synthetic copy (md5 draws, so the twin draws the same rows in DuckDB).
LI_SYN_ORIG = f"(SELECT {', '.join(SYN_NUM)} FROM lineitem)"
LI_SYN_FAKE = f"({_synth_numeric_sql('lineitem', SYN_NUM, LI_IDS)})"


def li_with_synthetic(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(*SYN_NUM)
    return li, synth.synthesize_independent(li, SynthConfig())


@query("generate_and_score",
       f"SELECT \"column\", position, round({Q.pres('orig_mean', 'synth_mean')}, 6) AS mean_preservation, "
       f"round({Q.pres('orig_std', 'synth_std')}, 6) AS std_preservation "
       f"FROM {Q.stats_pair_sql(LI_SYN_ORIG, LI_SYN_FAKE, SYN_NUM)} "
       f"UNION ALL SELECT '__overall__', NULL, round(avg({Q.pres('orig_mean', 'synth_mean')}), 6), "
       f"round(avg({Q.pres('orig_std', 'synth_std')}), 6) FROM {Q.stats_pair_sql(LI_SYN_ORIG, LI_SYN_FAKE, SYN_NUM)}")
def q_generate_and_score(spark, sf_dir):
    orig, fake = li_with_synthetic(spark, sf_dir)
    return r6(quality.mean_std_preservation(orig, fake))


@query("generate_and_fidelity",
       f"SELECT round(mean_similarity, 6) AS mean_similarity, round(std_similarity, 6) AS std_similarity, "
       f"round(shape_similarity, 6) AS shape_similarity "
       f"FROM ({_similarity_sql(LI_SYN_ORIG, LI_SYN_FAKE, SYN_NUM)})")
def q_generate_and_fidelity(spark, sf_dir):
    orig, fake = li_with_synthetic(spark, sf_dir)
    return r6(quality.similarity_summary(orig, fake))


def _band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.8 THEN 'good' WHEN {x} >= 0.6 THEN 'medium' ELSE 'low' END"


DOC_EVEN = "(SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0)"
DOC_ODD = "(SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 1)"
SIM_DOC = _similarity_sql(DOC_EVEN, DOC_ODD, ["doc_id", "n_chars"])


@query("score_bands",
       f"SELECT metric, round(score, 6) AS score, {_band_sql('score')} AS band FROM ("
       f"SELECT 'Mean Similarity' AS metric, mean_similarity AS score FROM ({SIM_DOC}) UNION ALL "
       f"SELECT 'Std Similarity', std_similarity FROM ({SIM_DOC}) UNION ALL "
       f"SELECT 'Distribution Shape', shape_similarity FROM ({SIM_DOC}))")
def q_score_bands(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a, b = docs.where(F.col("doc_id") % 2 == 0), docs.where(F.col("doc_id") % 2 == 1)
    return r6(quality.score_bands(a, b))


@query("percent_diffs",
       f"SELECT position, \"column\", round(CASE WHEN orig_mean = 0 THEN 0 ELSE abs(orig_mean - synth_mean) / "
       f"abs(orig_mean) * 100 END, 6) AS mean_diff_pct, round(CASE WHEN orig_std = 0 THEN 0 ELSE "
       f"abs(orig_std - synth_std) / abs(orig_std) * 100 END, 6) AS std_diff_pct "
       f"FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM[:5])}")
def q_percent_diffs(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.percent_diffs(a, b, 5))


@query("structure_compare",
       f"SELECT o.n AS original_rows, s.n AS synthetic_rows, 6 AS original_columns, 6 AS synthetic_columns, "
       f"round(CASE WHEN o.n > 0 THEN s.n / o.n ELSE 0 END, 6) AS size_ratio, true AS all_columns_kept "
       f"FROM (SELECT count(*) AS n FROM {EV_EVEN}) o, (SELECT count(*) AS n FROM {EV_ODD}) s")
def q_structure_compare(spark, sf_dir):
    a, b = ev_halves(spark, sf_dir)
    return r6(quality.structure_compare(a, b))


@query("size_ratio",
       f"SELECT round(CASE WHEN o.n > 0 THEN s.n / o.n ELSE 0 END, 6) AS size_ratio "
       f"FROM (SELECT count(*) AS n FROM orders) o, (SELECT count(*) AS n FROM lineitem) s")
def q_size_ratio(spark, sf_dir):
    return r6(quality.size_ratio(load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")))


@query("align_stats",
       f"SELECT position, \"column\", orig_mean6 AS orig_mean, round(orig_std, 6) AS orig_std, "
       f"synth_mean6 AS synth_mean, round(synth_std, 6) AS synth_std FROM {Q.stats_pair_sql(LI_EVEN, LI_ODD, LI_NUM)}")
def q_align_stats(spark, sf_dir):
    a, b = li_halves(spark, sf_dir)
    return r6(quality.column_stats_pair(a, b))




# ============================================================ batch

BATCH_IN = "(SELECT o_orderpriority AS dataset, o_totalprice, o_orderstatus FROM orders)"
BATCH_SQL = (
    f"WITH g AS (SELECT dataset, count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s "
    f"FROM {BATCH_IN} GROUP BY 1), "
    f"go AS (SELECT *, sum(n) OVER (ORDER BY dataset) - n AS start FROM g), "
    f"ids AS (SELECT unnest(range((SELECT sum(n) FROM g)::BIGINT)) AS id), "
    f"a AS (SELECT ids.id, go.dataset, go.m, go.s FROM ids JOIN go ON ids.id >= go.start AND ids.id < go.start + go.n), "
    f"f AS {Q.freq_intervals_sql(BATCH_IN, 'o_orderstatus', 'dataset')} "
    f"SELECT a.dataset, a.id, round_even({Q.normal_col_sql('a.id', 'o_totalprice', 'a.m', 'a.s')}, 2) AS o_totalprice, "
    f"f.v AS o_orderstatus FROM a JOIN f ON f.g = a.dataset "
    f"AND floor({Q.u_sql('a.id', 'o_orderstatus')} * f.n)::BIGINT >= f.lo "
    f"AND floor({Q.u_sql('a.id', 'o_orderstatus')} * f.n)::BIGINT < f.hi")


def _batch_input(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("dataset"), "o_totalprice", "o_orderstatus")


@query("synth_batch", BATCH_SQL)
def q_synth_batch(spark, sf_dir):
    from facsimile.plans.batch import synthesize_batch
    return synthesize_batch(_batch_input(spark, sf_dir))


@query("batch_status",
       f"SELECT o.dataset, o.n AS original_rows, s.n AS synthetic_rows, 'Success' AS status FROM "
       f"(SELECT dataset, count(*) AS n FROM {BATCH_IN} GROUP BY 1) o JOIN "
       f"(SELECT dataset, count(*) AS n FROM ({BATCH_SQL}) GROUP BY 1) s ON o.dataset = s.dataset")
def q_batch_status(spark, sf_dir):
    from facsimile.plans.batch import batch_status, synthesize_batch
    src = _batch_input(spark, sf_dir)
    return batch_status(src, synthesize_batch(src))


# ============================================================ copula (F1) and PCA

@query("synth_copula")
def q_synth_copula(spark, sf_dir):
    from facsimile.operators.copula import synthesize_copula
    li = load(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return synthesize_copula(li, SynthConfig(keep_id=True))


@query("synth_copula_pair", Q.copula_pair_sql("orders", "o_totalprice", "o_totalprice * 0.3 + o_custkey * 20.0"))
def q_synth_copula_pair(spark, sf_dir):
    """Two continuous columns from their copula, to whole numbers."""
    from facsimile.operators.copula import synthesize_copula
    o = load(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * 0.3 + F.col("o_custkey") * 20.0).alias("b"))
    out = synthesize_copula(o, SynthConfig(keep_id=True))
    return out.select("id", F.round("a").alias("a"), F.round("b").alias("b"))


@query("synth_batch_copula", Q.copula_pair_sql("orders", "o_totalprice", "o_totalprice * 0.3 + o_custkey * 20.0", "o_orderpriority"))
def q_synth_batch_copula(spark, sf_dir):
    """The same two columns of every dataset from the dataset's own copula."""
    from facsimile.operators.copula_groups import synthesize_groups
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_totalprice").alias("a"),
                                             (F.col("o_totalprice") * 0.3 + F.col("o_custkey") * 20.0).alias("b"))
    out, _ = synthesize_groups(o)
    return out.select("dataset", "id", F.round("a").alias("a"), F.round("b").alias("b"))


@query("copula_discrete", " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lineitem" for c in ["l_linenumber", "l_tax", "l_discount", "l_quantity"]))
def q_copula_discrete(spark, sf_dir):
    """The values that columns of few values draw: theirs, and nothing between."""
    from facsimile.operators.copula import synthesize_copula
    cols = ["l_linenumber", "l_tax", "l_discount", "l_quantity"]
    out = synthesize_copula(load(spark, sf_dir, "lineitem").select("l_extendedprice", *cols), SynthConfig())
    return out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]))).distinct()


@query("synth_id_column",
       f"SELECT i.id AS _id, n.o AS id, n.p AS \"total.price\", c.\"order.status\" FROM {ORD_IDS} i JOIN "
       f"(SELECT i.id, round_even({Q.normal_col_sql('i.id', 'id', 's.m_o', 's.s_o')}, 2) AS o, "
       f"round_even({Q.normal_col_sql('i.id', 'total.price', 's.m_p', 's.s_p')}, 2) AS p FROM {ORD_IDS} i CROSS JOIN "
       f"(SELECT avg({Q.num('o_orderkey')}) AS m_o, stddev_samp({Q.num('o_orderkey')}) AS s_o, avg(o_totalprice) AS m_p, "
       f"stddev_samp(o_totalprice) AS s_p FROM orders) s) n ON n.id = i.id JOIN "
       f"(SELECT i.id, f.v AS \"order.status\" FROM {ORD_IDS} i JOIN {Q.freq_intervals_sql('orders', 'o_orderstatus')} f "
       f"ON floor({Q.u_sql('i.id', 'order.status')} * f.n)::BIGINT >= f.lo AND floor({Q.u_sql('i.id', 'order.status')} * f.n)::BIGINT < f.hi) c ON c.id = i.id")
def q_synth_id_column(spark, sf_dir):
    """A source with a column ``id`` and dotted names, independent method."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total.price"),
                                             F.col("o_orderstatus").alias("order.status"))
    return synth.synthesize_independent(o, SynthConfig(method="independent", keep_id=True))


@query("pca_scores")
def q_pca_scores(spark, sf_dir):
    from facsimile.operators.pca import pca_scores
    a, b = li_halves(spark, sf_dir)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return pca_scores(a.select(*cols), b.select(*cols))


@query("pca_variance")
def q_pca_variance(spark, sf_dir):
    from facsimile.operators.pca import pca_variance
    e = load(spark, sf_dir, "embeddings")
    dims = e.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return pca_variance(dims)


# ============================================================ report pieces

EV_TYPES = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
            ("value", "double"), ("props", "string")]


def _profile_side_sql(table: str, side: str) -> str:
    parts = []
    for i, (c, t) in enumerate(EV_TYPES):
        head_ = f"SELECT '{side}' AS side, {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, " \
                f"count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        if t in ("bigint", "double"):
            x = Q.num(c)
            parts.append(head_ + f"count({x}) AS count, {Q.exact_mean6(x)} AS mean, round(stddev_samp({x}), 6) AS std, "
                         f"round(min({x}), 6) AS min, round(quantile_cont({x}, 0.25), 6) AS p25, "
                         f"round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, "
                         f"round(max({x}), 6) AS max FROM {table}")
        else:
            parts.append(head_ + "NULL::BIGINT AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, "
                         "NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max "
                         f"FROM {table}")
    return " UNION ALL ".join(parts)


@query("profile_pair", _profile_side_sql(EV_EVEN, "original") + " UNION ALL " + _profile_side_sql(EV_ODD, "synthetic"))
def q_profile_pair(spark, sf_dir):
    a, b = ev_halves(spark, sf_dir)
    return r6(quality.profile_pair(a, b))


ORD_SYN_SQL = (f"SELECT n.id, n.o_totalprice, c.o_orderpriority FROM "
               f"({_synth_numeric_sql('orders', ['o_totalprice'], ORD_IDS)}) n JOIN "
               f"{Q.resample_sql(ORD_IDS, 'orders', 'o_orderpriority', 'o_orderpriority')} c ON n.id = c.id")


@query("side_by_side",
       "SELECT 'original' AS side, row, o_orderkey, o_totalprice, o_orderpriority FROM (SELECT (row_number() OVER "
       "(ORDER BY o_orderkey) - 1)::BIGINT AS row, o_orderkey, round_even(o_totalprice, 2) AS o_totalprice, "
       "o_orderpriority FROM orders) WHERE row < 100 UNION ALL "
       f"SELECT 'synthetic', id::BIGINT, NULL::BIGINT, o_totalprice, o_orderpriority FROM ({ORD_SYN_SQL}) WHERE id < 100")
def q_side_by_side(spark, sf_dir):
    from facsimile.operators.formatting import format_types
    from facsimile.plans.generate import head, with_row_number
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    _, specs = profile.profile(o)
    # rows depend only on (id, column, seed): the first 100 rows of the full synthetic
    # table are exactly a 100-row synthesis, so only those are generated
    fake = synth.synthesize_independent(o.select("o_totalprice", "o_orderpriority"),
                                        SynthConfig(method="independent", keep_id=True, num_samples=100))
    left = with_row_number(head(format_types(o, specs, floats_only=True), 100, ["o_orderkey"]), ["o_orderkey"])
    right = head(format_types(fake, specs, floats_only=True), 100, ["id"]).withColumnRenamed("id", "row")
    return (left.withColumn("side", F.lit("original"))
            .unionByName(right.withColumn("side", F.lit("synthetic")), allowMissingColumns=True)
            .select("side", "row", "o_orderkey", "o_totalprice", "o_orderpriority"))


def _report_sql() -> str:
    cols = ["event_id", "user_id", "value"]
    sp = Q.stats_pair_sql(EV_EVEN, EV_ODD, cols)
    pres = Q.pres
    struct = (f"SELECT 'structure' AS section, NULL AS \"column\", metric, value, note FROM ("
              f"SELECT 'method' AS metric, NULL::DOUBLE AS value, 'independent' AS note UNION ALL "
              f"SELECT 'original_rows', (SELECT count(*) FROM {EV_EVEN})::DOUBLE, NULL UNION ALL "
              f"SELECT 'synthetic_rows', (SELECT count(*) FROM {EV_ODD})::DOUBLE, NULL UNION ALL "
              f"SELECT 'original_columns', 6.0::DOUBLE, NULL UNION ALL SELECT 'synthetic_columns', 6.0::DOUBLE, NULL UNION ALL "
              f"SELECT 'size_ratio', (SELECT count(*) FROM {EV_ODD})::DOUBLE / (SELECT count(*) FROM {EV_EVEN}), NULL UNION ALL "
              f"SELECT 'all_columns_kept', 1.0::DOUBLE, NULL)")
    kept = (f"SELECT 'preservation', \"column\", 'mean_preservation', {pres('orig_mean', 'synth_mean')}, NULL FROM {sp} UNION ALL "
            f"SELECT 'preservation', \"column\", 'std_preservation', {pres('orig_std', 'synth_std')}, NULL FROM {sp} UNION ALL "
            f"SELECT 'preservation', '__overall__', 'mean_preservation', avg({pres('orig_mean', 'synth_mean')}), NULL FROM {sp} UNION ALL "
            f"SELECT 'preservation', '__overall__', 'std_preservation', avg({pres('orig_std', 'synth_std')}), NULL FROM {sp} UNION ALL "
            f"SELECT 'preservation', NULL, 'overall_quality', (avg({pres('orig_mean', 'synth_mean')}) + avg({pres('orig_std', 'synth_std')})) / 2, NULL FROM {sp}")
    raw = lambda t: Q.corr_matrix_sql(t, cols).replace("round(CAST(", "(CAST(").replace(", 6) AS corr", ") AS corr")
    corr = (f"SELECT 'preservation', NULL, 'corr_preservation', {Q.corr_expr('a.corr', 'b.corr')}, NULL FROM ({raw(EV_EVEN)}) a "
            f"JOIN ({raw(EV_ODD)}) b ON a.col_i = b.col_i AND a.col_j = b.col_j")
    pct = lambda o, s_: f"CASE WHEN {o} = 0 THEN 0 ELSE abs({o} - {s_}) / abs({o}) * 100 END"
    diffs = (f"SELECT 'differences', \"column\", 'mean_diff_pct', {pct('orig_mean', 'synth_mean')}, NULL FROM {sp} UNION ALL "
             f"SELECT 'differences', \"column\", 'std_diff_pct', {pct('orig_std', 'synth_std')}, NULL FROM {sp}")
    sim = (f"SELECT 'similarity', NULL, metric, value, {_band_sql('value')} FROM (SELECT 'mean_similarity' AS metric, "
           f"mean_similarity AS value FROM ({SIM_EV}) UNION ALL SELECT 'std_similarity', std_similarity FROM ({SIM_EV}) "
           f"UNION ALL SELECT 'shape_similarity', shape_similarity FROM ({SIM_EV}) UNION ALL SELECT 'utility_score', "
           f"(mean_similarity + std_similarity) / 2 FROM ({SIM_EV}) UNION ALL SELECT 'fidelity_score', shape_similarity FROM ({SIM_EV}))")
    return (f"SELECT section, \"column\", metric, round(value, 6) AS value, note FROM ({struct} UNION ALL {kept} UNION ALL {corr} "
            f"UNION ALL {diffs} UNION ALL {sim} UNION ALL {_pca_report_sql(cols)})")


def _pca_report_sql(cols: list[str]) -> str:
    """Explained variance of the first two of three components in closed form: the eigenvalues of a
    symmetric 3 x 3 matrix are q + 2 p cos(phi + 2 pi k / 3)."""
    x = [f"coalesce({Q.num(c)}, 0)" for c in cols]
    cov = {(i, j): f"covar_pop({x[i]}, {x[j]})" for i in range(3) for j in range(i, 3)}
    m = "SELECT " + ", ".join(f"{e} AS c{i}{j}" for (i, j), e in cov.items()) + f" FROM {EV_EVEN}"
    q = f"SELECT *, (c00 + c11 + c22) / 3 AS q FROM ({m})"
    p = (f"SELECT *, sqrt(((c00 - q) * (c00 - q) + (c11 - q) * (c11 - q) + (c22 - q) * (c22 - q) + 2 * (c01 * c01 + c02 * c02 + c12 * c12)) / 6) AS p "
         f"FROM ({q})")
    r = (f"SELECT q, p, ((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02) "
         f"+ c02 * (c01 * c12 - (c11 - q) * c02)) / (2 * p * p * p) AS r FROM ({p})")
    big = f"q + 2 * p * cos(acos(greatest({Q.d(-1)}, least({Q.d(1)}, r))) / 3)"
    low = f"q + 2 * p * cos(acos(greatest({Q.d(-1)}, least({Q.d(1)}, r))) / 3 + 2 * pi() / 3)"
    return (f"SELECT 'components', NULL, 'explained_variance_1', ({big}) / (3 * q), NULL FROM ({r}) UNION ALL "
            f"SELECT 'components', NULL, 'explained_variance_2', (3 * q - ({big}) - ({low})) / (3 * q), NULL FROM ({r})")


@query("quality_report", _report_sql())
def q_quality_report(spark, sf_dir):
    a, b = ev_halves(spark, sf_dir)
    return r6(quality.quality_report(a, b))


@query("pca_variance_three", f"SELECT right(metric, 1)::INTEGER AS component, round(value, 6) AS explained_variance_ratio FROM "
                             f"(SELECT * FROM ({_pca_report_sql(['event_id', 'user_id', 'value'])}) t(section, \"column\", metric, value, note))")
def q_pca_variance_three(spark, sf_dir):
    """Explained variance of three columns against the closed form of a 3 x 3 matrix's eigenvalues."""
    from facsimile.operators.pca import pca_variance
    a, _ = ev_halves(spark, sf_dir)
    return r6(pca_variance(a, ["event_id", "user_id", "value"]))


def _document_sql(table: str, cols: list[tuple[str, str]], name: str) -> str:
    def text(e: str) -> str:
        return f"CAST(CAST(round({e}, 6) AS DECIMAL(38,6)) AS VARCHAR)"

    parts = []
    for i, (c, t) in enumerate(cols):
        x = Q.num(c)
        number = t in ("bigint", "double", "int")
        v = {"count": f"CAST(count({x}) AS VARCHAR)", "mean": text(Q.exact_mean6(x)), "std": text(f"stddev_samp({x})"), "min": text(f"min({x})"),
             "p25": text(f"quantile_cont({x}, 0.25)"), "p50": text(f"quantile_cont({x}, 0.5)"), "p75": text(f"quantile_cont({x}, 0.75)"),
             "max": text(f"max({x})")} if number else {k: "NULL::VARCHAR" for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")}
        body = ", ".join(f"'{k}': {e}" for k, e in v.items())
        parts.append(f"SELECT {i} AS i, {{'position': {i}, 'column': '{c}', 'dtype': '{t}', "
                     f"'missing': CAST(count(*) - count({c}) AS VARCHAR), {body}}} AS s FROM {table}")
    return (f"SELECT '{name}' AS name, CAST(to_json({{'table': '{name}', 'columns': list(s ORDER BY i)}}) AS VARCHAR) AS document "
            f"FROM ({' UNION ALL '.join(parts)})")


@query("profile_json", _document_sql(ORDERS_NULLS, [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                                                    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")], "orders"))
def q_profile_json(spark, sf_dir):
    return quality.profile_document(orders_with_nulls(spark, sf_dir), "orders")


PRIORITY_LEVEL_SQL = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'Medium' "
                      "WHEN '3-MEDIUM' THEN 'Low' ELSE o_orderpriority END")


@query("privacy_label",
       f"SELECT o_orderkey, level, CASE level WHEN 'Low' THEN 'Medium-Low' WHEN 'Medium' THEN 'Medium' "
       f"WHEN 'High' THEN 'High' ELSE 'Medium' END AS label FROM (SELECT o_orderkey, {PRIORITY_LEVEL_SQL} AS level FROM orders)")
def q_privacy_label(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    level = (F.when(p == "1-URGENT", "High").when(p == "2-HIGH", "Medium").when(p == "3-MEDIUM", "Low").otherwise(p))
    return o.select("o_orderkey", level.alias("level")).select("o_orderkey", "level",
                                                               quality.privacy_label(F.col("level")).alias("label"))


ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("size_tier", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, CASE WHEN count(*) > 100000 THEN 'large' WHEN count(*) > 50000 "
    f"THEN 'medium' ELSE 'small' END AS tier FROM {t}" for t in ALL_TABLES))
def q_size_tier(spark, sf_dir):
    from functools import reduce
    parts = [load(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows")
             for t in ALL_TABLES]
    counts = reduce(lambda a, b: a.unionByName(b), parts)
    return counts.select("table", "rows", quality.size_tier(F.col("rows")).alias("tier"))


# ============================================================ text

WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


@query("html_preview",
       "SELECT page_id, CASE WHEN length(t) > 1000 THEN left(t, 1000) || '...' ELSE t END AS preview FROM "
       "(SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS t FROM pages)")
def q_html_preview(spark, sf_dir):
    from facsimile.functions.text import html_preview
    return load(spark, sf_dir, "pages").select("page_id", html_preview(F.col("html")).alias("preview"))


FENCED_SQL = ("CASE WHEN turn % 3 = 0 THEN '```html' || chr(10) || text || chr(10) || '```' "
              "WHEN turn % 3 = 1 THEN '  ```' || text || '```  ' ELSE text END")


def _fences_sql() -> str:
    s1 = _strip_sql("f")
    s2 = _strip_sql(f"CASE WHEN starts_with({s1}, '```html') THEN substr({s1}, 8) "
                    f"WHEN starts_with({s1}, '```') THEN substr({s1}, 4) ELSE {s1} END")
    s3 = _strip_sql(f"CASE WHEN ends_with(s2, '```') THEN left(s2, length(s2) - 3) ELSE s2 END")
    return (f"SELECT conv_id, turn, {s3} AS cleaned FROM (SELECT conv_id, turn, {s2} AS s2 FROM "
            f"(SELECT conv_id, turn, {FENCED_SQL} AS f FROM conversations))")


@query("strip_fences", _fences_sql())
def q_strip_fences(spark, sf_dir):
    from facsimile.functions.text import strip_fences
    c = load(spark, sf_dir, "conversations")
    nl = F.lit("\n")
    fenced = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```html"), nl, F.col("text"), nl, F.lit("```")))
              .when(F.col("turn") % 3 == 1, F.concat(F.lit("  ```"), F.col("text"), F.lit("```  ")))
              .otherwise(F.col("text")))
    return c.select("conv_id", "turn", strip_fences(fenced).alias("cleaned"))


@query("safe_names",
       "SELECT doc_id, translate(concat(source, ' ', lang, '/', CAST(doc_id AS VARCHAR)), ' /', '__') || '_report.html' "
       "AS report_name, replace(source || '.csv', '.csv', '_synthetic.csv') AS synthetic_name FROM documents")
def q_safe_names(spark, sf_dir):
    from facsimile.functions.text import safe_file_name, synthetic_file_name
    d = load(spark, sf_dir, "documents")
    title = F.concat_ws("", F.col("source"), F.lit(" "), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", safe_file_name(title).alias("report_name"),
                    synthetic_file_name(F.concat(F.col("source"), F.lit(".csv"))).alias("synthetic_name"))


# ============================================================ sources and sinks (A*)

ORDERS_TEXT_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, "
                   "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders")


@query("csv_roundtrip", ORDERS_TEXT_SQL)
def q_csv_roundtrip(spark, sf_dir):
    from facsimile.session import scratch_path
    from facsimile.sources import io
    path = scratch_path(spark, "csv-roundtrip")
    io.write_csv(load(spark, sf_dir, "orders"), path)
    return r6(io.read_csv(spark, path))


@query("json_roundtrip", ORDERS_TEXT_SQL)
def q_json_roundtrip(spark, sf_dir):
    from facsimile.session import scratch_path
    from facsimile.sources import io
    path = scratch_path(spark, "json-roundtrip")
    io.write_json(load(spark, sf_dir, "orders"), path)
    return r6(io.read_json(spark, path, ORDER_COLS))


@query("multi_file_scan",
       "SELECT o_orderpriority AS dataset, count(*) AS rows, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY 1")
def q_multi_file_scan(spark, sf_dir):
    from facsimile.session import scratch_path
    from facsimile.sources import io
    path = scratch_path(spark, "batch-tree")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", "o_totalprice")
    io.write_batch(o, path)
    back = io.read_batch(spark, path)
    return r6(back.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total")))


TOKENS_SQL = "(" + ", ".join(f"'{t}'" for t in __import__("facsimile.sources.io", fromlist=["NA_TOKENS"]).NA_TOKENS) + ")"


def _na(c: str) -> str:
    return f"CASE WHEN {c} IN {TOKENS_SQL} THEN NULL ELSE {c} END"


@query("csv_text_roundtrip",
       f"SELECT 'conversations' AS \"table\", conv_id AS key, turn, md5({_na('text')}) AS digest FROM conversations UNION ALL "
       f"SELECT 'documents', doc_id, 0, md5({_na('text')}) FROM documents")
def q_csv_text_roundtrip(spark, sf_dir):
    """Whole texts with quotes and line breaks through CSV and back."""
    from facsimile.session import scratch_path
    from facsimile.sources import io
    out = None
    for table, key, turn in (("conversations", "conv_id", F.col("turn")), ("documents", "doc_id", F.lit(0).cast("bigint"))):
        path = scratch_path(spark, "csv-text")
        io.write_csv(load(spark, sf_dir, table), path)
        back = io.read_csv(spark, path).select(F.lit(table).alias("table"), F.col(key).alias("key"), turn.alias("turn"), F.md5("text").alias("digest"))
        out = back if out is None else out.unionByName(back)
    return out


@query("xlsx_scan",
       "SELECT p_partkey, p_name, p_brand, p_size, round(p_retailprice, 6) AS p_retailprice, "
       "CASE WHEN p_size % 5 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01 06:00:00' + to_days(p_size) END AS stamp FROM part")
def q_xlsx_scan(spark, sf_dir):
    """The parts as workbooks of 500 rows and back, with short rows and dates."""
    from facsimile.sources import io
    stamp = F.timestamp_add("DAY", F.col("p_size"), F.lit("2020-01-01 06:00:00").cast("timestamp_ntz"))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice",
                                           F.when(F.col("p_size") % 5 != 0, stamp).alias("stamp"))
    return r6(io.workbook_table(io.workbooks(p, 500)).drop("source_file").withColumn("p_size", F.col("p_size").cast("int")))


@query("registry_snapshot", "SELECT o_orderstatus, count(*) AS rows, true AS reused FROM orders GROUP BY 1")
def q_registry_snapshot(spark, sf_dir):
    """A dataset registered twice, in another order the second time, is one snapshot, read through its view."""
    from facsimile.registry import Registry
    from facsimile.session import scratch_path
    reg = Registry(spark, scratch_path(spark, "registry"))
    o = load(spark, sf_dir, "orders")
    first = reg.register("orders snapshot", o)
    again = reg.register("orders snapshot", o.repartition(7, "o_custkey"))
    return spark.table("orders_snapshot").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.lit(again.reused and not first.reused and again.path == first.path).alias("reused"))


def _mixed_files(spark, sf_dir):
    """One file a priority: two with their columns in another order, one with a column more, one that lacks one."""
    from facsimile.session import scratch_path
    from facsimile.sources import io
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey")
    layouts = {"1-URGENT": ["o_orderkey", "o_totalprice", "o_orderstatus"], "2-HIGH": ["o_orderstatus", "o_orderkey", "o_totalprice"],
               "3-MEDIUM": ["o_totalprice", "o_orderstatus", "o_orderkey"], "4-NOT SPECIFIED": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"],
               "5-LOW": ["o_orderkey", "o_totalprice"]}
    paths = []
    for name, cols in layouts.items():
        path = scratch_path(spark, f"mixed-{name[0]}")
        io.write_csv(o.where(F.col("o_orderpriority") == name).select(*cols), path)
        paths.append(path)
    path = scratch_path(spark, "mixed-empty")
    io.write_csv(o.limit(0).select("o_orderstatus", "o_totalprice").coalesce(1), path)     # a header alone
    return [*paths, path]


@query("multi_file_mixed",
       "SELECT CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS o_orderstatus, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, "
       "round(sum(o_totalprice), 2) AS total, sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_custkey END)::BIGINT AS customers FROM orders GROUP BY 1")
def q_multi_file_mixed(spark, sf_dir):
    """Files of five layouts as one table, columns by name."""
    from facsimile.sources import io
    data, _ = io.read_csv_files(spark, _mixed_files(spark, sf_dir))
    return data.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_custkey").alias("customers"))


# ============================================================ projections (B*)

@query("project_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def q_project_columns(spark, sf_dir):
    from facsimile.plans.generate import select_lenient
    return select_lenient(load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey", "no_such_column"])


@query("head_rows",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders ORDER BY o_orderkey LIMIT 10")
def q_head_rows(spark, sf_dir):
    from facsimile.plans.generate import default_projection, head
    return head(default_projection(load(spark, sf_dir, "orders")), 10, ["o_orderkey"])


FLAG_SQL = "CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'No' END"


def _rules_sql() -> str:
    t = f"(SELECT {FLAG_SQL} AS flag_text, year(o_orderdate) AS order_year, o_totalprice FROM orders)"
    ft = "coalesce(flag_text, 'Unknown')"
    text = (f"SELECT 'flag_text' AS \"column\", count(flag_text) AS non_null, NULL::BOOLEAN AS in_year_range, "
            f"bool_and(lower({ft}) IN ('yes', 'no', 'unknown', 'nan')) AS yes_no, "
            f"bool_and(lower({ft}) IN ('male', 'female', 'm', 'f', 'unknown', 'nan')) AS male_female, "
            f"bool_and(lower({ft}) IN ('true', 'false', 'unknown', 'nan')) AS true_false FROM {t}")
    nums = " UNION ALL ".join(
        f"SELECT '{c}', count({c}), coalesce(bool_and({c} BETWEEN 1900 AND 2100), true), NULL, NULL, NULL FROM {t}"
        for c in ["order_year", "o_totalprice"])
    return f"{text} UNION ALL {nums}"


@query("value_rules", _rules_sql())
def q_value_rules(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    t = o.select(F.when(st == "F", "yes").when(st == "O", "No").alias("flag_text"),
                 F.year("o_orderdate").alias("order_year"), "o_totalprice")
    _, specs = profile.profile(t)
    rows = []
    for s in specs:
        if s.kind == "string":
            rows.append((s.name, s.count, None, s.extra["yes_no"], s.extra["male_female"], s.extra["true_false"]))
        else:
            rows.append((s.name, s.count, s.extra["in_year_range"], None, None, None))
    return spark.createDataFrame(rows, "column string, non_null bigint, in_year_range boolean, yes_no boolean, "
                                       "male_female boolean, true_false boolean")


# ============================================================ scalar functions

@query("scalar_text",
       "SELECT p_partkey, lower(p_name) AS name_lower, replace(p_name, ' ', '_') AS name_snake, "
       "starts_with(p_brand, 'Brand#1') AS brand_1x, ends_with(p_name, 'bolt') AS is_bolt, "
       "contains(p_name, 'red') AS has_red, regexp_replace(p_type, '[AEIOU]', '', 'g') AS type_consonants, "
       "CAST(to_json({'p_partkey': p_partkey, 'p_size': p_size}) AS VARCHAR) AS as_json FROM part")
def q_scalar_text(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.lower("p_name").alias("name_lower"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("name_snake"),
                    F.col("p_brand").startswith("Brand#1").alias("brand_1x"),
                    F.col("p_name").endswith("bolt").alias("is_bolt"),
                    F.col("p_name").contains("red").alias("has_red"),
                    F.regexp_replace("p_type", "[AEIOU]", "").alias("type_consonants"),
                    F.to_json(F.struct("p_partkey", "p_size")).alias("as_json"))


@query("scalar_number",
       "SELECT o_orderkey, round(abs(o_totalprice - 200000), 6) AS dist, round_even(o_totalprice / 1000, 1) AS k_price, "
       "round(greatest(CAST(100000.0 AS DOUBLE), least(CAST(400000.0 AS DOUBLE), o_totalprice)), 6) AS clipped, "
       "TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority_num, "
       "format('{:,}', o_orderkey * 1000) AS key_thousands FROM orders")
def q_scalar_number(spark, sf_dir):
    from facsimile.functions.fmt import to_number
    from facsimile.functions.rng import clip
    o = load(spark, sf_dir, "orders")
    return r6(o.select("o_orderkey", F.abs(F.col("o_totalprice") - 200000).alias("dist"),
                       F.bround(F.col("o_totalprice") / 1000, 1).alias("k_price"),
                       clip(F.col("o_totalprice"), 100000.0, 400000.0).alias("clipped"),
                       to_number(F.substring("o_orderpriority", 1, 1)).alias("priority_num"),
                       F.format_number(F.col("o_orderkey") * 1000, 0).alias("key_thousands")))


@query("percent_text",
       "SELECT o_orderkey, CAST(CAST(round(o_totalprice / m * 100, 1) AS DECIMAL(38,1)) AS VARCHAR) || '%' AS share, "
       "CAST(CAST(round(o_totalprice / a, 2) AS DECIMAL(38,2)) AS VARCHAR) || 'x' AS times "
       "FROM orders, (SELECT max(o_totalprice) AS m, 777.0::DOUBLE AS a FROM orders)")
def q_percent_text(spark, sf_dir):
    from facsimile.functions.fmt import percent_text, ratio_text
    o = load(spark, sf_dir, "orders")
    most = F.lit(o.agg(F.max("o_totalprice")).first()[0])
    return o.select("o_orderkey", percent_text(F.col("o_totalprice"), most).alias("share"), ratio_text(F.col("o_totalprice"), F.lit(777.0)).alias("times"))


@query("scalar_date",
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts_text, o_orderdate + INTERVAL 1 HOUR "
       "AS next_hour, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m FROM orders")
def q_scalar_date(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ts_text"),
                    F.timestamp_add("HOUR", F.lit(1), F.col("o_orderdate")).alias("next_hour"),
                    F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))


# ============================================================ readers, names, constants and failures by their rows

@query("load_dispatch", " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, count(DISTINCT o_orderpriority) AS priorities FROM orders"
    for kind in ("csv", "json", "parquet")))
def q_load_dispatch(spark, sf_dir):
    """One table by its file's extension, whatever its case."""
    from facsimile.session import scratch_path
    from facsimile.sources import io
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    out = None
    for kind, ending in (("csv", ".csv"), ("json", ".JSON"), ("parquet", ".Parquet")):
        path = scratch_path(spark, "dispatch") + ending
        {"csv": io.write_csv, "json": io.write_json, "parquet": lambda d, p: d.write.parquet(p)}[kind](o, path)
        t = io.load_table(spark, path).agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"),
                                           F.count_distinct("o_orderpriority").alias("priorities"))
        out = t if out is None else out.unionByName(t)
    return out


@query("select_strict", "SELECT o_totalprice, o_orderkey, o_orderstatus AS \"order.status\" FROM orders")
def q_select_strict(spark, sf_dir):
    from facsimile.plans.generate import select_strict
    o = load(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "order.status")
    return select_strict(o, ["o_totalprice", "o_orderkey", "order.status"])


@query("clean_names", "SELECT o_orderkey AS \"key\", o_custkey AS \"key.1\", o_orderstatus AS \"order.status\", "
                      "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS \"Unnamed: 3\" FROM orders")
def q_clean_names(spark, sf_dir):
    """Padded, repeated, dotted and missing header names."""
    from facsimile.session import scratch_path
    from facsimile.sources import io
    path = scratch_path(spark, "names")
    o = load(spark, sf_dir, "orders")
    lines = o.select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string"))).alias("value"))
    # every part file begins with the header, as files of one layout do
    headed = lines.withColumn("part", F.spark_partition_id())
    head = headed.select("part").distinct().select("part", F.lit(0).alias("at"), F.lit(" key ,key,\torder.status, ").alias("value"))
    (head.unionByName(headed.select("part", F.lit(1).alias("at"), "value")).repartition("part").sortWithinPartitions("part", "at")
     .select("part", "value").write.partitionBy("part").text(path))
    files = io._listed(spark, [r[0] for r in spark.read.text(path).select(F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1)).distinct().collect()])[0]
    data, _ = io.read_csv_files(spark, files)
    return data.drop("dataset")


@query("constant_columns",
       f"SELECT i.id AS id, 7.5::DOUBLE AS one, NULL::DOUBLE AS none, '' AS empty, 'same' AS word FROM {ORD_IDS} i")
def q_constant_columns(spark, sf_dir):
    """A constant number repeats, no numbers stay none, no texts become empty ones, one text repeats."""
    o = load(spark, sf_dir, "orders").select(F.lit(7.5).alias("one"), F.lit(None).cast("double").alias("none"),
                                             F.lit(None).cast("string").alias("empty"), F.lit("same").alias("word"))
    return synth.synthesize_independent(o, SynthConfig(method="independent", keep_id=True))


@query("short_year_format",
       "SELECT o_orderkey, CAST(round_even(year, 0) AS BIGINT) AS year, round_even(price_date, 2) AS price_date, "
       "CAST(round_even(y, 0) AS BIGINT) AS y FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, "
       "CAST(year(o_orderdate) AS DOUBLE) + 0.25 AS year, o_totalprice AS price_date, CAST(year(o_orderdate) AS DOUBLE) AS y FROM orders)")
def q_short_year_format(spark, sf_dir):
    """The display's short rule: by the names year and yr, or by values; 'date' in a name says nothing there."""
    y = F.year("o_orderdate").cast("double")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), (y + 0.25).alias("year"),
                                             F.col("o_totalprice").alias("price_date"), y.alias("y"))
    return formatting.format_types(o, rule="short")


@query("batch_failures",
       "SELECT 'good' AS file, count(*) AS original_rows, count(*) AS synthetic_rows, 'Success' AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') UNION ALL "
       "SELECT 'bad', count(*), 0, 'Error: ' || count(*) FILTER (o_orderstatus = 'F') || ' malformed rows' FROM orders WHERE o_orderpriority = '2-HIGH' UNION ALL "
       "SELECT 'header', 0, 0, 'Error: no rows' UNION ALL SELECT 'gone', 0, 0, 'Error: no such file'")
def q_batch_failures(spark, sf_dir):
    """A batch of good files of two layouts, one with malformed rows, one with a header alone and one that is not there."""
    from facsimile.plans.batch import run_batch
    from facsimile.session import scratch_path
    from facsimile.sources import io
    o = load(spark, sf_dir, "orders")
    root = scratch_path(spark, "failures")
    pick = lambda name: o.where(F.col("o_orderpriority") == name).coalesce(1)
    io.write_csv(pick("1-URGENT").select("o_totalprice", "o_custkey"), f"{root}/a")
    io.write_csv(pick("3-MEDIUM").select("o_custkey", "o_totalprice", "o_orderstatus"), f"{root}/b")
    # rows of finished orders hold one field too many
    line = F.concat_ws(",", F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "x"))
    bad = pick("2-HIGH").select(F.lit(1).alias("at"), line.alias("value"))
    head = spark.range(1).select(F.lit(0).alias("at"), F.lit("o_totalprice,o_custkey").alias("value"))
    head.unionByName(bad).repartition(1).sortWithinPartitions("at").select("value").write.text(f"{root}/c")
    io.write_csv(o.limit(0).select("o_totalprice", "o_custkey").coalesce(1), f"{root}/d")
    status = run_batch(spark, [f"{root}/{x}" for x in "abcd"] + [f"{root}/gone.csv"], f"{root}/out", SynthConfig(method="copula"))
    names = {f.rsplit("/", 1)[-1]: kind for x, kind in (("a", "good"), ("b", "good"), ("c", "bad"), ("d", "header"))
             for f in io._listed(spark, [f"{root}/{x}"])[0]} | {"gone.csv": "gone"}
    kind = F.create_map(*[F.lit(v) for n, k in names.items() for v in (n.replace(".csv", "_synthetic.csv"), k)])[F.col("dataset")]
    return status.groupBy(kind.alias("file"), "status").agg(F.sum("original_rows").alias("original_rows"),
                                                            F.sum("synthetic_rows").alias("synthetic_rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
