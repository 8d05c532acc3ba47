"""Encoding: choose an encoder per column, build one dictionary, encode, decode.

The dictionary is built from the data on the executors (distinct trimmed values per
column, ranked) and is small by construction -- label encoding is only chosen for
columns with at most 50 distinct values -- so it travels as literal maps inside the
plan: encode and decode are plain projections, no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.functions.consts import string_array
from facsimile.functions.fmt import is_blank, moment_of, strip, to_number, whole_moment
from facsimile.operators.profile import exact_quantiles, filled_text, modes, num, profile
from facsimile.schema import (BLANK_FILL, HASH_BUCKETS, LABEL_MAX_DISTINCT, MALE_FEMALE_CODES,
                              TRUE_FALSE_CODES, YES_NO_CODES, ColumnSpec)

RULE_CODES = {"yes_no": YES_NO_CODES, "male_female": MALE_FEMALE_CODES, "true_false": TRUE_FALSE_CODES}


def choose_encoder(s: ColumnSpec) -> str:
    """Encoder per column, first match wins."""
    if s.count == 0:
        return "zero"
    if s.kind == "string":
        if s.extra.get("yes_no"):
            return "yes_no"
        if s.extra.get("male_female"):
            return "male_female"
        if s.extra.get("true_false"):
            return "true_false"
        if s.distinct_exact and s.distinct <= LABEL_MAX_DISTINCT:
            return "label"
        return "to_number"
    if s.kind in ("numeric", "boolean"):
        return "median"
    return "moment" if s.kind == "temporal" else "keep"


@dataclass
class Encoding:
    rules: dict[str, str]
    dictionary: dict[str, list[str]] = field(default_factory=dict)   # column -> values by code
    fills: dict[str, float | None] = field(default_factory=dict)     # medians: numbers, days or microseconds of the epoch
    types: dict = field(default_factory=dict)                        # of the dates and timestamps among them
    modes: dict[str, str] = field(default_factory=dict)              # decode fallback


def build_dictionary(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct trimmed values of each column (code = position), one job.

    Runs on the executors: unpivot, distinct, rank per column.  Only columns already
    known to hold <= 50 distinct values are passed, so the result is bounded.
    """
    if not columns:
        return {}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), strip(filled_text(c)).alias("value"))
                                        for c in columns]))).distinct()
    w = Window.partitionBy("column").orderBy("value")
    ranked = long.withColumn("code", F.row_number().over(w) - 1).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(ranked, key=lambda r: (r["column"], r["code"])):
        out[r["column"]].append(r["value"])
    return out


def _map_literal(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def encode_column(c: str, rule: str, enc: Encoding) -> Column:
    col = named(c)
    if rule == "zero":
        return F.lit(0).alias(c)
    if rule in RULE_CODES:
        m = _map_literal(RULE_CODES[rule].items())
        # anything else cannot occur (the rule only fires when all values are in the set)
        return F.coalesce(m[F.lower(filled_text(c))], F.lit(0)).alias(c)
    if rule == "label":
        m = _map_literal((v, i) for i, v in enumerate(enc.dictionary[c]))
        return m[strip(filled_text(c))].alias(c)
    if rule == "to_number":
        fill = enc.fills.get(c)
        x = to_number(F.when(is_blank(col) | col.isNull(), F.lit(BLANK_FILL)).otherwise(col))
        return (F.coalesce(x, F.lit(fill)) if fill is not None else x).alias(c)
    if rule == "hash":
        return hash_encode(strip(filled_text(c))).cast("double").alias(c)
    if rule == "median":
        fill = enc.fills.get(c)
        x = num(c)
        return (F.coalesce(x, F.lit(float(fill))) if fill is not None else x).alias(c)
    if rule == "moment" and enc.fills.get(c) is not None:
        return F.coalesce(col, moment_of(enc.fills[c], enc.types[c])).alias(c)
    return col


def fit_encoding(df: DataFrame, specs: list[ColumnSpec] | None = None) -> Encoding:
    """Decide rules and learn dictionary, medians and modes (a few small jobs)."""
    if specs is None:
        _, specs = profile(df)
    rules = {s.name: choose_encoder(s) for s in specs}
    enc = Encoding(rules=rules)
    labels = [c for c, r in rules.items() if r == "label"]
    enc.dictionary = build_dictionary(df, labels)
    need_median = [s.name for s in specs if rules[s.name] == "median" and s.nulls > 0]
    moments = [s.name for s in specs if rules[s.name] == "moment" and s.nulls > 0]
    enc.types = {f.name: f.dataType for f in df.schema.fields if f.name in moments}
    text_num = [c for c, r in rules.items() if r == "to_number"]
    if need_median or text_num or moments:
        med_src = df.select(*[named(c) for c in need_median], *[whole_moment(named(c), enc.types[c]).alias(c) for c in moments],
                            *[to_number(named(c)).alias(c) for c in text_num])
        q = exact_quantiles(med_src, need_median + moments + text_num, [0.5])
        enc.fills = {c: q[(c, 0.5)] for c in need_median + moments + text_num}
        # text of many values of which none is a number would be lost: it is hashed
        enc.rules.update({c: "hash" for c in text_num if enc.fills[c] is None})
    if labels:
        enc.modes = {r["column"]: r["mode"] for r in modes(df, labels).collect()}
    return enc


def encode(df: DataFrame, enc: Encoding, float32: bool = False) -> DataFrame:
    """One projection: every column through its encoder (numbers as double, or float)."""
    out = []
    for c in df.columns:
        e = encode_column(c, enc.rules.get(c, "keep"), enc)
        if enc.rules.get(c) in ("median", "to_number", "zero"):
            e = e.cast("float" if float32 else "double").alias(c)
        out.append(e)
    return df.select(*out)


def preprocess(df: DataFrame, specs: list[ColumnSpec] | None = None,
               float32: bool = False) -> tuple[DataFrame, Encoding]:
    enc = fit_encoding(df, specs)
    return encode(df, enc, float32), enc


def decode_column(c: str, enc: Encoding, code: Column | None = None) -> Column:
    """code -> value by the one dictionary; unmapped -> mode of the source, else 'Unknown'."""
    x = named(c) if code is None else code
    values = enc.dictionary[c]
    arr = string_array(values) if all(isinstance(v, str) for v in values) else F.array(*[F.lit(v) for v in values])
    k = F.bround(x.cast("double"), 0).cast("int")
    hit = F.when((k >= 0) & (k < len(values)), F.element_at(arr, k + 1))
    return F.coalesce(hit, F.lit(enc.modes.get(c)), F.lit(BLANK_FILL)).alias(c)


def decode(df: DataFrame, enc: Encoding) -> DataFrame:
    return df.select(*[(decode_column(c, enc) if c in enc.dictionary else named(c)) for c in df.columns])


def hash_encode(c: Column, buckets: int = HASH_BUCKETS, fast: bool = False) -> Column:
    """Stable hash bucket of the text.  The source's per-process salted hash is not
    reproducible; the md5 form (first 60 bits) gives the same bucket in any engine,
    ``fast`` uses xxhash64 (cheaper, Spark only)."""
    if fast:
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(buckets))
    h = F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets))
