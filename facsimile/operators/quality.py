"""Quality: how close a synthetic table is to its source.

All metrics are small aggregates over the two tables (one scan per side per family
of metrics); the per-column results are long tables joined on the column name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.functions.names import named
from facsimile.functions.exact import exact_means
from facsimile.operators.clean import numeric_matrix
from facsimile.operators.profile import correlation_values, described, hist_bin, missing, num
from facsimile.session import reused
from facsimile.schema import (EPS, HIST_BINS, SCORE_GOOD, SCORE_MEDIUM, SHAPE_DEFAULT, SIZE_LARGE,
                              SIZE_MEDIUM, PRIVACY_DEFAULT, PRIVACY_LABELS, common_numeric_columns,
                              kind_of, numeric_columns)

OVERALL = "__overall__"   # key of the summary row (a real column may be called 'overall')


def side_stats(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> dict:
    """Per-side count, mean, std (n-1), min, max of every column -- one job for both
    sides (tagged union, grouped by side; only 2 x p numbers reach the driver)."""
    to = dict((f.name, f.dataType) for f in original.schema.fields)
    ts = dict((f.name, f.dataType) for f in synthetic.schema.fields)
    u = (original.select(F.lit(0).alias("__side"), *[num(c, to[c]).alias(f"c{i}") for i, c in enumerate(columns)])
         .unionByName(synthetic.select(F.lit(1).alias("__side"),
                                       *[num(c, ts[c]).alias(f"c{i}") for i, c in enumerate(columns)])))
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i in range(len(columns)):
        x = F.col(f"c{i}")
        aggs += [F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    rows = {r["__side"]: r for r in u.groupBy("__side").agg(*aggs).collect()}
    means = exact_means(u, [f"c{i}" for i in range(len(columns))], "__side") if columns else {}
    out = {"rows": [rows[k]["__rows"] if k in rows else 0 for k in (0, 1)], "columns": {}}
    for i, c in enumerate(columns):
        out["columns"][c] = [
            {"a": means.get((side, f"c{i}")), **{k: (rows[side][f"{k}{i}"] if side in rows else None) for k in ("s", "lo", "hi")}}
            for side in (0, 1)]
    return out


def _pres(o, s, eps: float = EPS):
    if o is None or s is None:
        return None
    return 1.0 - abs(o - s) / (abs(o) + eps)


def _mean(xs):
    """Plain mean that is undefined (None) if any term is undefined."""
    if not xs or any(x is None for x in xs):
        return None
    return sum(xs) / len(xs)


def column_stats_pair(original: DataFrame, synthetic: DataFrame, columns: list[str] | None = None,
                      stats: dict | None = None) -> DataFrame:
    """(position, column, orig_mean, orig_std, synth_mean, synth_std) for common numeric columns."""
    cols = columns if columns is not None else common_numeric_columns(original, synthetic)
    st = stats or side_stats(original, synthetic, cols)
    rows = [(i, c, st["columns"][c][0]["a"], st["columns"][c][0]["s"], st["columns"][c][1]["a"],
             st["columns"][c][1]["s"]) for i, c in enumerate(cols)]
    return original.sparkSession.createDataFrame(
        rows, "position int, column string, orig_mean double, orig_std double, synth_mean double, synth_std double")


def _preservation_rows(st: dict, cols: list[str]):
    per = [(c, i, _pres(st["columns"][c][0]["a"], st["columns"][c][1]["a"]),
            _pres(st["columns"][c][0]["s"], st["columns"][c][1]["s"])) for i, c in enumerate(cols)]
    if per:
        per.append((OVERALL, None, _mean([r[2] for r in per]), _mean([r[3] for r in per])))
    return per


def mean_std_preservation(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """H1/H2 per column plus the H3 summary row (column = '__overall__').

    The summary is the plain mean over columns and is null if any column's score is
    null (NaN in the source).
    """
    cols = common_numeric_columns(original, synthetic)
    rows = _preservation_rows(side_stats(original, synthetic, cols), cols)
    return original.sparkSession.createDataFrame(
        rows, "column string, position int, mean_preservation double, std_preservation double")


def overall_quality(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """H4: (overall mean preservation + overall std preservation) / 2."""
    cols = common_numeric_columns(original, synthetic)
    rows = _preservation_rows(side_stats(original, synthetic, cols), cols)
    m, s = (rows[-1][2], rows[-1][3]) if rows else (None, None)
    q = None if m is None or s is None else (m + s) / 2
    return original.sparkSession.createDataFrame(
        [(m, s, q)], "mean_preservation double, std_preservation double, overall_quality double")


def pooled_similarity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """H5: 1 - mean|o - s| / (mean|o| + eps) over columns, for means and for stds."""
    cols = common_numeric_columns(original, synthetic)
    st = side_stats(original, synthetic, cols)

    def pooled(k):
        o = [st["columns"][c][0][k] for c in cols]
        s_ = [st["columns"][c][1][k] for c in cols]
        pairs = [(x, y) for x, y in zip(o, s_) if x is not None and y is not None]
        if not pairs:
            return None
        return 1.0 - (sum(abs(x - y) for x, y in pairs) / len(pairs)) / (sum(abs(x) for x, _ in pairs) / len(pairs) + EPS)

    return original.sparkSession.createDataFrame([(pooled("a"), pooled("s"))],
                                                 "mean_similarity double, std_similarity double")


def corr_preservation(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """H6: Pearson correlation between the two flattened correlation matrices
    (diagonal included).  Both matrices come from one grouped aggregate job."""
    cols = common_numeric_columns(original, synthetic)
    if len(cols) < 2:
        raise ValueError("correlation preservation needs at least 2 common numeric columns")
    to = dict((f.name, f.dataType) for f in original.schema.fields)
    ts = dict((f.name, f.dataType) for f in synthetic.schema.fields)
    u = (original.select(F.lit(0).alias("__side"), *[num(c, to[c]).alias(c) for c in cols])
         .unionByName(synthetic.select(F.lit(1).alias("__side"), *[num(c, ts[c]).alias(c) for c in cols])))
    v = correlation_values(u, cols, by="__side")
    pairs = [(v.get((0, a, b)), v.get((1, a, b))) for a in cols for b in cols]
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    r = _pearson([x for x, _ in pairs], [y for _, y in pairs]) if pairs else None
    return original.sparkSession.createDataFrame([(r,)], "corr_preservation double")


# ---------------------------------------------------------------- similarity

def _check_viz_inputs(original: DataFrame, synthetic: DataFrame) -> list[str]:
    other = set(numeric_columns(synthetic))
    cols = [c for c in numeric_columns(original) if c in other]
    if not cols:
        raise ValueError("a similarity score compares numeric columns; the two tables share none")
    if len(cols) < 2:
        raise ValueError(f"a similarity score compares two or more shared numeric columns, not only {cols[0]!r}")
    return cols


def _pearson(xs: list[float], ys: list[float]):
    """Population-moment Pearson correlation, None on zero variance."""
    n = len(xs)
    mx, my = sum(xs) / n, sum(ys) / n
    cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / n
    vx = sum((x - mx) ** 2 for x in xs) / n
    vy = sum((y - my) ** 2 for y in ys) / n
    if not (vx > 0 and vy > 0):
        return None
    return cov / (math.sqrt(vx) * math.sqrt(vy))


def shape_scores(o: DataFrame, s: DataFrame, cols: list[str], bins: int = HIST_BINS,
                 stats: dict | None = None) -> dict[str, float | None]:
    """Per column: correlation of the two 20-bin histograms on the original's range.

    Skipped (None) when either side has zero (or undefined) std or a flat histogram;
    negative correlations floor at 0.  Counts stand in for densities: a density only
    rescales the counts (a flat count histogram is skipped even where the source's
    density arithmetic leaves rounding noise).  Both sides are binned in one job.
    """
    st = stats or side_stats(o, s, cols)
    keep = []
    for c in cols:
        so, ss = st["columns"][c][0]["s"], st["columns"][c][1]["s"]
        if so is None or ss is None or not (so > 0) or not (ss > 0):
            continue
        keep.append(c)
    out: dict[str, float | None] = {c: None for c in cols}
    if not keep:
        return out

    def cells(df: DataFrame, side: int):
        cs = []
        for c in keep:
            lo, hi = st["columns"][c][0]["lo"], st["columns"][c][0]["hi"]
            x = named(c)
            cs.append(F.when(x.between(F.lit(lo), F.lit(hi)),
                             F.struct(F.lit(side).alias("side"), F.lit(c).alias("column"),
                                      hist_bin(x, lo, hi, bins).alias("bin"))))
        return df.select(F.explode(F.filter(F.array(*cs), lambda z: z.isNotNull())).alias("z"))

    both = cells(o, 0).unionByName(cells(s, 1))
    counts = {(r["side"], r["column"], r["bin"]): r["n"] for r in
              both.groupBy("z.side", "z.column", "z.bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in keep:
        ho = [float(counts.get((0, c, b), 0)) for b in range(bins)]
        hs = [float(counts.get((1, c, b), 0)) for b in range(bins)]
        r = _pearson(ho, hs)
        out[c] = None if r is None else max(0.0, r)
    return out


def similarity_values(original: DataFrame, synthetic: DataFrame) -> dict:
    """H7 + H8 on the numeric matrices (missing -> 0): mean, std and shape similarity."""
    cols = _check_viz_inputs(original, synthetic)
    with reused(numeric_matrix(original, cols)) as o, reused(numeric_matrix(synthetic, cols)) as s:
        return _similarity_values(o, s, cols)


def _similarity_values(o: DataFrame, s: DataFrame, cols: list[str]) -> dict:
    st = side_stats(o, s, cols)
    if st["rows"][0] < 5 or st["rows"][1] < 5:
        raise ValueError(f"a similarity score needs five rows on each side, not {st['rows'][0]} and {st['rows'][1]}")
    ms = [_pres(st["columns"][c][0]["a"], st["columns"][c][1]["a"]) for c in cols]
    ss = [_pres(st["columns"][c][0]["s"], st["columns"][c][1]["s"]) for c in cols]
    ms, ss = [x for x in ms if x is not None], [x for x in ss if x is not None]
    shapes = [v for v in shape_scores(o, s, cols, stats=st).values() if v is not None]
    return {"mean_similarity": sum(ms) / len(ms) if ms else None,
            "std_similarity": sum(ss) / len(ss) if ss else None,
            "shape_similarity": sum(shapes) / len(shapes) if shapes else SHAPE_DEFAULT,
            "stats": st, "columns": cols}


def similarity_summary(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    v = similarity_values(original, synthetic)
    return original.sparkSession.createDataFrame(
        [(v["mean_similarity"], v["std_similarity"], v["shape_similarity"])],
        "mean_similarity double, std_similarity double, shape_similarity double")


def utility_fidelity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """H9: utility = (mean similarity + std similarity)/2, fidelity = shape similarity."""
    v = similarity_values(original, synthetic)
    u = None if v["mean_similarity"] is None or v["std_similarity"] is None else \
        (v["mean_similarity"] + v["std_similarity"]) / 2
    return original.sparkSession.createDataFrame([(u, v["shape_similarity"])],
                                                 "utility_score double, fidelity_score double")


def band(c: Column) -> Column:
    """>= 0.8 good, >= 0.6 medium, else low."""
    return F.when(c >= SCORE_GOOD, F.lit("good")).when(c >= SCORE_MEDIUM, F.lit("medium")).otherwise(F.lit("low"))


def _band(score: float | None) -> str | None:
    if score is None:
        return None
    return "good" if score >= SCORE_GOOD else "medium" if score >= SCORE_MEDIUM else "low"


def score_bands(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    v = similarity_values(original, synthetic)
    rows = [("Mean Similarity", v["mean_similarity"]), ("Std Similarity", v["std_similarity"]),
            ("Distribution Shape", v["shape_similarity"])]
    df = original.sparkSession.createDataFrame(rows, "metric string, score double")
    return df.select("metric", "score", band(F.col("score")).alias("band"))


# ---------------------------------------------------------------- report pieces

def _percent(o, s):
    if o is None or s is None:
        return None
    return 0.0 if o == 0 else abs(o - s) / abs(o) * 100.0


def percent_diffs(original: DataFrame, synthetic: DataFrame, first: int | None = None) -> DataFrame:
    """Mean and std difference in % of the shared numeric columns.

    ``first`` keeps those among the original's first so many numeric columns; the source's display shows 5.
    """
    other = set(synthetic.columns)
    cols = [c for c in numeric_columns(original)[:first] if c in other]
    st = side_stats(original, synthetic, cols)

    rows = [(i, c, _percent(st["columns"][c][0]["a"], st["columns"][c][1]["a"]),
             _percent(st["columns"][c][0]["s"], st["columns"][c][1]["s"])) for i, c in enumerate(cols)]
    return original.sparkSession.createDataFrame(
        rows, "position int, column string, mean_diff_pct double, std_diff_pct double")


def structure_compare(original: DataFrame, synthetic: DataFrame, stats: dict | None = None) -> DataFrame:
    """Rows, columns, size ratio (0 for an empty source), all columns kept."""
    st = stats or side_stats(original.select(), synthetic.select(), [])
    no, ns = st["rows"]
    row = (no, ns, len(original.columns), len(synthetic.columns), (ns / no) if no > 0 else 0.0,
           len(original.columns) == len(synthetic.columns))
    return original.sparkSession.createDataFrame([row], (
        "original_rows bigint, synthetic_rows bigint, original_columns int, synthetic_columns int, "
        "size_ratio double, all_columns_kept boolean"))


def size_ratio(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    return structure_compare(original, synthetic).select("size_ratio")


def profile_side(df: DataFrame, side: str) -> DataFrame:
    """H13 for one side: (side, position, column, dtype, missing, count, mean, std, min, p25, p50, p75, max)."""
    fields = df.schema.fields
    numeric = [f.name for f in fields if kind_of(f.dataType) == "numeric"]
    absent = df.agg(*[F.count_if(missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)]).first()
    stats = {r[0]: r[1:] for r in described(df, numeric)} if numeric else {}
    rows = [(side, i, f.name, f.dataType.simpleString(), int(absent[f"m{i}"]), *stats.get(f.name, [None] * 8)) for i, f in enumerate(fields)]
    return df.sparkSession.createDataFrame(rows, (
        "side string, position int, column string, dtype string, missing bigint, count bigint, mean double, "
        "std double, min double, p25 double, p50 double, p75 double, max double"))


def profile_pair(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    return profile_side(original, "original").unionByName(profile_side(synthetic, "synthetic"))


def privacy_label(level: Column) -> Column:
    """Low -> Medium-Low, Medium -> Medium, High -> High, other -> Medium."""
    m = F.create_map(*[F.lit(x) for kv in PRIVACY_LABELS.items() for x in kv])
    return F.coalesce(m[level], F.lit(PRIVACY_DEFAULT))


def size_tier(rows: Column) -> Column:
    """> 100,000 large, > 50,000 medium, else small."""
    return F.when(rows > SIZE_LARGE, F.lit("large")).when(rows > SIZE_MEDIUM, F.lit("medium")).otherwise(F.lit("small"))


# ---------------------------------------------------------------- documents and report

def profile_document(df: DataFrame, name: str = "table") -> DataFrame:
    """(name, document): one JSON text with the profile of a table, put together on the executors.

    ``{"table", "columns": [{"position", "column", "dtype", "missing", "count", "mean", "std",
    "min", "p25", "p50", "p75", "max"}]}``; numbers are texts of six decimals (those of 25 digits
    and more in scientific form), absent ones null.  A row a column is all that meets in one task.
    """
    side = profile_side(df, name)

    def text(c: str) -> Column:
        x = F.col(c)
        plain = F.round(x, 6).try_cast("decimal(38,6)").cast("string")
        return F.when(F.abs(x) < 1e25, plain).otherwise(x.cast("string")).alias(c)

    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    cells = F.struct("position", "column", "dtype", F.col("missing").cast("string").alias("missing"),
                     F.col("count").cast("string").alias("count"), *[text(c) for c in stats])
    one = side.groupBy(F.col("side").alias("name")).agg(F.array_sort(F.collect_list(cells)).alias("columns"))
    return one.select("name", F.to_json(F.struct(F.col("name").alias("table"), "columns"), {"ignoreNullFields": "false"}).alias("document"))


def quality_report(original: DataFrame, synthetic: DataFrame, method: str = "independent",
                   privacy_level: str | None = None) -> DataFrame:
    """H16 as one long table (section, column, metric, value, note); the HTML is not rebuilt.

    Sections: structure with the method used (and the label of ``privacy_level`` if given), preservation with the overall quality and
    the correlation preservation, percent differences of every shared numeric column, similarity with
    the bands of its scores, and the explained variance of two principal components.
    A section that the tables do not allow says why in its ``status`` row.  The shared
    number columns of a side are read once (kept when small enough) for all sections.
    """
    cols = common_numeric_columns(original, synthetic)
    shape = len(original.columns), len(synthetic.columns)
    narrow = [t.select(*[named(c) for c in cols]) for t in (original, synthetic)]
    if not cols:
        return original.sparkSession.createDataFrame(_report_rows(*narrow, cols, shape, method, privacy_level), _REPORT)
    with reused(narrow[0]) as o, reused(narrow[1]) as s:
        return original.sparkSession.createDataFrame(_report_rows(o, s, cols, shape, method, privacy_level), _REPORT)


_REPORT = "section string, column string, metric string, value double, note string"


def _report_rows(original: DataFrame, synthetic: DataFrame, cols: list[str], shape: tuple[int, int], method: str,
                 privacy_level: str | None) -> list[tuple]:
    st = side_stats(original, synthetic, cols)
    no, ns = st["rows"]
    rows = [("structure", None, "method", None, method),
            ("structure", None, "original_rows", float(no), None), ("structure", None, "synthetic_rows", float(ns), None),
            ("structure", None, "original_columns", float(shape[0]), None),
            ("structure", None, "synthetic_columns", float(shape[1]), None),
            ("structure", None, "size_ratio", (ns / no) if no > 0 else 0.0, None),
            ("structure", None, "all_columns_kept", float(shape[0] == shape[1]), None)]
    if privacy_level is not None:
        rows.append(("structure", None, "privacy", None, PRIVACY_LABELS.get(privacy_level, PRIVACY_DEFAULT)))
    per = _preservation_rows(st, cols)
    for c, _, mp, sp in per:
        rows += [("preservation", c, "mean_preservation", mp, None), ("preservation", c, "std_preservation", sp, None)]
    if per:
        m, s = per[-1][2], per[-1][3]
        rows.append(("preservation", None, "overall_quality", None if m is None or s is None else (m + s) / 2, None))
    if len(cols) >= 2:
        rows.append(("preservation", None, "corr_preservation", corr_preservation(original, synthetic).first()[0], None))
    else:
        rows.append(("preservation", None, "status", None, f"correlations need two shared numeric columns, not {len(cols)}"))
    for c in cols:
        for k, name in (("a", "mean_diff_pct"), ("s", "std_diff_pct")):
            rows.append(("differences", c, name, _percent(st["columns"][c][0][k], st["columns"][c][1][k]), None))
    try:
        v = similarity_values(original, synthetic)
        u = None if v["mean_similarity"] is None or v["std_similarity"] is None else \
            (v["mean_similarity"] + v["std_similarity"]) / 2
        for k, val in [("mean_similarity", v["mean_similarity"]), ("std_similarity", v["std_similarity"]),
                       ("shape_similarity", v["shape_similarity"]), ("utility_score", u),
                       ("fidelity_score", v["shape_similarity"])]:
            rows.append(("similarity", None, k, val, _band(val)))
    except ValueError as e:
        rows.append(("similarity", None, "status", None, str(e)))
    if len(cols) >= 2 and no >= 2:
        from facsimile.operators.pca import pca_variance
        for r in pca_variance(original, cols).collect():     # two rows
            rows.append(("components", None, f"explained_variance_{r['component']}", r["explained_variance_ratio"], None))
    else:
        rows.append(("components", None, "status", None, "components need two shared numeric columns and two rows"))
    return rows
