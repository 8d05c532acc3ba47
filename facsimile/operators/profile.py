"""Profiling: one aggregate pass for all columns, plus exact quantiles, frequencies,
mode, histogram and correlation -- each one job, none gathering a column in one task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.names import named
from facsimile.functions.consts import double_array, long_to_longs_map, sql_string
from facsimile.functions.fmt import is_blank, to_number
from facsimile.functions.exact import exact_means
from facsimile.session import reused, written
from facsimile.schema import (BLANK_FILL, HIST_BINS, MALE_FEMALE, TRUE_FALSE, YEAR_MAX,
                              YEAR_MAX_DISTINCT, YEAR_MIN, YES_NO, ColumnSpec, is_year_name,
                              kind_of)

EXACT_DISTINCT_LIMIT = 1000   # approx distinct below this -> exact count by a bounded set
FAR = math.nextafter(math.nextafter(math.inf, 0.0), 0.0)    # stands for an infinite value while quantiles are bracketed
QUANTILE_GROUP_LIMIT = 100000  # distinct values per bracket before the final exact pick


def num(c: str | Column, dt: T.DataType | None = None) -> Column:
    """Column as double with NaN read as missing (pandas has one notion of missing)."""
    col = named(c) if isinstance(c, str) else c
    if dt is not None and isinstance(dt, T.BooleanType):
        return col.cast("int").cast("double")
    d = col.cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def missing(c: str, dt: T.DataType) -> Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return named(c).isNull() | F.isnan(named(c))
    return named(c).isNull()


def filled_text(c: str) -> Column:
    """String after the cleaning rule: null or blank -> 'Unknown'."""
    col = named(c)
    return F.when(col.isNull() | is_blank(col), F.lit(BLANK_FILL)).otherwise(col)


def profile(df: DataFrame, columns: list[str] | None = None) -> tuple[int, list[ColumnSpec]]:
    """(row count, one ColumnSpec per column) from two small aggregate jobs.

    Job 1 computes everything per column in one wide aggregate (map-side partial
    aggregation, one row out).  Job 2 counts distinct values exactly, but only for the
    columns whose approximate count is small enough for a bounded set (thresholds 50
    and 200 need exact counts).
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    # Derived values are projected once per row, then aggregated (one scan, one row out).
    proj = []
    for i, f in enumerate(fields):
        c, k = f.name, kind_of(f.dataType)
        proj.append(missing(c, f.dataType).alias(f"miss{i}"))
        if k in ("numeric", "boolean"):
            proj.append(num(c, f.dataType).alias(f"x{i}"))
        elif k == "string":
            proj += [named(c).alias(f"x{i}"), is_blank(named(c)).alias(f"blank{i}")]
        else:
            proj.append(named(c).alias(f"x{i}"))
    base = df.select(*proj)
    proj2 = []
    for i, f in enumerate(fields):
        k = kind_of(f.dataType)
        proj2 += [F.col(f"miss{i}"), F.col(f"x{i}")]
        if k == "string":
            t = F.when(F.col(f"x{i}").isNull() | F.col(f"blank{i}"), F.lit(BLANK_FILL)).otherwise(F.col(f"x{i}"))
            proj2 += [F.col(f"blank{i}"), t.alias(f"t{i}"), F.lower(t).alias(f"lt{i}")]
    base = base.select(*proj2)
    return _profile_passes(base, fields)


def _profile_passes(base: DataFrame, fields) -> tuple[int, list[ColumnSpec]]:
    # Pass 1 holds only declarative aggregates so it runs in whole-stage codegen; the
    # distinct-count sketches (imperative aggregates, which would switch the whole
    # aggregate to the interpreted path) get their own pass.
    aggs = [F.count(F.lit(1)).alias("__rows")]
    sketches = []
    for i, f in enumerate(fields):
        k = kind_of(f.dataType)
        x = F.col(f"x{i}")
        aggs.append(F.count_if(F.col(f"miss{i}")).alias(f"m{i}"))
        if k in ("numeric", "boolean"):
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                     F.coalesce(F.bool_and(x.between(YEAR_MIN, YEAR_MAX)), F.lit(True)).alias(f"yr{i}")]
            sketches.append(F.approx_count_distinct(x).alias(f"ad{i}"))
        elif k == "string":
            lt = F.col(f"lt{i}")
            # no min/max of text here: a string aggregate buffer would force the slow
            # sort-based, interpreted aggregation on the whole pass
            aggs += [F.coalesce(F.bool_and(lt.isin(*YES_NO)), F.lit(True)).alias(f"yn{i}"),
                     F.coalesce(F.bool_and(lt.isin(*MALE_FEMALE)), F.lit(True)).alias(f"mf{i}"),
                     F.coalesce(F.bool_and(lt.isin(*TRUE_FALSE)), F.lit(True)).alias(f"tf{i}"),
                     F.count_if(x.isNotNull() & F.col(f"blank{i}")).alias(f"bl{i}")]
            sketches.append(F.approx_count_distinct(f"t{i}").alias(f"ad{i}"))
        else:
            aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
            sketches.append(F.approx_count_distinct(x).alias(f"ad{i}"))
    row = base.agg(*aggs).first().asDict()
    row.update(base.agg(*sketches).first().asDict())
    n = int(row["__rows"])
    specs: list[ColumnSpec] = []
    exact_needed = []
    for i, f in enumerate(fields):
        k = kind_of(f.dataType)
        m = int(row[f"m{i}"])
        s = ColumnSpec(name=f.name, kind=k, dtype=f.dataType.simpleString(), count=n - m, nulls=m,
                       min=row.get(f"min{i}"), max=row.get(f"max{i}"),
                       distinct=int(row[f"ad{i}"]), year_by_name=is_year_name(f.name))
        if k in ("numeric", "boolean"):
            s.mean, s.std = row[f"mean{i}"], row[f"std{i}"]
            s.extra["in_year_range"] = bool(row[f"yr{i}"])
        if k == "string":
            s.extra.update(yes_no=bool(row[f"yn{i}"]), male_female=bool(row[f"mf{i}"]),
                           true_false=bool(row[f"tf{i}"]), blanks=int(row[f"bl{i}"]))
        if s.distinct <= EXACT_DISTINCT_LIMIT:
            exact_needed.append((i, f))
        specs.append(s)
    if exact_needed:
        ex = [F.size(F.collect_set(f"t{i}" if kind_of(f.dataType) == "string" else f"x{i}")).alias(f"d{i}")
              for i, f in exact_needed]
        erow = base.agg(*ex).first().asDict()
        for i, _ in exact_needed:
            specs[i].distinct = int(erow[f"d{i}"])
            specs[i].distinct_exact = True
    for s in specs:
        if s.kind == "numeric":
            # value rule: every non-null value in 1900..2100 and fewer than 200 distinct
            s.year_by_value = bool(s.extra.get("in_year_range")) and s.distinct_exact \
                and s.distinct < YEAR_MAX_DISTINCT
    return n, specs


# ---------------------------------------------------------------- exact quantiles

def _bucketize(d: DataFrame, splits: dict[int, list[float]]) -> DataFrame:
    """Bucket index of every listed column by its own sorted split points (JVM binary
    search in ``Bucketizer``); missing values go to a bucket past the last split."""
    from pyspark.ml.feature import Bucketizer

    cols = sorted(splits)
    prepared = d.select(*d.columns, *[F.coalesce(F.col(f"c{i}"), F.lit(float("nan"))).alias(f"n{i}") for i in cols])
    return Bucketizer(splitsArray=[[-math.inf] + splits[i] + [math.inf] for i in cols],
                      inputCols=[f"n{i}" for i in cols], outputCols=[f"b{i}" for i in cols],
                      handleInvalid="keep").transform(prepared)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    group_limit: int = QUANTILE_GROUP_LIMIT, accuracy: int = 10000,
                    max_rounds: int = 8) -> dict[tuple[str, float], float | None]:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    proj = df.select(*[num(c, types[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    with reused(proj) as d:
        return _exact_quantiles(d, columns, probs, group_limit, accuracy, max_rounds)


def _exact_quantiles(d: DataFrame, columns: list[str], probs: list[float], group_limit: int, accuracy: int,
                     max_rounds: int, known: dict | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``).

    Spark's exact ``percentile`` keeps every distinct value of a column in one buffer.
    Here a target rank that sits in a column with more than ``group_limit`` distinct
    values is first narrowed to a value bracket: ``percentile_approx`` proposes bounds
    (rank error <= bracket/accuracy) and one grouped count of the values bucketed by
    all proposed bounds gives the exact ranks of the bounds.  The last pass counts the
    distinct values inside the (merged) brackets, ranks them with a window per bracket
    and picks the target ranks.  Every pass is a scan with a small output, and the
    number of expressions does not grow with the number of probabilities.
    """
    # greatest and least pass over nulls, so these are kept apart
    d = d.select(*[F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(FAR)), F.lit(-FAR))).alias(c) for c in d.columns])
    if known is not None:
        known = {i: (n, _near(lo), _near(hi), ad) for i, (n, lo, hi, ad) in known.items()}
    if known is None:
        r = d.agg(*[e for i in range(len(columns)) for e in (
            F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"),
            F.max(f"c{i}").alias(f"hi{i}"), F.approx_count_distinct(f"c{i}").alias(f"ad{i}"))]).first()
        known = {i: (r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"], r[f"ad{i}"]) for i in range(len(columns))}
    r0 = {f"{k}{i}": v for i, vals in known.items() for k, v in zip(("n", "lo", "hi", "ad"), vals)}
    targets = []
    out: dict[tuple[str, float], float | None] = {}
    for i, c in enumerate(columns):
        n = r0[f"n{i}"]
        for p in probs:
            if n == 0:
                out[(c, p)] = None
                continue
            h = (n - 1) * p
            r_lo = int(math.floor(h))
            r_hi = min(int(math.ceil(h)), n - 1)
            targets.append(dict(col=i, name=c, p=p, r_lo=r_lo, r_hi=r_hi, frac=h - r_lo,
                                L=float(r0[f"lo{i}"]), U=float(r0[f"hi{i}"]), below=0, inside=n,
                                distinct=r0[f"ad{i}"], done=False, margin=3.0))

    for _ in range(max_rounds):
        active = [t for t in targets if not t["done"] and t["distinct"] > group_limit and t["L"] < t["U"]]
        if not active:
            break
        # pass A: one sketch per shared bracket proposes narrower bounds for its targets
        grouped: dict[tuple, list] = {}
        for t in active:
            grouped.setdefault((t["col"], t["L"], t["U"], t["below"], t["inside"]), []).append(t)
        exprs = []
        for k, ((ci, L, U, below, inside), ts) in enumerate(grouped.items()):
            x = F.col(f"c{ci}")
            qs = []
            for t in ts:
                qs += [max(0.0, (t["r_lo"] - below) / inside - t["margin"] / accuracy),
                       min(1.0, (t["r_hi"] + 1 - below) / inside + t["margin"] / accuracy)]
            exprs.append(F.percentile_approx(F.when(x.between(F.lit(L), F.lit(U)), x),
                                             double_array(qs), accuracy).alias(f"a{k}"))
        ra = d.agg(*exprs).first()
        for k, (_, ts) in enumerate(grouped.items()):
            a = ra[f"a{k}"]
            for j, t in enumerate(ts):
                t["nL"], t["nU"] = float(a[2 * j]), float(a[2 * j + 1])
        # pass B: exact counts of every piece between the proposed bounds, one groupBy
        splits: dict[int, list[float]] = {}
        for t in active:
            splits.setdefault(t["col"], set()).update((t["L"], t["U"], t["nL"], t["nU"]))
        splits = {ci: sorted(v) for ci, v in splits.items()}
        b = _bucketize(d, splits)
        cells = []
        for ci, sp in splits.items():
            arr = double_array([-math.inf] + sp)
            bk = F.col(f"b{ci}").cast("int")
            x = F.col(f"c{ci}")
            cells.append(F.when(x.isNotNull(), F.struct(F.lit(ci).alias("ci"), bk.alias("b"),
                                                        (x == F.element_at(arr, bk + 1)).alias("eq"), x.alias("x"))))
        pieces = (b.select(F.explode(F.filter(F.array(*cells), lambda z: z.isNotNull())).alias("z"))
                  .groupBy("z.ci", "z.b", "z.eq").agg(F.count(F.lit(1)).alias("n"),
                                                       F.approx_count_distinct("z.x").alias("dn")).collect())
        got = {(r["ci"], r["b"], r["eq"]): (r["n"], r["dn"]) for r in pieces}

        def count_between(ci, lo, hi, hi_inclusive):
            """Rows with lo <= x < hi (or <= hi), and their approximate distinct count."""
            sp = splits[ci]
            n = dn = 0
            for k in range(sp.index(lo) + 1, sp.index(hi) + 1):   # buckets [sp[k-1], sp[k])
                for eq in (True, False):
                    v = got.get((ci, k, eq), (0, 0))
                    n, dn = n + v[0], dn + v[1]
            if hi_inclusive:
                v = got.get((ci, sp.index(hi) + 1, True), (0, 0))
                n, dn = n + v[0], dn + v[1]
            return n, dn

        for t in active:
            ci = t["col"]
            below = t["below"] + count_between(ci, t["L"], t["nL"], False)[0]
            inside, dn = count_between(ci, t["nL"], t["nU"], True)
            if not (below <= t["r_lo"] and below + inside > t["r_hi"]):
                # the proposed bounds missed the rank: retry with a wider margin rather
                # than ranking a large bracket in one window group
                t["margin"] *= 4
                if t["margin"] * 2 > accuracy:
                    t["done"] = True
                continue
            if inside >= t["inside"]:
                t["done"] = True          # no progress (ties): rank the current bracket exactly
                continue
            t.update(L=t["nL"], U=t["nU"], below=below, inside=inside, distinct=dn)

    final = []
    for t in targets:
        if t["L"] == t["U"]:
            out[(t["name"], t["p"])] = float(t["L"])
        else:
            final.append(t)
    if final:
        # merge overlapping brackets of a column into disjoint intervals
        merged: dict[int, list[list]] = {}
        for t in sorted(final, key=lambda t: (t["col"], t["L"])):
            ms = merged.setdefault(t["col"], [])
            if ms and t["L"] <= math.nextafter(ms[-1][1], math.inf):
                ms[-1][1] = max(ms[-1][1], t["U"])
                ms[-1][3].append(t)
            else:
                ms.append([t["L"], t["U"], t["below"], [t]])
            t["m"] = len(ms) - 1
        splits = {ci: [v for m in ms for v in (m[0], math.nextafter(m[1], math.inf))] for ci, ms in merged.items()}
        b = _bucketize(d, splits)
        cells = []
        for ci in splits:
            bk = F.col(f"b{ci}").cast("int")
            x = F.col(f"c{ci}")
            # odd buckets are inside an interval: bucket 2m+1 <-> interval m
            cells.append(F.when(x.isNotNull() & (bk % 2 == 1),
                                F.struct((F.lit(ci * 100000) + (bk - 1) / 2).cast("long").alias("g"), x.alias("v"))))
        counts = (b.select(F.explode(F.filter(F.array(*cells), lambda z: z.isNotNull())).alias("z"))
                  .groupBy(F.col("z.g").alias("g"), F.col("z.v").alias("v")).count())
        wanted: dict[int, set] = {}
        for ci, ms in merged.items():
            for k, (_, _, below_m, ts) in enumerate(ms):
                for t in ts:
                    wanted.setdefault(ci * 100000 + k, set()).update((t["r_lo"] - below_m, t["r_hi"] - below_m))
        ranks = long_to_longs_map({g: sorted(rs) for g, rs in wanted.items()})
        w = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("cum", F.sum("count").over(w))
        hits = ranked.select("g", "v", F.filter(ranks[F.col("g")], lambda r: (F.col("cum") - F.col("count") <= r)
                                                & (r < F.col("cum"))).alias("r")).where(F.size("r") > 0)
        found: dict[tuple[int, int], float] = {}
        for row in hits.collect():   # at most two rows per target
            for r in row["r"]:
                found[(row["g"], r)] = row["v"]
        for t in final:
            ci = t["col"]
            m = merged[ci][t["m"]]
            g, below_m = ci * 100000 + t["m"], m[2]
            lo, hi = found.get((g, t["r_lo"] - below_m)), found.get((g, t["r_hi"] - below_m))
            out[(t["name"], t["p"])] = None if lo is None or hi is None else _between(lo, hi, t["frac"])
    return {k: _between(v, v, 0.0) if v is not None else None for k, v in out.items()}


def _near(x: float | None) -> float | None:
    return x if x is None else min(max(x, -FAR), FAR)


def _between(lo: float, hi: float, part: float) -> float:
    """The value ``part`` of the way from lo to hi, infinite ones (held as FAR) included."""
    if part and (hi >= FAR or lo <= -FAR) and lo != hi:
        return math.inf if hi >= FAR else -math.inf
    x = lo + part * (hi - lo)
    return math.inf if x >= FAR else -math.inf if x <= -FAR else x


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    q = exact_quantiles(df, columns, [0.5]) if columns else {}
    return {c: q[(c, 0.5)] for c in columns}


# ---------------------------------------------------------------- tables

def to_long(one_row: DataFrame, names: list[str], aliases: list[str], key: str = "column",
            value: str = "value", value_type: str | None = None) -> DataFrame:
    """Unpivot a one-row aggregate into (key, value) rows."""
    cols = [F.col(a) if value_type is None else F.col(a).cast(value_type) for a in aliases]
    arr = F.array(*[F.struct(F.lit(n).alias(key), c.alias(value)) for n, c in zip(names, cols)])
    return one_row.select(F.inline(arr))


def described(df: DataFrame, columns: list[str]) -> list[tuple]:
    """[(column, count, mean, std, min, p25, p50, p75, max)] of number columns, exact.

    The numeric projection is read once (kept when small enough) and shared by the
    moment aggregate, the exact sums and the quantile passes.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    proj = df.select(*[num(c, types[c]).alias(f"c{i}") for i, c in enumerate(columns)])
    inner = [f"c{i}" for i in range(len(columns))]
    with reused(proj) as d:
        stats = d.agg(*[e for i in range(len(columns)) for e in (
            F.count(f"c{i}").alias(f"n{i}"), F.stddev_samp(f"c{i}").alias(f"std{i}"), F.min(f"c{i}").alias(f"min{i}"),
            F.max(f"c{i}").alias(f"max{i}"))]).first()
        means = exact_means(d, inner)
        sk = d.agg(*[F.approx_count_distinct(f"c{i}").alias(f"ad{i}") for i in range(len(columns))]).first()
        known = {i: (stats[f"n{i}"], stats[f"min{i}"], stats[f"max{i}"], sk[f"ad{i}"]) for i in range(len(columns))}
        q = _exact_quantiles(d, columns, [0.25, 0.5, 0.75], QUANTILE_GROUP_LIMIT, 10000, 8, known)
    return [(c, int(stats[f"n{i}"]), means[None, f"c{i}"], stats[f"std{i}"], stats[f"min{i}"],
             q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)], stats[f"max{i}"]) for i, c in enumerate(columns)]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 %, max per numeric column, exact."""
    cols = columns or [f.name for f in df.schema.fields if kind_of(f.dataType) == "numeric"]
    schema = ("column string, count bigint, mean double, std double, min double, p25 double, "
              "p50 double, p75 double, max double")
    return df.sparkSession.createDataFrame(described(df, cols) if cols else [], schema)


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing) in one aggregate, unpivoted without leaving the executors."""
    fields = df.schema.fields
    agg = df.agg(*[F.count_if(missing(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)])
    return to_long(agg, [f.name for f in fields], [f"m{i}" for i in range(len(fields))],
                   "column", "missing")


def missing_total(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    total = reduce(lambda a, b: a + b, [F.count_if(missing(f.name, f.dataType)) for f in fields])
    return df.agg(total.alias("total_missing"), F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(fields)).alias("n_columns"))


#: The types a text's values may all be read as, the narrowest first; the join of two is the first that holds both.
LATTICE = ("boolean", "bigint", "double", "date", "timestamp", "string")
_DATE = r"^\d{4}-\d\d-\d\d$"
_STAMP = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d{1,6})?)?$"


def readable_as(x: Column) -> dict[str, Column]:
    """For each type below text, whether a text value can be read as it."""
    day, stamp = x.try_cast("date").isNotNull() & x.rlike(_DATE), x.try_cast("timestamp_ntz").isNotNull() & x.rlike(_STAMP)
    return {"boolean": F.lower(x).isin("true", "false"), "bigint": x.try_cast("bigint").isNotNull() & x.rlike(r"^\s*[+-]?\d+\s*$"),
            "double": to_number(x).isNotNull(), "date": day, "timestamp": day | stamp}


def joined_types(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, str | None]]:
    """{column: (values, narrowest type all of them can be read as)} of text columns, one aggregate; None without a value."""
    aggs = []
    for i, c in enumerate(columns):
        x = named(c)
        aggs.append(F.count(x).alias(f"n{i}"))
        aggs += [F.count_if(ok).alias(f"{kind}{i}") for kind, ok in readable_as(x).items()]
    if not columns:
        return {}
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        n = r[f"n{i}"]
        out[c] = n, next((k for k in LATTICE[:-1] if r[f"{k}{i}"] == n), "string") if n else None
    return out


def type_profile(df: DataFrame) -> DataFrame:
    """C4: (position, column, dtype, kind, non_null, missing, read_as), one row a column, by a scan of the values.

    ``read_as`` is the narrowest type that holds all values of a text column; of a number
    column 'bigint' if all its values are whole, else its own type; null without a value.
    """
    fields = df.schema.fields
    texts = [f.name for f in fields if kind_of(f.dataType) == "string"]
    types = joined_types(df, texts)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(missing(f.name, f.dataType)).alias(f"m{i}"))
        if kind_of(f.dataType) == "numeric":
            x = num(f.name, f.dataType)
            aggs.append(F.coalesce(F.bool_and((x == F.floor(x).cast("double")) & (F.abs(x) < 2.0 ** 53)), F.lit(False)).alias(f"w{i}"))
    r = df.agg(*aggs).first()
    rows = []
    for i, f in enumerate(fields):
        kind, n = kind_of(f.dataType), r["rows"] - r[f"m{i}"]
        own = f.dataType.simpleString()
        if n == 0:
            own = None
        elif kind == "string":
            own = types[f.name][1]
        elif kind == "numeric" and r[f"w{i}"]:
            own = "bigint"
        rows.append((i, f.name, f.dataType.simpleString(), kind, n, r[f"m{i}"], own))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, kind string, non_null bigint, missing bigint, read_as string")


def _typed_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, v0, v1, ..., count): how often each non-null value of column k occurs, in v{k} with its own type."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.struct(F.lit(k).alias("k"), *[(named(c) if i == k else F.lit(None).cast(fields[c])).alias(f"v{i}") for i, c in enumerate(columns)])
             for k in range(len(columns))]
    long = df.select(F.inline(F.array(*cells)))
    some = reduce(lambda a, b: a | b, [F.col(f"v{i}").isNotNull() & (F.col("k") == i) for i in range(len(columns))])
    return long.where(some).groupBy("k", *[f"v{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias("count"))


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count, probability) over non-null values, all columns in one job.

    The per-column totals come from the same aggregate, joined back on the column
    name (one row per column), so no window spans a whole column.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                 named(c).cast("string").alias("value"))
                                        for c in columns]))).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = df.agg(*[F.count(named(c)).alias(f"t{i}") for i, c in enumerate(columns)])
    totals = to_long(totals, columns, [f"t{i}" for i in range(len(columns))], "column", "total")
    return (counts.join(F.broadcast(totals), "column")
            .select("column", "value", "count", (F.col("count") / F.col("total")).alias("probability")))


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, rank, value, count): the ``k`` most frequent non-null values of each column, most frequent first.

    Equal counts stand in the order of the values' own type (9 before 10).  One count
    of all columns is written; then each column keeps its ``k`` best map-side, so nothing
    but ``k`` rows a column meets in one task.
    """
    counts = written(_typed_counts(df, columns), "counts")
    out = None
    for i, c in enumerate(columns):
        best = counts.where(F.col("k") == i).orderBy(F.desc("count"), f"v{i}").limit(k)
        own = Window.partitionBy("column").orderBy(F.desc("count"), "v")      # of these k rows
        part = (best.select(F.lit(c).alias("column"), F.col(f"v{i}").alias("v"), "count")
                .select("column", F.row_number().over(own).alias("rank"), F.col("v").cast("string").alias("value"), "count"))
        out = part if out is None else out.unionByName(part)
    return out


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode, mode_count): the most frequent non-null value, the smallest on ties (pandas ``mode()[0]``).

    Values are compared by their own type; the result shows them as text.
    """
    counts = _typed_counts(df, columns)
    values = [f"v{i}" for i in range(len(columns))]     # of a column's rows all but one are null
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("count")).alias("nc"), *values)).alias("m"))
    names = F.expr("array(" + ", ".join(sql_string(c) for c in columns) + ")")
    return best.select(F.element_at(names, F.col("k") + 1).alias("column"), F.coalesce(*[F.col(f"m.{v}").cast("string") for v in values]).alias("mode"),
                       (-F.col("m.nc")).alias("mode_count"))


def hist_edges(lo: float, hi: float, bins: int = HIST_BINS) -> list[float]:
    """numpy ``linspace`` edges: k * step + lo, the last edge exactly hi."""
    step = (hi - lo) / bins
    return [k * step + lo for k in range(bins)] + [hi]


def hist_bin(x: Column, lo: float, hi: float, bins: int = HIST_BINS) -> Column:
    """numpy's bin index for x in [lo, hi]: scaled guess, then corrected against the
    linspace edges (left-closed bins, last bin closed)."""
    step = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    guess = F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))).cast("int")
    i0 = F.least(guess, F.lit(bins - 1))
    i1 = F.when(x < edge(i0), i0 - 1).otherwise(i0)
    return F.when((x >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1)


def histogram(df: DataFrame, columns: list[str], bins: int = HIST_BINS,
              edges_from: DataFrame | None = None) -> DataFrame:
    """Equal-width histogram on the [min, max] of ``edges_from`` (default ``df``).

    Values outside the range are dropped, the last bin is closed, empty bins are kept.
    Output: (column, bin, lo, hi, count).
    """
    src = edges_from if edges_from is not None else df
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    rng = src.agg(*[e for i, c in enumerate(columns) for e in (
        F.min(num(c, types[c])).alias(f"lo{i}"), F.max(num(c, types[c])).alias(f"hi{i}"))]).first()
    spark = df.sparkSession
    parts = []
    edge_rows = []
    for i, c in enumerate(columns):
        lo, hi = rng[f"lo{i}"], rng[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        e = hist_edges(lo, hi, bins)
        edge_rows += [(c, b, e[b], e[b + 1]) for b in range(bins)]
        x = num(c, types[c])
        b = hist_bin(x, lo, hi, bins)
        parts.append(F.when(x.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(c).alias("column"), b.alias("bin"))))
    if not parts:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, count bigint")
    counts = (df.select(F.explode(F.filter(F.array(*parts), lambda s: s.isNotNull())).alias("s"))
              .groupBy(F.col("s.column").alias("column"), F.col("s.bin").alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    edges = spark.createDataFrame(edge_rows, "column string, bin int, lo double, hi double")
    return (edges.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def correlation_values(df: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """{(group, col_i, col_j): r} for all ordered pairs (group None without ``by``).

    For the driver's own use: the columns of one model or report, and two sides at most.
    Tables of many columns or groups take :func:`facsimile.operators.gram.correlations`.
    """
    from facsimile.operators.gram import correlations

    whole = bool(by) and kind_of(df.schema[by].dataType) == "numeric"
    out = {}
    for r in correlations(df, columns, by).where("i <= j").collect():
        g = int(r["g"]) if whole and r["g"] is not None else r["g"]
        out[(g, columns[r["i"]], columns[r["j"]])] = out[(g, columns[r["j"]], columns[r["i"]])] = r["corr"]
    if not by:      # a table without rows correlates nothing
        out = {(None, a, b): out.get((None, a, b)) for a in columns for b in columns}
    return out


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson (pairwise-complete rows, null on zero variance) as (col_i, col_j, corr), made on the executors."""
    from facsimile.operators.gram import correlations

    names = F.expr("array(" + ", ".join(sql_string(c) for c in columns) + ")")
    return correlations(df, columns).select(F.element_at(names, F.col("i") + 1).alias("col_i"),
                                            F.element_at(names, F.col("j") + 1).alias("col_j"), "corr")
