"""Gaussian-copula synthesis (F1), after the published method for synthetic tables
(Patki, Wedge and Veeramachaneni, IEEE DSAA 2016), built from Spark aggregates.

Fit (a few small jobs): marginal quantile knots of every continuous column at
Phi(z) for z = -4..4 step 0.05 (exact quantiles, so the same on any partitioning), and the
exact minimum and maximum, which the tails beyond the outer knots run to; the
frequencies of every text column of at most 50 values and of every number column of at
most 100, whose draws keep to these values; the correlation matrix of
the normal scores (Gram blocks).  Scores of steps correlate less than the normals
behind them; the latent correlations undo that.  The p x p matrix is
repaired to positive definite and factored on the driver.

Sample: ``range(n)``, p reproducible standard normals per row, z = L e, then each
column back through its marginal: knot interpolation (constant time, indexes into a
literal array) for continuous columns, a binary search of thresholds for the others.

Beyond |z| = 4 the part of the way from the extreme back to the outer knot is
exp((16 - z^2) / 2), which falls with z about as the normal's tail does, so draws spread
over the whole range to the extreme and pile up nowhere.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions import rng
from facsimile.functions.consts import double_array, string_array
from facsimile.functions.fmt import round_year, strip
from facsimile.functions.latent import PROBS, Z_LO, Z_N, Z_STEP, Z_GRID, Marginal, latent_correlation, nearest_positive
from facsimile.functions.names import free_name, named
from facsimile.operators.profile import correlation_values, exact_quantiles, filled_text, num, profile
from facsimile.operators.synth import ROW, format_numeric, resample_column, synthetic_ids
from facsimile.schema import LABEL_MAX_DISTINCT, ColumnSpec, SynthConfig
from facsimile.session import reused

DISCRETE_MAX = 100      # a number column of so many values at most keeps to them


class CopulaModel:
    def __init__(self):
        self.columns: list[str] = []            # modelled, in source order
        self.marginals: dict[str, Marginal] = {}
        self.integer: dict[str, bool] = {}
        self.chol: np.ndarray | None = None
        self.corr: np.ndarray | None = None

    @property
    def knots(self) -> dict[str, np.ndarray]:
        return {c: m.knots for c, m in self.marginals.items() if m.knots is not None}

    @property
    def ends(self) -> dict[str, tuple[float, float]]:
        return {c: m.ends for c, m in self.marginals.items() if m.knots is not None}

    def steps(self, c: str) -> bool:
        return self.marginals[c].knots is None


def _distinct_knots(knots: list[float]) -> tuple[list[float], list[float]]:
    """Bucketizer splits over the distinct knots, each with the mean z of its ties."""
    uniq, zs = [], []
    for x, z in zip(knots, Z_GRID):
        if uniq and x == uniq[-1]:
            zs[-1].append(z)
        else:
            uniq.append(x)
            zs.append([z])
    zval = [sum(z) / len(z) for z in zs]
    return uniq, zval


def _step_marginals(df: DataFrame, numbers: list[str], texts: list[str], types) -> dict[str, Marginal]:
    """Values and cumulative frequencies of columns of few values, one job for all."""
    if not numbers and not texts:
        return {}
    none_d, none_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    cells = [F.struct(F.lit(i).alias("c"), num(c, types[c]).alias("v"), none_s.alias("s")) for i, c in enumerate(numbers)]
    cells += [F.struct(F.lit(len(numbers) + i).alias("c"), none_d.alias("v"), strip(filled_text(c)).alias("s")) for i, c in enumerate(texts)]
    long = df.select(F.inline(F.array(*cells))).where("v is not null or s is not null")
    rows = long.groupBy("c", "v", "s").agg(F.count(F.lit(1)).alias("n")).collect()    # as many as the columns' few values
    out = {}
    for i, c in enumerate(numbers + texts):
        own = sorted((r["v"] if r["s"] is None else r["s"], r["n"]) for r in rows if r["c"] == i)
        n = sum(k for _, k in own)
        out[c] = Marginal(n, values=[v for v, _ in own], cum=np.cumsum([k for _, k in own]) / n)
    return out


def fit_copula(df: DataFrame, specs: list[ColumnSpec] | None = None) -> CopulaModel:
    if specs is None:
        _, specs = profile(df)
    m = CopulaModel()
    by = {s.name: s for s in specs}
    cont, few, texts = [], [], []
    for c in df.columns:
        s = by[c]
        if s.kind in ("numeric", "boolean") and s.count > 0:
            (few if s.distinct_exact and s.distinct <= DISCRETE_MAX else cont).append(c)
        elif s.kind == "string" and s.count > 0 and s.distinct_exact and s.distinct <= LABEL_MAX_DISTINCT:
            texts.append(c)
    m.columns = [c for c in df.columns if c in {*cont, *few, *texts}]
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    for c in m.columns:
        m.integer[c] = by[c].dtype in ("tinyint", "smallint", "int", "bigint", "boolean")
    # marginals of continuous columns: 161 quantile knots each, one pass
    if cont:
        q = exact_quantiles(df, cont, [0.0, *PROBS, 1.0])   # exact: the same knots on any partitioning
        for c in cont:
            m.marginals[c] = Marginal(by[c].count, knots=np.array([float(q[(c, p)]) for p in PROBS]),
                                      ends=(float(q[(c, 0.0)]), float(q[(c, 1.0)])))
    m.marginals.update(_step_marginals(df, few, texts, types))
    # normal scores and the correlation behind them
    p = len(m.columns)
    r = np.eye(p)
    if p > 1:
        names = [f"z{i}" for i in range(p)]
        vals = correlation_values(_latent_frame(df, m, types), names)
        for i in range(p):
            for j in range(i + 1, p):
                v = vals[(None, names[i], names[j])]
                r[i, j] = r[j, i] = 0.0 if v is None or math.isnan(v) else v
    m.corr = nearest_positive(latent_correlation(r, [m.marginals[c] for c in m.columns]))
    m.chol = np.linalg.cholesky(m.corr)
    return m


def _latent_frame(df: DataFrame, m: CopulaModel, types) -> DataFrame:
    exprs, splits, names_in, names_out, zmaps, fills = [], [], [], [], {}, {}
    for i, c in enumerate(m.columns):
        own = m.marginals[c]
        if m.steps(c):
            mids = own.mids.tolist()
            mp = F.create_map(*[F.lit(x) for v, z in zip(own.values, mids) for x in (v, z)])
            x = strip(filled_text(c)) if isinstance(own.values[0], str) else num(c, types[c])
            # missing -> the median value
            exprs.append(F.coalesce(mp[x], F.lit(mids[int(np.searchsorted(own.cum, 0.5))])).alias(f"z{i}"))
            continue
        uniq, zval = _distinct_knots(own.knots.tolist())
        if len(uniq) < 2:
            exprs.append(F.lit(0.0).alias(f"z{i}"))
            continue
        exprs.append(num(c, types[c]).alias(f"x{i}"))
        splits.append([-float("inf")] + uniq + [float("inf")])
        names_in.append(f"x{i}")
        names_out.append(f"b{i}")
        zmaps[i] = (uniq, zval)
        fills[f"x{i}"] = float(own.knots[Z_N // 2])   # missing -> the median knot, as the cleaning rule does
    base = df.select(*exprs)
    if names_in:
        base = Bucketizer(splitsArray=splits, inputCols=names_in, outputCols=names_out,
                          handleInvalid="keep").transform(base.na.fill(fills))
    out = []
    for i, c in enumerate(m.columns):
        if i not in zmaps:
            out.append(F.col(f"z{i}"))
            continue
        uniq, zval = zmaps[i]
        own = m.marginals[c]
        # bucket b (1..len(uniq)-1 inside) lies between uniq[b-1] and uniq[b]
        xs = double_array(uniq)
        zs = double_array(zval)
        b = F.col(f"b{i}").cast("int")
        lo_i = F.least(F.greatest(b, F.lit(1)), F.lit(len(uniq) - 1))
        x0, x1 = F.element_at(xs, lo_i), F.element_at(xs, lo_i + 1)
        z0, z1 = F.element_at(zs, lo_i), F.element_at(zs, lo_i + 1)
        x = F.col(f"x{i}")
        z = F.when((x >= uniq[0]) & (x <= uniq[-1]), z0 + (x - x0) / (x1 - x0) * (z1 - z0))
        tail = min(1.0, 0.5 / own.n / PROBS[0])     # least part of a tail's way: the place of a source's own extreme
        for sign, end, knot in ((-1.0, own.ends[0], uniq[0]), (1.0, own.ends[1], uniq[-1])):
            if end != knot:
                part = F.greatest((F.lit(end) - x) / F.lit(end - knot), F.lit(tail))
                z = z.when(x < knot if sign < 0 else x > knot, F.lit(sign) * F.sqrt(F.lit(Z_LO ** 2) - 2 * F.log(part)))
        out.append(z.alias(f"z{i}"))
    return base.select(*out)


def sample_copula(df: DataFrame, model: CopulaModel, n: int, seed: int = 42, fast: bool = False,
                  specs: list[ColumnSpec] | None = None, keep_id: bool = False) -> DataFrame:
    """n rows from the fitted copula; columns the model does not cover (dates, text
    with many values) are resampled independently."""
    if specs is None:
        _, specs = profile(df)
    by = {s.name: s for s in specs}
    e = [rng.standard_normal(F.col(ROW), f"copula:{c}", seed, fast) for c in model.columns]
    zs = [sum((F.lit(float(model.chol[i, j])) * e[j] for j in range(i + 1) if model.chol[i, j] != 0.0), F.lit(0.0)).alias(f"z{i}")
          for i in range(len(model.columns))]
    drawn = synthetic_ids(df.sparkSession, n, ROW).select(ROW, *zs)
    steps = [(i, c) for i, c in enumerate(model.columns) if model.steps(c) and len(model.marginals[c].values) > 1]
    limits = {i: sorted(set(model.marginals[c].thresholds.tolist())) for i, c in steps}
    if steps:
        drawn = Bucketizer(splitsArray=[[-math.inf, *limits[i], math.inf] for i, _ in steps], inputCols=[f"z{i}" for i, _ in steps],
                           outputCols=[f"b{i}" for i, _ in steps]).transform(drawn)
    exprs = [F.col(ROW)]
    for i, c in enumerate(model.columns):
        own, z = model.marginals[c], F.col(f"z{i}")
        if own.knots is None:
            # values too rare for a threshold of their own lie with the one before
            place = [int(np.searchsorted(own.thresholds, t, "right")) for t in limits[i]] if i in limits else []
            values = [own.values[k] for k in (0, *place)]
            arr = string_array(values) if isinstance(values[0], str) else double_array(values)
            x = F.element_at(arr, F.col(f"b{i}").cast("int") + 1) if i in limits else F.lit(values[0])
            exprs.append((x if isinstance(values[0], str) else format_numeric(x, by[c])).alias(c))
            continue
        kn = own.knots.tolist()
        arr = double_array(kn)
        t = (z - F.lit(Z_LO)) / F.lit(Z_STEP)
        k = F.greatest(F.least(F.floor(t).cast("int"), F.lit(Z_N - 2)), F.lit(0))
        frac = t - k
        x = F.element_at(arr, k + 1) + frac * (F.element_at(arr, k + 2) - F.element_at(arr, k + 1))
        (lo, hi), part = own.ends, F.exp((F.lit(Z_LO ** 2) - z * z) / 2)
        x = (F.when(z < Z_LO, F.lit(lo) + part * F.lit(kn[0] - lo))
             .when(z > -Z_LO, F.lit(hi) - part * F.lit(hi - kn[-1])).otherwise(x))
        if model.integer[c]:
            x = round_year(x).cast("double")
        exprs.append(format_numeric(x, by[c]).alias(c))
    out = drawn.select(*exprs)
    for c in df.columns:
        if c not in model.columns:
            s = by[c]
            if s.count == 0:
                out = out.withColumn(c, F.lit(""))
            else:
                out = resample_column(out, df.select(named(c)), c, s, seed, fast, row=ROW)
    kept = [F.col(ROW).alias(free_name("id", df.columns))] if keep_id else []
    return out.select(*kept, *[named(c) for c in df.columns])


def synthesize_copula(df: DataFrame, config: SynthConfig | None = None) -> DataFrame:
    cfg = config or SynthConfig()
    with reused(df) as d:
        rows, specs = profile(d)
        model = fit_copula(d, specs)
        n = cfg.num_samples if cfg.num_samples is not None else rows
        return sample_copula(d, model, n, cfg.seed, cfg.fast, specs, cfg.keep_id)
