"""Builders for the DuckDB twin queries (SQL text only; nothing here runs Spark)."""

from __future__ import annotations

import math

from facsimile.functions.rng import TWO_POW_52


def d(x: float) -> str:
    """A double literal DuckDB will not read as DECIMAL."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def u_sql(id_sql: str, stream: str, seed: int = 42) -> str:
    return (f"(('0x' || substr(md5(concat(CAST({id_sql} AS VARCHAR), ':', '{stream}', ':', '{seed}')), 1, 13))"
            f"::BIGINT::DOUBLE / {d(TWO_POW_52)})")


def z_sql(id_sql: str, stream: str, seed: int = 42) -> str:
    """Box-Muller on the two uniforms of one md5 digest (hex digits 1-13 and 14-26)."""
    h = f"md5(concat(CAST({id_sql} AS VARCHAR), ':', '{stream}', ':', '{seed}'))"
    u1 = f"(('0x' || substr({h}, 1, 13))::BIGINT::DOUBLE / {d(TWO_POW_52)})"
    u2 = f"(('0x' || substr({h}, 14, 13))::BIGINT::DOUBLE / {d(TWO_POW_52)})"
    return f"(sqrt({d(-2.0)} * ln({d(1.0)} - {u1})) * cos({d(2.0 * math.pi)} * {u2}))"


def num(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def exact_mean6(x: str) -> str:
    """Mean of the decimal values of x, rounded half up to 6 places, in integer arithmetic
    (the twin of ``exact_avg`` followed by a 6-place round; values assumed >= 0 mean)."""
    scaled = f"CAST(CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 10)) * 10000000000 AS DECIMAL(38, 0)) AS HUGEINT)"
    return (f"(CAST((2 * sum({scaled}) + count({x}) * 10000) // (2 * count({x}) * 10000) AS DOUBLE) "
            f"/ {d(1000000.0)})")


def describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = num(c)
        parts.append(
            f"SELECT '{c}' AS \"column\", count({x}) AS count, {exact_mean6(x)} AS mean, "
            f"{r6(f'stddev_samp({x})')} AS std, {r6(f'min({x})')} AS min, "
            f"{r6(f'quantile_cont({x}, 0.25)')} AS p25, {r6(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{r6(f'quantile_cont({x}, 0.75)')} AS p75, {r6(f'max({x})')} AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


def corr_expr(a: str, b: str) -> str:
    """Pairwise-complete Pearson, null on zero variance (matches the Spark side)."""
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    xa, xb = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return (f"CASE WHEN stddev_pop({xa}) > 0 AND stddev_pop({xb}) > 0 "
            f"THEN covar_pop({xa}, {xb}) / (stddev_pop({xa}) * stddev_pop({xb})) END")


def corr_matrix_sql(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {r6(corr_expr(num(a), num(b)))} AS corr FROM {table}")
    return "\nUNION ALL\n".join(parts)


def mean_std_sql(table: str, cols: list[str], prefix: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, avg({num(c)}) AS {prefix}_mean, "
        f"{exact_mean6(num(c))} AS {prefix}_mean6, stddev_samp({num(c)}) AS {prefix}_std FROM {table}"
        for i, c in enumerate(cols))


def stats_pair_sql(orig: str, synth: str, cols: list[str]) -> str:
    return (f"(SELECT o.position, o.\"column\", o.orig_mean, o.orig_mean6, o.orig_std, s.synth_mean, "
            f"s.synth_mean6, s.synth_std "
            f"FROM ({mean_std_sql(orig, cols, 'orig')}) o JOIN ({mean_std_sql(synth, cols, 'synth')}) s "
            f"ON o.\"column\" = s.\"column\")")


def pres(o: str, s: str) -> str:
    return f"({d(1.0)} - abs({o} - {s}) / (abs({o}) + {d(1e-10)}))"


def freq_intervals_sql(table: str, col: str, group: str | None = None) -> str:
    """(g?, v, lo, hi): cumulative count intervals of the non-null values, sorted by value."""
    if group:
        return (f"(SELECT {group} AS g, {col} AS v, sum(cnt) OVER (PARTITION BY {group} ORDER BY {col}) - cnt AS lo, "
                f"sum(cnt) OVER (PARTITION BY {group} ORDER BY {col}) AS hi, sum(cnt) OVER (PARTITION BY {group}) AS n "
                f"FROM (SELECT {group}, {col}, count(*) AS cnt FROM {table} WHERE {col} IS NOT NULL GROUP BY 1, 2))")
    return (f"(SELECT {col} AS v, sum(cnt) OVER (ORDER BY {col}) - cnt AS lo, sum(cnt) OVER (ORDER BY {col}) AS hi, "
            f"sum(cnt) OVER () AS n FROM (SELECT {col}, count(*) AS cnt FROM {table} WHERE {col} IS NOT NULL GROUP BY 1))")


def resample_sql(ids: str, table: str, col: str, out: str, seed: int = 42) -> str:
    """(id, <out>) by weighted resampling of table.col for every id of ``ids``."""
    iv = freq_intervals_sql(table, col)
    return (f"(SELECT i.id, f.v AS {out} FROM {ids} i JOIN {iv} f "
            f"ON floor({u_sql('i.id', col, seed)} * f.n)::BIGINT >= f.lo "
            f"AND floor({u_sql('i.id', col, seed)} * f.n)::BIGINT < f.hi)")


def normal_col_sql(id_sql: str, col: str, mean_sql: str, std_sql: str, seed: int = 42) -> str:
    """mean + std * z, or the mean when std is 0 / undefined."""
    return (f"CASE WHEN {std_sql} IS NULL OR {std_sql} = 0 THEN {mean_sql} "
            f"ELSE {mean_sql} + {std_sql} * {z_sql(id_sql, col, seed)} END")


def bin_sql(x: str, lo: str, hi: str, bins: int = 20) -> str:
    """numpy's histogram bin of x on [lo, hi] (guess, then correction on linspace edges)."""
    step = f"(({hi} - {lo}) / {d(bins)})"

    def edge(i: str) -> str:
        return f"(CASE WHEN ({i}) >= {bins} THEN {hi} ELSE CAST({i} AS DOUBLE) * {step} + {lo} END)"

    i0 = f"least(floor(({x} - {lo}) / ({hi} - {lo}) * {d(bins)})::INTEGER, {bins - 1})"
    i1 = f"(CASE WHEN {x} < {edge(i0)} THEN {i0} - 1 ELSE {i0} END)"
    return f"(CASE WHEN {x} >= {edge(i1 + ' + 1')} AND {i1} <> {bins - 1} THEN {i1} + 1 ELSE {i1} END)"


def hist_sql(orig: str, synth: str | None, col: str, bins: int = 20) -> str:
    """(bin, ho[, hs]) counts on the original's [min, max], empty bins kept."""
    def counts(t: str, name: str) -> str:
        return (f"(SELECT {bin_sql(col, 'r.lo', 'r.hi', bins)} AS bin, "
                f"count(*) AS {name} FROM {t}, r WHERE {col} BETWEEN r.lo AND r.hi GROUP BY 1)")
    q = (f"WITH r AS (SELECT min({num(col)}) AS lo, max({num(col)}) AS hi FROM {orig}) "
         f"SELECT g.bin, coalesce(a.ho, 0)::DOUBLE AS ho")
    if synth:
        q += ", coalesce(b.hs, 0)::DOUBLE AS hs"
    q += f" FROM (SELECT range::INTEGER AS bin FROM range({bins})) g LEFT JOIN {counts(orig, 'ho')} a ON g.bin = a.bin"
    if synth:
        q += f" LEFT JOIN {counts(synth, 'hs')} b ON g.bin = b.bin"
    return q


def copula_pair_sql(table: str, a: str, b: str, group: str | None = None) -> str:
    """Twin of the Gaussian copula of two continuous columns without ties: knots, normal scores, their
    correlation, and the draws' way back, rounded to whole numbers; per ``group`` when given."""
    from facsimile.functions.latent import PROBS, Z_LO, Z_N, Z_STEP

    probs = "[" + ", ".join(repr(p) for p in PROBS) + "]"
    g, by = (f"{group} AS g, ", "g") if group else ("0 AS g, ", "g")

    def score(x: str) -> str:
        k, lo, hi = f"k{x}", f"lo{x}", f"hi{x}"
        n = f"least({Z_N - 1}, len(list_filter({k}, lambda v: v <= {x})))"
        inner = (f"{d(Z_LO)} + {d(Z_STEP)} * ({n} - 1) + ({x} - {k}[{n}]) / ({k}[{n} + 1] - {k}[{n}]) * {d(Z_STEP)}")
        tail = f"least({d(1)}, {d(0.5)} / n / {d(PROBS[0])})"
        return (f"CASE WHEN {x} < {k}[1] THEN -sqrt(16 - 2 * ln(greatest(({lo} - {x}) / ({lo} - {k}[1]), {tail}))) "
                f"WHEN {x} > {k}[{Z_N}] THEN sqrt(16 - 2 * ln(greatest(({hi} - {x}) / ({hi} - {k}[{Z_N}]), {tail}))) ELSE {inner} END")

    def draw(z: str, x: str) -> str:
        k, lo, hi = f"k{x}", f"lo{x}", f"hi{x}"
        t = f"(({z} - {d(Z_LO)}) / {d(Z_STEP)})"
        i = f"greatest(0, least({Z_N - 2}, floor({t})::BIGINT))"
        part = f"exp((16 - {z} * {z}) / 2)"
        return (f"round(round_even(CASE WHEN {z} < {d(Z_LO)} THEN {lo} + {part} * ({k}[1] - {lo}) WHEN {z} > {d(-Z_LO)} THEN {hi} - {part} * ({hi} - {k}[{Z_N}]) "
                f"ELSE {k}[{i} + 1] + ({t} - {i}) * ({k}[{i} + 2] - {k}[{i} + 1]) END, 2))")

    def normal(c: str) -> str:
        # the stream of a dataset's column ends in the dataset's name
        return z_sql("id", f"copula:{c}:' || g || '" if group else f"copula:{c}")

    return (f"WITH t AS (SELECT {g}{a} AS a, {b} AS b FROM {table}), "
            f"k AS (SELECT g, count(*) AS n, quantile_cont(a, {probs}) AS ka, min(a) AS loa, max(a) AS hia, "
            f"quantile_cont(b, {probs}) AS kb, min(b) AS lob, max(b) AS hib FROM t GROUP BY g), "
            f"r AS (SELECT t.g, corr({score('a')}, {score('b')}) AS r FROM t JOIN k ON k.g = t.g GROUP BY t.g), "
            f"ids AS (SELECT g, unnest(range(n)) AS id FROM k), "
            f"e AS (SELECT ids.g, id, {normal('a').replace(' g ', ' ids.g ')} AS ea, {normal('b').replace(' g ', ' ids.g ')} AS eb FROM ids), "
            f"z AS (SELECT e.g, e.id, ea AS za, r * ea + sqrt(1 - r * r) * eb AS zb FROM e JOIN r ON r.g = e.g) "
            f"SELECT {'z.g AS dataset, ' if group else ''}z.id, {draw('za', 'a')} AS a, {draw('zb', 'b')} AS b FROM z JOIN k ON k.{by} = z.g")
