"""Embedding whitening by a bidiagonal qd solver.

Blocks of centred rows are reduced to triangular factors by QR, the factors are folded
to one, R.  On the driver R (as wide as a vector) is made bidiagonal by Householder
reflections; dqds finds its singular values, each to high relative accuracy, and twisted
factorisations give the right singular vectors, the whitening directions.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import arrow_limits, folded, matrices, sound_vector

SCALE, SHIFT = 64, 1_000_000
EPS = np.finfo(float).eps
LONG = (1 << 63) - 1


def integers(c: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000: longs, or Python integers where an entry is very large."""
    if np.abs(c).max(initial=0.0) < 1 << 40:
        return np.floor(c * SCALE).astype(np.int64) + SHIFT
    whole = [[(int(v) * SCALE if abs(v) >= 1 << 52 else math.floor(v * SCALE)) + SHIFT for v in row] for row in c.tolist()]
    return np.array(whole, object).reshape(c.shape)


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - S, exactly; ``total`` holds Python integers."""
    top = max(int(np.abs(x).max(initial=0)) * n, max((abs(int(t)) for t in total), default=0))
    if x.dtype == object or top >= 1 << 61:
        return n * x.astype(object) - total
    return n * x - total.astype(np.int64)


# --- the driver's part: singular values and vectors of a small triangular matrix ---

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): r = U B V' with B upper bidiagonal, by Householder reflections."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        v = x.copy()
        v[0] += math.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if np.linalg.norm(x[1:]) > 0 and size > 0 else None

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2 and (v := reflector(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential quotient-difference step; None when the shift is beyond the smallest value."""
    d, least = q[0] - shift, math.inf
    nq, ne = [], []
    for i in range(len(e)):
        least = min(least, d)
        if d < 0:
            return None
        s = d + e[i]
        nq.append(s)
        t = q[i + 1] / s if s > 0 else math.inf
        if not math.isfinite(t):
            return None
        ne.append(e[i] * t)
        d = d * t - shift
    nq.append(d)
    return (nq, ne, min(least, d)) if d >= 0 else None


def squared_singular_values(diag: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal matrix's singular values, falling, by dqds with deflation and splitting."""
    top = max(np.abs(diag).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if not top:
        return np.zeros(len(diag))
    q0, e0 = ((np.asarray(x) / top) ** 2 for x in (diag, upper))
    out: list[float] = []
    work = [(q0.tolist(), e0.tolist(), 0.0)]
    budget = 200 * len(q0) + 1000
    while work:
        q, e, sigma = work.pop()
        guess = 0.0
        while q:
            tiny = EPS * EPS
            if len(q) == 1:
                out.append(q[0] + sigma)
                break
            # a superdiagonal that no longer matters splits the matrix; the last one deflates a value
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= tiny * (sigma + min(q[i], q[i + 1])) or e[i] <= tiny * sigma or e[i] < 1e-300), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[-1] > q[0] * 2.25:     # graded the wrong way: the reversed matrix has the same values
                q, e = q[::-1], e[::-1]
            if len(q) == 2:
                b, c = q[0] + q[1] + e[0], q[0] * q[1]
                big = (b + math.sqrt(max(0.0, (q[0] - q[1]) ** 2 + e[0] * (e[0] + 2 * (q[0] + q[1]))))) / 2
                out += [big + sigma, (c / big if big else 0.0) + sigma]
                break
            a, b, off = q[-1] + 0.0, q[-2] + e[-2], q[-2] * e[-1]
            mid, half = (a + e[-1] + b) / 2, (b - a - e[-1]) / 2
            low = max(0.0, mid - math.sqrt(half * half + off))
            step = None
            for shift in (min(guess, low), low * (1 - 1e-8) - EPS * low, low * 0.75, low * 0.25):
                if 0 < shift and (step := _dqds(q, e, shift)):
                    break
            else:
                shift, step = 0.0, _dqds(q, e, 0.0)
            budget -= 1
            if step is None or budget < 0:
                raise ArithmeticError("dqds did not converge")
            q, e, least = step
            sigma += shift
            guess = least * (1 - 1e-3)
    return np.sort(np.array(out))[::-1] * top * top


def _twisted(a: np.ndarray, b: np.ndarray, lam: float, scale: float):
    """Twisted factorisation of the tridiagonal T - lam: (twist, pivots above and below, gamma)."""
    n, small = len(a), EPS * EPS * scale + 1e-300
    down, up = np.empty(n), np.empty(n)
    d = a[0] - lam
    for i in range(n):
        if abs(d) < small:
            d = small
        down[i] = d
        if i + 1 < n:
            d = a[i + 1] - lam - b[i] * b[i] / d
    d = a[-1] - lam
    for i in range(n - 1, -1, -1):
        if abs(d) < small:
            d = small
        up[i] = d
        if i:
            d = a[i - 1] - lam - b[i - 1] * b[i - 1] / d
    gamma = down + up - (a - lam)
    k = int(np.abs(gamma).argmin())
    return k, down, up, gamma[k] if abs(gamma[k]) > small else small


def _solve_twisted(f, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(T - lam)^-1 x through the factors N D N' of a twisted factorisation."""
    k, down, up, gamma = f
    n, y = len(x), x.astype(float).copy()
    for i in range(k):
        y[i + 1] -= b[i] / down[i] * y[i]
    for i in range(n - 1, k, -1):
        y[i - 1] -= b[i - 1] / up[i] * y[i]
    y[:k] /= down[:k]
    y[k + 1:] /= up[k + 1:]
    y[k] /= gamma
    for i in range(k - 1, -1, -1):
        y[i] -= b[i] / down[i] * y[i + 1]
    for i in range(k + 1, n):
        y[i] -= b[i - 1] / up[i] * y[i - 1]
    return y


def singular_vectors(diag: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of a bidiagonal matrix for its largest squared singular values.

    The vector of a value solves its twisted factorisation with a one at the twist.
    Vectors of values close to each other are made orthogonal and solved again.
    """
    n, scale = len(diag), float(values[0]) if len(values) else 0.0
    out = np.zeros((n, len(values)))
    if not scale:
        return np.eye(n)[:, :len(values)]
    a = diag * diag
    a[1:] += upper * upper
    b = diag[:-1] * upper
    rng = np.random.default_rng(0)
    start = 0
    for j, lam in enumerate(values):
        if j and values[j - 1] - lam > 1e-3 * scale:
            start = j
        near = out[:, start:j]
        f = _twisted(a, b, float(lam), scale)
        x = np.zeros(n)
        x[f[0]] = 1.0
        for attempt in range(6):
            with np.errstate(over="ignore", invalid="ignore"):
                x = _solve_twisted(f, b, x)
            if not np.isfinite(x).all() or not x.any():
                x = rng.standard_normal(n)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= near @ (near.T @ x)
            size = np.linalg.norm(x)
            if size < 1e-6:         # the same vector as before: begin elsewhere
                x = rng.standard_normal(n)
                x -= near @ (near.T @ x)
                size = np.linalg.norm(x)
            x /= size
            rest = a * x - lam * x
            rest[:-1] += b * x[1:]
            rest[1:] += b * x[:-1]
            if attempt and np.abs(rest).max() <= 8 * EPS * scale:
                break
        out[:, j] = x
    return out


@dataclass(frozen=True)
class Whitening:
    """Statistics and directions of the vectors of one length."""

    n: int
    total: tuple[int, ...]      # S
    values: np.ndarray          # eigenvalues of the covariance, falling, as many as components
    vectors: np.ndarray         # a column each
    trace: float
    error: float | None = None  # identity_error

    @property
    def sound(self) -> np.ndarray:
        """Components with more variance than rounding makes."""
        top = self.values[0] if len(self.values) else 0.0
        return self.values > top * EPS * max(1, len(self.total)) * 16

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviations n * x - S, whitened rows)."""
        dev = deviations(x, self.n, np.array(self.total, object))
        centred = (dev / self.n).astype(float)
        root = np.sqrt(np.where(self.sound, self.values, np.nan))
        return dev, centred @ self.vectors / root


def directions(r: np.ndarray, n: int, total: tuple[int, ...], components: int) -> Whitening:
    """The model from the triangular factor of all centred rows."""
    width = r.shape[1]
    square = np.zeros((width, width))
    square[:len(r)] = r[:width]
    diag, upper, right = bidiagonal(square)
    values = squared_singular_values(diag, upper)
    keep = values[:components]
    return Whitening(n, total, keep / n, right @ singular_vectors(diag, upper, keep), float((square * square).sum() / n))


def _fold_sums(states: list[bytes]) -> bytes:
    out: dict = {}
    for raw in states:
        for d, (n, total) in pickle.loads(raw).items():
            n0, t0 = out.get(d, (0, np.zeros(d, object)))
            out[d] = n0 + n, t0 + total
    return pickle.dumps(out)


def _fold_factors(states: list[bytes]) -> bytes:
    out: dict = {}
    for raw in states:
        for d, r in pickle.loads(raw).items():
            out[d] = np.linalg.qr(np.concatenate([out[d], r]), "r") if d in out else r
    return pickle.dumps(out)


def _fold_moments(states: list[bytes]) -> bytes:
    """(rows, mean, centred products) of two sets of rows make those of both."""
    out: dict = {}
    for raw in states:
        for d, (n, mean, prod) in pickle.loads(raw).items():
            if d in out:
                n0, m0, p0 = out[d]
                gap = mean - m0
                out[d] = n0 + n, m0 + gap * (n / (n0 + n)), p0 + prod + np.outer(gap, gap) * (n0 * n / (n0 + n))
            else:
                out[d] = n, mean, prod
    return pickle.dumps(out)


def _per_task(vectors: DataFrame, one, fold, name: str) -> dict:
    """``one(length, matrix)`` of every batch folded within tasks and then over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.dumps({})
        for b in batches:
            for d, _, c in matrices(b):
                if d:
                    held = fold([held, pickle.dumps({d: one(d, c)})])
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["state"])

    return pickle.loads(fold(folded(vectors.select("vec").mapInArrow(run, "state binary"), fold, name)))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`").cast("array<double>")
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("vec")).where(sound_vector(v))


def fit(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Whitening]:
    """Length of a vector -> its whitening, learned from all vectors of that length without null or non-finite entries.

    An entry c becomes the integer floor(64 * c) + 1000000.  Three readings: counts and
    exact sums; QR of the centred rows, block by block, the factors folded; and the
    covariance of the whitened rows, which gives ``error``.  What the driver holds is as
    wide as a vector, squared.
    """
    arrow_limits(vectors.sparkSession)
    rows = _rows(vectors, id_col, vec_col)
    sc = vectors.sparkSession.sparkContext

    def sums(d: int, c: np.ndarray):
        return len(c), integers(c).astype(object).sum(0)

    def factor(d: int, c: np.ndarray) -> np.ndarray:
        n, total = shared.value[d]
        return np.linalg.qr((deviations(integers(c), n, total) / n).astype(float), "r")

    def moments(d: int, c: np.ndarray):
        w = np.nan_to_num(models.value[d].project(integers(c))[1])
        mean = w.mean(0)
        return len(w), mean, (w - mean).T @ (w - mean)

    totals = _per_task(rows, sums, _fold_sums, "vector_sums")
    shared = sc.broadcast(totals)
    factors = _per_task(rows, factor, _fold_factors, "factors")
    out = {d: directions(factors[d], n, tuple(int(t) for t in total), components) for d, (n, total) in totals.items()}
    models = sc.broadcast(out)
    spread = _per_task(rows, moments, _fold_moments, "whitened")
    for d, (n, _, prod) in spread.items():
        ok = out[d].sound
        gap = np.abs(prod / n - np.eye(len(ok)))[np.ix_(ok, ok)]
        m = out[d]
        out[d] = Whitening(m.n, m.total, m.values, m.vectors, m.trace, float(gap.max()) if gap.size else 0.0)
    return out


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null, empty, or hold null or non-finite entries give no rows.
    Vectors of different lengths are whitened by themselves; n counts those of one
    length.  Repeated rows and null ids pass through one by one.  ``whitened`` is null
    for a component without variance (its eigenvalue is not above rounding), and
    ``explained`` is 0 where all vectors are equal; ``deviation`` is null where no long
    holds it.  Equal eigenvalues have any orthogonal directions of their space, the same
    for all rows.  No rows give no rows; other columns are not read.
    """
    arrow_limits(vectors.sparkSession)
    rows = _rows(vectors, id_col, vec_col)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, c in matrices(b, 1):
                if not d:
                    continue
                m = shared.value[d]
                dev, white = m.project(integers(c))
                k, rows_here = len(m.values), len(c)
                if dev.dtype == object or int(np.abs(dev).max(initial=0)) ** 2 * d > LONG:
                    square = (dev.astype(object) ** 2).sum(1).tolist()
                else:
                    square = (dev * dev).sum(1).tolist()
                square = pa.array([s if s <= LONG else None for s in square], pa.int64())
                again = pa.array(np.repeat(np.arange(rows_here), k))
                share = m.values / m.trace if m.trace else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                     pa.array(np.full(rows_here * k, m.n)), square.take(again), pa.array(white.ravel(), from_pandas=True),
                     pa.array(np.tile(share, rows_here)), pa.array(np.full(rows_here * k, m.error))], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")
