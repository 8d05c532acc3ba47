"""Normal scores of marginals and the latent correlations behind them (numpy, one small matrix at a time).

A continuous marginal is 161 quantile knots at Phi(z), z = -4..4 by 0.05, and its exact
ends; a discrete one is its values with their cumulative probabilities.  The score of a
discrete value is the normal quantile in the middle of the value's interval; scores of
steps correlate less than the normals behind them, and ``latent_correlation`` finds
the correlation of those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np

Z_LO, Z_STEP, Z_N = -4.0, 0.05, 161
Z_GRID = [Z_LO + Z_STEP * k for k in range(Z_N)]
PROBS = [NormalDist().cdf(z) for z in Z_GRID]
TERMS = 80      # of the Hermite series
_N01 = NormalDist()


@dataclass
class Marginal:
    """One column: knots and ends, or values and their cumulative probabilities; neither for a column left out."""

    n: int
    knots: np.ndarray | None = None
    ends: tuple[float, float] = (0.0, 0.0)
    values: list | None = None
    cum: np.ndarray | None = None

    @property
    def varies(self) -> bool:
        return (self.knots is not None and self.ends[0] < self.ends[1]) or (self.values is not None and len(self.values) > 1)

    @property
    def mids(self) -> np.ndarray:
        low = np.concatenate([[0.0], self.cum[:-1]])
        return np.array([_N01.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)) for p in (low + self.cum) / 2])

    @property
    def thresholds(self) -> np.ndarray:
        return np.array([_N01.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)) for p in self.cum[:-1]])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Normal score of each value; of a missing one that of the median."""
        if self.knots is None:
            return self._step_scores(x)
        x = np.where(np.isnan(x), self.knots[Z_N // 2], x)
        uniq, first, count = np.unique(self.knots, return_index=True, return_counts=True)
        grid = np.array(Z_GRID)
        at = np.array([grid[a:a + n].sum() / n for a, n in zip(first, count)])     # ties share their mean score
        z = np.interp(x, uniq, at)
        tail = min(1.0, 0.5 / self.n / PROBS[0])
        for sign, end, knot in ((-1.0, self.ends[0], uniq[0]), (1.0, self.ends[1], uniq[-1])):
            out = x < knot if sign < 0 else x > knot
            if end != knot and out.any():
                part = np.maximum((end - x[out]) / (end - knot), tail)
                z[out] = sign * np.sqrt(Z_LO ** 2 - 2 * np.log(part))
        return z

    def _step_scores(self, x: np.ndarray) -> np.ndarray:
        mids, middle = self.mids, int(np.searchsorted(self.cum, 0.5))
        place = {v: k for k, v in enumerate(self.values)}
        return np.array([mids[place.get(v, middle)] for v in x.tolist()], float)

    def draws(self, z: np.ndarray):
        """Values of normal scores: numbers, or the list's own values."""
        if self.knots is None:
            return [self.values[k] for k in np.searchsorted(self.thresholds, z, "left").tolist()]
        t = (z - Z_LO) / Z_STEP
        k = np.clip(np.floor(t).astype(np.int64), 0, Z_N - 2)
        frac = t - k
        x = self.knots[k] + frac * (self.knots[k + 1] - self.knots[k])
        (lo, hi), part = self.ends, np.exp((Z_LO ** 2 - z * z) / 2)
        x = np.where(z < Z_LO, lo + part * (self.knots[0] - lo), x)
        return np.where(z > -Z_LO, hi - part * (hi - self.knots[-1]), x)

    def hermite(self) -> tuple[np.ndarray, float]:
        """(coefficients 1..TERMS of the score as a function of the normal behind it, its standard deviation)."""
        out = np.zeros(TERMS)
        if self.knots is not None:
            out[0] = 1.0
            return out, 1.0
        m, t = self.mids, self.thresholds
        p = np.diff(np.concatenate([[0.0], self.cum]))
        sd = math.sqrt(max(0.0, float((p * m * m).sum() - (p * m).sum() ** 2)))
        # a coefficient is the sum over thresholds of (step of the score) * h_{k-1}(t) * phi(t) / sqrt(k)
        phi = np.exp(-t * t / 2) / math.sqrt(2 * math.pi) * np.diff(m)
        before, now = np.zeros_like(t), np.ones_like(t)     # normalised Hermite polynomials
        for k in range(1, TERMS + 1):
            out[k - 1] = (phi * now).sum() / math.sqrt(k)
            before, now = now, (t * now - math.sqrt(k - 1) * before) / math.sqrt(k)
        return out, sd


def latent_correlation(r: np.ndarray, marginals: list[Marginal]) -> np.ndarray:
    """Correlations of the normals whose scores correlate as ``r`` (NaN counts as 0)."""
    p = len(marginals)
    out = np.eye(p)
    series = [m.hermite() if m.varies else None for m in marginals]
    power = np.arange(1, TERMS + 1)
    for i in range(p):
        for j in range(i):
            if series[i] is None or series[j] is None or not np.isfinite(r[i, j]):
                continue
            (a, sa), (b, sb) = series[i], series[j]
            want, both = r[i, j] * sa * sb, a * b
            if not both[1:].any():          # two continuous columns: the scores are the normals
                rho = want / both[0]
            else:
                lo, hi = -0.9999, 0.9999
                for _ in range(50):
                    rho = (lo + hi) / 2
                    lo, hi = (rho, hi) if (both * rho ** power).sum() < want else (lo, rho)
            out[i, j] = out[j, i] = min(max(rho, -1.0), 1.0)
    return out


def nearest_positive(r: np.ndarray, floor: float = 1e-6) -> np.ndarray:
    """The matrix with its eigenvalues raised to ``floor`` and a unit diagonal again; unchanged if none is below."""
    w, v = np.linalg.eigh((r + r.T) / 2)
    if (w >= floor).all():
        return r
    a = v @ np.diag(np.clip(w, floor, None)) @ v.T
    d = np.sqrt(np.diag(a))
    return a / np.outer(d, d)
