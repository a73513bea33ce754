"""Tails of the F, t and studentized-range laws for small result tables."""

from __future__ import annotations

import math

import numpy as np

NODES_64 = np.polynomial.legendre.leggauss(64)
NODES_96 = np.polynomial.legendre.leggauss(96)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b), by Gauss-Legendre quadrature of the tail.

    With x = sin(u)^2 the integrand is smooth, and the pieces follow its peak.
    """
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    top = math.asin(math.sqrt(x))
    log_scale = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + math.log(2)
    nodes, weights = NODES_64
    # Halving intervals towards both ends keep precision for sharp peaks and tiny tails.
    cuts = np.concatenate([[0.0], top * 0.5 ** np.arange(24, 0, -1), top * (1 - 0.5 ** np.arange(2, 25)), [top]])
    cuts = np.unique(cuts)
    half = (cuts[1:] - cuts[:-1])[:, None] / 2
    u = (cuts[1:] + cuts[:-1])[:, None] / 2 + half * nodes
    with np.errstate(divide="ignore"):
        log_f = log_scale + (2 * a - 1) * np.log(np.sin(u)) + (2 * b - 1) * np.log(np.cos(u))
    return float(np.sum(half * weights * np.exp(log_f)))


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f is None or df2 is None or math.isnan(f) or df2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return _beta_tail(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def t_tail(t: float, df: float) -> float:
    """P(T > t) for t >= 0."""
    if t is None or df is None or math.isnan(t) or df <= 0:
        return float("nan")
    return 0.5 * f_tail(t * t, 1, df) if t > 0 else 0.5


def t_quantile(p: float, df: float) -> float:
    """Value with P(T > value) = p for p < 1/2, by bisection."""
    low, high = 0.0, 2.0
    while t_tail(high, df) > p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if t_tail(mid, df) > p else (low, mid)
    return (low + high) / 2


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def range_table(k: int) -> tuple[np.ndarray, np.ndarray]:
    """A grid of w and P(range of k normals <= w) on it."""
    w = np.linspace(0, 14, 4201)
    nodes, weights = NODES_96
    z = nodes * 9.0
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    spread = _normal_cdf(z[None, :] + w[:, None]) - _normal_cdf(z)[None, :]
    inner = density[None, :] * np.power(np.clip(spread, 0, 1), k - 1)
    return w, np.clip(k * 9.0 * inner @ weights, 0, 1)


def studentized_range_tail(q: float, table: tuple[np.ndarray, np.ndarray], df: float) -> float:
    """P(Q > q) for df degrees of freedom and the range table of the number of means."""
    if q is None or math.isnan(q):
        return float("nan")
    if q <= 0:
        return 1.0
    w, cdf = table
    nodes, weights = NODES_96
    # s is chi / sqrt(df): integrate over where it has any weight.
    reach = 10 / math.sqrt(2 * df)
    low, high = max(1e-9, 1 - reach), 1 + reach
    s = (high + low) / 2 + (high - low) / 2 * nodes
    log_density = (
        math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    )
    above = 1 - np.interp(q * s, w, cdf, right=1.0)
    return float(np.sum((high - low) / 2 * weights * np.exp(log_density) * above))
