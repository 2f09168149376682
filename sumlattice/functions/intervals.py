"""Exact binomial intervals for whole arrays, and normal quantiles, without SciPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

#: Both parameters above this: the beta density is near a bell and is integrated; else its continued fraction is short.
LARGE = 400.0
#: Quantiles worked out at a time, each with the nodes of its integral.
BLOCK = 8192
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(32)


def stirling_error(z: np.ndarray) -> np.ndarray:
    """ln(Gamma(z)) less Stirling's (z - 1/2) ln z - z + ln(2 pi) / 2, for z of 1 or more."""
    out, z = np.zeros_like(z), z.copy()
    while (low := z < 16).any():  # from the next number's error
        out[low] += (z[low] + 0.5) * np.log1p(1 / z[low]) - 1
        z[low] += 1
    s = 1 / (z * z)
    return out + (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / z


def log1p_rest(u: np.ndarray) -> np.ndarray:
    """ln(1 + u) - u, also where the two are nearly equal."""
    with np.errstate(divide="ignore"):
        out = np.log1p(u) - u
    near = np.abs(u) < 0.05
    v, term = u[near], -u[near] ** 2
    total = term / 2
    for k in range(3, 15):
        term = -term * v
        total += term / k
    out[near] = total
    return out


def log_density(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln of x^a (1 - x)^b / B(a, b), without the cancellation of large log-gammas."""
    n = a + b
    mean = a / n
    d = x - mean
    divergence = mean * log1p_rest(d / mean) + b / n * log1p_rest(-d / (b / n))
    return 0.5 * np.log(a * b / (2 * math.pi * n)) + n * divergence + stirling_error(n) - stirling_error(a) - stirling_error(b)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, for x up to about the mean."""
    tiny = 1e-300
    clear = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones_like(x), 1 / clear(1 - (a + b) * x / (a + 1))
    h, going = d.copy(), np.arange(len(x))
    for m in range(1, 10_000):
        aa, bb, xx, cc, dd = a[going], b[going], x[going], c[going], d[going]
        for step in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)), -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            dd = 1 / clear(1 + step * dd)
            cc = clear(1 + step / cc)
            h[going] *= cc * dd
        c[going], d[going] = cc, dd
        going = going[np.abs(cc * dd - 1) > 1e-15]
        if not len(going):
            break
    return h


def _integral(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The chance below x, for x below the mean, by Gauss-Legendre nodes over all that matters of the tail."""
    mean, sd = a / (a + b), np.sqrt(a * b / (a + b)) / (a + b)
    low = np.maximum(0.0, np.minimum(mean - 12 * sd, x - 6 * sd))
    out = np.zeros_like(x)
    for start, stop in ((low, (low + x) / 2), ((low + x) / 2, x)):
        half = (stop - start) / 2
        at = start[:, None] + half[:, None] * (1 + _NODES)
        at = np.maximum(at, 1e-300)
        shape = np.broadcast_to(a[:, None], at.shape), np.broadcast_to(b[:, None], at.shape)
        value = np.exp(log_density(shape[0].ravel(), shape[1].ravel(), at.ravel()).reshape(at.shape)) / (at * (1 - at))
        out += half * (value @ _WEIGHTS)
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of arrays, for parameters of 1 or more."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x >= 1, 1.0, 0.0)
    turned = x > (a + 1) / (a + b + 2)
    a, b, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inner = (x > 0) & (x < 1)
    large = inner & (a > LARGE) & (b > LARGE) & (y < a / (a + b))
    small = inner & ~large
    for on, f in ((large, lambda a, b, y: _integral(a, b, y)), (small, lambda a, b, y: np.exp(log_density(a, b, y)) / a * _fraction(a, b, y))):
        if on.any():
            v = f(a[on], b[on], y[on])
            out[on] = np.where(turned[on], 1 - v, v)
    return out


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values below which beta variables lie with chance ``p``: Newton's steps for all at once, halving where one leaves its bracket."""
    a, b = (np.array(v, float) for v in np.broadcast_arrays(a, b))
    low, high = np.zeros_like(a), np.ones_like(a)
    mean, sd = a / (a + b), np.sqrt(a * b / (a + b + 1)) / (a + b)
    x = np.clip(mean + normal_quantile(p) * sd, mean / 20, 1 - (1 - mean) / 20)
    going = np.arange(len(a))
    for _ in range(200):
        aa, bb, xx = a[going], b[going], x[going]
        over = incomplete_beta(aa, bb, xx) - p
        low[going], high[going] = np.where(over < 0, xx, low[going]), np.where(over < 0, high[going], xx)
        with np.errstate(divide="ignore", over="ignore", under="ignore", invalid="ignore"):
            step = over * xx * (1 - xx) / np.exp(log_density(aa, bb, xx))
        new = xx - step
        inside = (new >= low[going]) & (new <= high[going])
        settled = np.abs(step) <= 4e-16 * xx  # no step that rounding allows is left
        x[going] = np.where(inside | settled, new, (low[going] + high[going]) / 2)
        going = going[~settled & (high[going] - low[going] > 4e-16 * high[going])]
        if not len(going):
            break
    return x


def clopper_pearson(k: np.ndarray, n: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact intervals of shares of ``k`` in ``n``; NaN for counts that make no sense."""
    k, n = (np.array(v, float) for v in np.broadcast_arrays(k, n))
    low, high = np.full(k.shape, np.nan), np.full(k.shape, np.nan)
    with np.errstate(invalid="ignore"):
        good = (n > 0) & (k >= 0) & (k <= n)
    low[good & (k == 0)], high[good & (k == n)] = 0.0, 1.0
    tail = (1 - level) / 2
    for out, on, p, up in ((low, good & (k > 0), tail, 0), (high, good & (k < n), 1 - tail, 1)):
        at = np.flatnonzero(on)
        for lo in range(0, len(at), BLOCK):
            i = at[lo : lo + BLOCK]
            out[i] = beta_quantile(p, k[i] + up, n[i] - k[i] + 1 - up)
    return low, high


def check_level(level: object) -> float:
    if isinstance(level, bool) or not isinstance(level, (int, float)) or not 0 < level < 1:
        raise ValueError("conf_level must lie between 0 and 1")
    return float(level)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
