"""Scalar mathematics that Spark has no function for: on plain numbers, for parameters and tables on the driver."""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np


def log_bessel_i(order: float, x: float) -> float:
    """ln I_order(x), the modified Bessel function of the first kind: its power series summed in logarithms."""
    if x == 0:
        return 0.0 if order == 0 else -math.inf
    half = math.log(x / 2)
    logs, k = [], 0
    while True:
        logs.append((2 * k + order) * half - math.lgamma(k + 1) - math.lgamma(k + order + 1))
        if k > x and logs[-1] < max(logs) - 40:
            top = max(logs)
            return top + math.log(math.fsum(math.exp(v - top) for v in logs))
        k += 1


def bessel_i(order: float, x: float) -> float:
    return math.exp(log_bessel_i(order, x)) if x or order else 1.0


def log_vmf_constant(dim: int, kappa: float) -> float:
    """ln of the von Mises-Fisher normaliser kappa^(p/2-1) / ((2 pi)^(p/2) I_(p/2-1)(kappa))."""
    half = dim / 2
    if kappa == 0:
        return math.lgamma(half) - math.log(2) - half * math.log(math.pi)
    return (half - 1) * math.log(kappa) - half * math.log(2 * math.pi) - log_bessel_i(half - 1, kappa)


def vmf_density(dim: int, kappa: float, cosine: float) -> float:
    """von Mises-Fisher density at an angle with this cosine to the mean direction."""
    return math.exp(min(709.0, log_vmf_constant(dim, kappa) + kappa * cosine))


def fit_vmf_kappa(dim: int, mean_cosine: float, highest: int = 500) -> int:
    """The whole kappa of greatest likelihood below `highest`, which depends on the data through the mean cosine alone.

    The likelihood has one maximum, so kappa is doubled until it falls and then halved down between the last two values.
    """

    def rises(k: int) -> bool:
        return log_vmf_constant(dim, k + 1) - log_vmf_constant(dim, k) + mean_cosine > 0

    high = 1
    while high < highest - 1 and rises(high):
        high *= 2
    low, high = 0, min(high, highest - 1)
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if rises(middle) else (low, middle)
    return low


#: Points of a bin at which the density of a cosine is summed.
BIN_POINTS = 64


def cosine_bins(dim: int, bins: int, highest: int) -> np.ndarray:
    """For kappa 0, 1, ... below `highest` the shares of the cosine to the mean direction in `bins` equal bins from -1 to 1.

    A cosine t has density in proportion to exp(kappa t) (1 - t^2)^((dim - 3) / 2), here by the midpoint rule.
    """
    t = -1 + (np.arange(bins * BIN_POINTS) + 0.5) * 2 / (bins * BIN_POINTS)
    logs = np.arange(highest)[:, None] * t[None, :] + (dim - 3) / 2 * np.log1p(-t * t)[None, :]
    weights = np.exp(logs - logs.max(1, keepdims=True)).reshape(highest, bins, BIN_POINTS).sum(2)
    return weights / weights.sum(1, keepdims=True)


#: The least expected count that a bin of a chi-square test is taken to have.
LEAST_EXPECTED = 1e-3


def chi_square(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Chi-square of counts against rows of expected counts."""
    expected = np.maximum(expected, LEAST_EXPECTED)
    return ((seen - expected) ** 2 / expected).sum(-1)


def chi_square_tail(df: int, x: float) -> float:
    """P(chi-square of `df` degrees > x): one minus the incomplete gamma function by its series, or its continued fraction beyond the mean."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        k = 1
        while term > total * 1e-16:
            term *= x / (a + k)
            total += term
            k += 1
        return max(0.0, 1 - math.exp(scale + math.log(total)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 1000):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(scale) * h


def chi_density(df: int, x: float) -> float:
    if x <= 0:
        return 0.0
    return math.exp((1 - df / 2) * math.log(2) + (df - 1) * math.log(x) - x * x / 2 - math.lgamma(df / 2))


def chi_square_density(df: int, x: float) -> float:
    if x <= 0:
        return 0.0
    return math.exp((df / 2 - 1) * math.log(x) - x / 2 - (df / 2) * math.log(2) - math.lgamma(df / 2))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def hypergeometric_tail(population: int, marked: int, drawn: int, hits: int) -> float:
    """P(at least `hits` marked among `drawn` of `population`, `marked` of them marked)."""
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    whole = log_choose(population, drawn)
    low = max(hits, drawn + marked - population, 0)
    return min(1.0, math.fsum(math.exp(log_choose(marked, k) + log_choose(population - marked, drawn - k) - whole) for k in range(low, min(marked, drawn) + 1)))


def interpolate(table: list[tuple[float, float]], x: float) -> float:
    """Linear interpolation in a table sorted by its first column; outside it is an error."""
    xs = [p[0] for p in table]
    if not xs or x < xs[0] or x > xs[-1]:
        raise ValueError(f"{x} is outside the table")
    i = min(bisect_right(xs, x), len(xs) - 1)
    (x0, y0), (x1, y1) = table[i - 1], table[i]
    return y0 + (y1 - y0) * (x - x0) / (x1 - x0)


def interpolate2(xs: list[float], ys: list[float], values: list[list[float]], x: float, y: float) -> float:
    """Bilinear interpolation in a grid values[i][j] at (xs[i], ys[j])."""
    rows = [(yj, interpolate(list(zip(xs, [r[j] for r in values], strict=True)), x)) for j, yj in enumerate(ys)]
    return interpolate(rows, y)
