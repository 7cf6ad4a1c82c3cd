"""Tail probabilities for a handful of scalars on the driver (one per tested column)."""

from __future__ import annotations

import math

import numpy as np


def normal_two_sided(z: float) -> float:
    """P(|N| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_upper(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x): the regularised upper incomplete gamma function.

    A series below the mean, a continued fraction above it.
    """
    if df <= 0 or math.isnan(x):
        return math.nan
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


#: Size of the larger sample up to which path counting gives the two-sample p-value; the finite-sample law of one sample is used beyond.
EXACT_KS = 10_000


def ks_two_sample(d: float, n: int, m: int) -> float:
    """Two-sided p-value of a two-sample KS distance.

    Exact path counting up to ``EXACT_KS`` values a side; beyond, Kolmogorov's law for a finite sample of the size n m / (n + m), rounded.
    """
    if max(n, m) <= EXACT_KS:
        return _ks_exact(d, n, m)
    return kolmogorov_upper(d, max(1, round(n / (n + m) * m)))


#: Where n d^2 reaches this, both sides of the band are not left at once but with a share below 10^-10 of the p-value. And the sample size up to which
#: the matrix of the exact law is taken below it (at most 4 sqrt(n) rows); the series behind it is within 10^-8 from there on.
ONE_SIDED, MATRIX = 4.0, 10_000


def kolmogorov_upper(d: float, n: int) -> float:
    """P(D >= d) of the two-sided one-sample distance of ``n`` values, at any n.

    Closed forms at both ends of the range; twice Smirnov's one-sided law in the tail; else Durbin's matrix for n up to ``MATRIX``, and the
    Pelz-Good expansion to the order n^(-3/2) beyond. Exact but for rounding up to n = 10^4, within 10^-8 above.
    """
    if math.isnan(d):
        return math.nan
    if d >= 1:
        return 0.0
    if 2 * n * d <= 1:
        return 1.0
    if n * d <= 1:
        return 1 - math.exp(math.lgamma(n + 1) + n * math.log(2 * d - 1 / n))
    if d >= 1 - 1 / n:
        return 2 * (1 - d) ** n
    if n * d * d >= ONE_SIDED or d >= 0.5:
        return min(1.0, 2 * _smirnov_upper(d, n))
    inside = _durbin(d, n) if n <= MATRIX else float(_pelz_good(d, n))
    return min(1.0, max(0.0, 1 - inside))


def _smirnov_upper(d: float, n: int) -> float:
    """P(D+ >= d): Smirnov's sum, term by term in logarithms; beyond 10^6 values the limit with its first correction."""
    if n > 1_000_000:
        t = 6 * n * d + 1
        return math.exp(-t * t / (18 * n))
    j = np.arange(0, math.floor(n * (1 - d)) + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    k = j.astype(np.int64)
    last = 1 - d - j / n
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = logs[n] - logs[k] - logs[n - k] + (j - 1) * np.log(d + j / n) + np.where(n - k > 0, (n - j) * np.log(np.maximum(last, 0)), 0.0)
    return min(1.0, d * float(np.exp(terms).sum()))


def _durbin(d: float, n: int) -> float:
    """P(D < d): the middle entry of the n-th power of Durbin's matrix, scaled by n! / n^n on the way."""
    k = math.floor(n * d) + 1
    h, size = k - n * d, 2 * k - 1
    rows = np.arange(size)
    matrix = (rows[:, None] - rows[None, :] + 1 >= 0).astype(np.float64)
    ends = 1 - h ** np.arange(1, size + 1)
    matrix[:, 0] = ends
    matrix[-1, :] = ends[::-1]
    matrix[-1, 0] = 1 - 2 * h**size + max(0.0, 2 * h - 1) ** size
    logs = np.array([math.lgamma(x + 1) for x in range(size + 1)])
    steps = rows[:, None] - rows[None, :] + 1
    matrix *= np.where(steps > 0, np.exp(-logs[np.maximum(steps, 0)]), 1.0)
    power, exponent, base, shift, left = np.eye(size), 0, matrix, 0, n
    while left:
        if left & 1:
            power, exponent = power @ base, exponent + shift
            scale = power[k - 1, k - 1]
            if scale > 1e140:
                power, exponent = power * 1e-140, exponent + 140
        base, shift, left = base @ base, 2 * shift, left >> 1
        if base[k - 1, k - 1] > 1e140:
            base, shift = base * 1e-140, shift + 140
    middle = power[k - 1, k - 1]
    if middle <= 0:
        return 0.0
    return math.exp(min(0.0, math.log(middle) + exponent * math.log(10) + math.lgamma(n + 1) - n * math.log(n)))


def _pelz_good(d: float, n: int) -> float:
    """P(D < d) for large n: the limit law and three corrections in powers of n^(-1/2)."""
    z = d * math.sqrt(n)
    odd, whole = np.arange(1, 40, dtype=np.float64) - 0.5, np.arange(1, 40, dtype=np.float64)
    u, v = (math.pi * odd) ** 2, (math.pi * whole) ** 2
    e, f = np.exp(-u / (2 * z * z)), np.exp(-v / (2 * z * z))
    root = math.sqrt(math.pi / 2)
    first = 2 * root / z * e.sum()
    second = 2 * root / (6 * z**4) * ((u - z * z) * e).sum()
    third = 2 * root * (((6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z**2) * u + (1 - 2 * z**2) * u * u) * e).sum() / (72 * z**7) - (v * f).sum() / (36 * z**3))
    poly = (5 - 30 * z**2) * u**3 + (212 * z**4 - 60 * z**2) * u**2 + (135 * z**4 - 96 * z**6) * u - 30 * z**6 - 90 * z**8
    fourth = 2 * root * ((poly * e).sum() / (6480 * z**10) + ((3 * v * z**2 - v * v) * f).sum() / (216 * z**6))
    return first + second / math.sqrt(n) + third / n + fourth / n**1.5


def _ks_exact(d: float, n: int, m: int) -> float:
    """Share of lattice paths from (0, 0) to (n, m) that touch distance d; equal values ignored.

    Walks the diagonals i + j = k; ``inside`` has the probability that the first k draws, without replacement, took i of the
    first sample and never reached d.
    """
    limit = d - 1e-12
    inside = np.ones(1)
    low = 0
    for k in range(1, n + m + 1):
        first, last = max(0, k - m), min(n, k)
        i = np.arange(first, last + 1)
        left = n + m - k + 1  # values not drawn before this step
        now = np.zeros(len(i))
        stay = (i >= low) & (i < low + len(inside))  # the k-th draw was of the second sample
        now[stay] = inside[i[stay] - low] * (m - (k - 1 - i[stay])) / left
        step = (i - 1 >= low) & (i - 1 < low + len(inside))
        now[step] += inside[i[step] - 1 - low] * (n - i[step] + 1) / left
        now[np.abs(i / n - (k - i) / m) >= limit] = 0.0
        inside, low = now, first
    return min(1.0, max(0.0, 1 - float(inside[0])))
