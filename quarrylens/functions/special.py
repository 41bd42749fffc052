"""Tail probabilities of the test statistics: numbers on the driver, without a statistics library."""

from __future__ import annotations

import math


def _gamma_tail(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def _beta_part(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_p(statistic: float | None, degrees: int) -> float | None:
    return None if statistic is None or degrees < 1 else _gamma_tail(degrees / 2, statistic / 2)


def t_p(t: float | None, degrees: float | None) -> float | None:
    """Two-sided."""
    if t is None or degrees is None or degrees <= 0:
        return None
    return _beta_part(degrees / 2, 0.5, degrees / (degrees + t * t))


def _exact_u_counts(n1: int, n2: int) -> list[int]:
    """In how many orders of n1 and n2 values each U comes out."""
    table = [[[1] for _ in range(n2 + 1)] for _ in range(n1 + 1)]
    for i in range(1, n1 + 1):
        for j in range(1, n2 + 1):
            out = [0] * (i * j + 1)
            for u, k in enumerate(table[i - 1][j]):
                out[u + j] += k
            for u, k in enumerate(table[i][j - 1]):
                out[u] += k
            table[i][j] = out
    return table[n1][n2]


def mann_whitney_p(u: float | None, n1: int, n0: int, tie_sum: float) -> float | None:
    """Two-sided. Exact for a class of 8 rows or fewer without ties (and fewer than 200 in the other), else the normal
    approximation with the ties' correction and half a step."""
    if u is None or not n1 or not n0:
        return None
    if min(n1, n0) <= 8 and max(n1, n0) < 200 and tie_sum == 0:
        counts = _exact_u_counts(min(n1, n0), max(n1, n0))
        top = max(u, n1 * n0 - u)
        return min(1.0, 2 * sum(counts[int(math.ceil(top)) :]) / sum(counts))
    n = n1 + n0
    spread = math.sqrt(n1 * n0 / 12 * (n + 1 - tie_sum / (n * (n - 1)))) if n > 1 else 0.0
    if not spread:
        return 1.0
    z = (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2)))
