"""Tail probabilities of test statistics: O(1) scalar work on the driver,
after the data have been reduced to a handful of sums."""

from __future__ import annotations

import math
from collections import Counter
from functools import cache
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _fraction(term, first: float, tiny: float = 1e-300) -> float:
    """Evaluate a continued fraction by the modified Lentz method."""
    value = first or tiny
    upper, lower = value, 0.0
    for k in range(1, 1000):
        a, b = term(k)
        lower = 1.0 / ((b + a * lower) or tiny)
        upper = (b + a / upper) or tiny
        step = upper * lower
        value *= step
        if abs(step - 1.0) < 1e-16:
            break
    return value


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_fraction(b, a, 1.0 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a

    def term(k: int) -> tuple[float, float]:
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return scale / _fraction(term, 1.0)


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1.0:
        piece = total = 1.0 / s
        k = s
        while abs(piece) > abs(total) * 1e-17:
            k += 1.0
            piece *= x / k
            total += piece
        return 1.0 - total * scale
    return scale / _fraction(lambda k: (-k * (k - s), x + 2 * k + 1 - s), x + 1.0 - s)


def student_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_fraction(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def kolmogorov_upper(d: float, n: int) -> float:
    """Limit distribution of the one-sample Kolmogorov statistic, with
    Stephens' small-sample correction of the argument."""
    root = math.sqrt(n)
    x = (root + 0.12 + 0.11 / root) * d
    if x < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


# groups of at most this size have exact rank-sum counts in constant space
SMALL_GROUP = 8


@cache
def _bounded_partitions(parts: int) -> tuple[int, list[int]]:
    """The period L and the numerator N of 1 / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^parts)) = N / (1 - q^L)^(parts + 1)."""
    period = math.lcm(*range(1, parts + 1))
    out = [0] * ((parts + 1) * period)
    out[0] = 1
    for step in (1, *range(1, parts + 1)):
        for j in range(step, len(out)):
            out[j] += out[j - step]
        for j in range(len(out) - 1, period - 1, -1):
            out[j] -= out[j - period]
    return period, out


def _partitions_up_to(t: int, parts: int) -> int:
    """How many partitions into at most ``parts`` parts the numbers 0 to ``t`` have together."""
    period, numerator = _bounded_partitions(parts)
    return sum(numerator[j] * math.comb((t - j) // period + parts, parts)
               for j in range(t % period, min(t, len(numerator) - 1) + 1, period))


def rank_sum_tail(t: int, n1: int, n2: int) -> int:
    """How many of the C(n1 + n2, n1) ways to rank two groups give Mann and Whitney's U of at most ``t``.

    Their counts are the coefficients of the product over i of
    (1 - q^(n + i)) / (1 - q^i), i up to the smaller size m.  The numerator has
    2^m terms; behind it stand partitions into at most m parts, a quasi-polynomial.
    """
    m, n = sorted((n1, n2))
    if m > SMALL_GROUP:
        raise ValueError(f"one group must have at most {SMALL_GROUP} values")
    terms = Counter({0: 1})
    for i in range(1, m + 1):
        further = Counter({at + n + i: -k for at, k in terms.items() if at + n + i <= t})
        for at, k in further.items():
            terms[at] += k
    return sum(k * _partitions_up_to(t - at, m) for at, k in terms.items() if at <= t) if t >= 0 else 0
