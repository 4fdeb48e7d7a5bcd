"""Special functions as columns, near to double precision: error function, log gamma ratio, incomplete beta, Student's t."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and continued fractions (of the beta function at most); freedoms beyond which Student's t is a corrected normal.
SERIES, FRACTION, BETA_FRACTION, LARGE = 70, 60, 500, 20_000
#: Newton steps of the quantile; from the normal quantile they only climb.
STEPS = 40

# Numerators and denominators of Stirling's series B(2k) / (2k (2k - 1)).
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188))


def erfc(x: Column) -> Column:
    """Complementary error function: series of positive terms below 2.5, continued fraction from there on."""
    z = F.abs(x)
    near = F.least(z, F.lit(2.5))  # either branch is only evaluated where it converges
    # erf(z) = 2 z exp(-z^2) / sqrt(pi) * sum of (2 z^2)^n / (1 * 3 * 5 ... (2n + 1)), summed from the inside
    nest = F.aggregate(F.sequence(F.lit(SERIES), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, n: 1 + v * (2 * near * near) / (2 * n + 1))
    small = 1 - 2 / math.sqrt(math.pi) * near * F.exp(-near * near) * nest
    far = F.greatest(z, F.lit(2.5))
    tail = F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1), F.lit(-1)), far, lambda v, n: far + n / (2 * v))
    large = F.exp(-far * far) / (math.sqrt(math.pi) * tail)
    upper = F.when(z < 2.5, small).otherwise(large)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x >= 0, upper).otherwise(2 - upper)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal score."""
    return erfc(F.abs(z) / math.sqrt(2.0))


def chi2_p(x: Column) -> Column:
    """p-value of a chi-square score with one degree of freedom."""
    return erfc(F.sqrt(x / 2))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number: Stirling's series ten places up."""
    y = x + 10
    series = sum((F.lit(a / b) / F.pow(y, F.lit(2 * k + 1.0)) for k, (a, b) in enumerate(_STIRLING)), F.lit(0.0))
    up = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(1.0), lambda v, i: v * (x + i))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(up)


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column | None = None) -> Column:
    """Regularised incomplete beta function I_x(a, b), for a and b up to about LARGE.

    ``rest`` is 1 - x where that is known more exactly. The continued fraction is folded from its far end, on the side where it
    converges fast.
    """
    rest = 1 - x if rest is None else rest

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def term(i: Column) -> Column:
            m = F.floor(i / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(i % 2 == 0, even).otherwise(odd)

        # terms needed grow with the root of the larger parameter
        last = F.least(F.lit(BETA_FRACTION), 40 + F.ceil(5 * F.sqrt(F.greatest(a, b))).cast("int"))
        return 1 / F.aggregate(F.sequence(last, F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, i: 1 + term(i) / v)

    front = F.exp(a * F.log(x) + b * F.log(rest) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    value = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, rest) / b)
    return F.when((x > 0) & (rest > 0), value).when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0))


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p-value of Student's t; null for a null score or no freedom."""
    n, square = freedom.cast("double"), t * t
    few = F.least(n, F.lit(float(LARGE)))
    exact = incomplete_beta(few / 2, F.lit(0.5), few / (few + square), square / (few + square))
    close = normal_p((8 * n + 1) / (8 * n + 3) * F.sqrt(n * F.log1p(square / n)))
    return F.when(t.isNull() | (n <= 0), F.lit(None).cast("double")).when(n <= LARGE, exact).otherwise(close)


def student_quantile(level: float, freedom: Column) -> Column:
    """The score that |t| stays below with probability ``level``: Newton steps from the normal quantile.

    Above zero the tail is convex, so steps from below never pass the root. Null without freedom.
    """
    from statistics import NormalDist

    n = freedom.cast("double")
    few = F.least(n, F.lit(float(LARGE)))
    log_scale = log_gamma((few + 1) / 2) - log_gamma(few / 2) - 0.5 * F.log(few * math.pi)

    def step(t: Column) -> Column:
        density = F.exp(log_scale - (few + 1) / 2 * F.log1p(t * t / few))
        return t + (student_p(t, few) - (1 - level)) / (2 * density)

    start = F.lit(NormalDist().inv_cdf((1 + level) / 2))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda t, _: step(t))
    # beyond LARGE the first terms of the expansion around the normal quantile are exact to 1e-12
    z = start
    more = z + (z * z * z + z) / (4 * n) + (5 * F.pow(z, F.lit(5)) + 16 * z * z * z + 3 * z) / (96 * n * n)
    return F.when(n <= 0, F.lit(None).cast("double")).when(n <= LARGE, exact).when(n > LARGE, more)
