"""Probability functions: native column expressions for rows, plain floats for test statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from raretide.functions.scalars import _col

# Stirling series of ln Gamma, and the coefficients of P. J. Acklam's rational approximation of
# the inverse normal distribution function (numerator and denominator, centre and tail).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
SHIFT = 8
CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
              -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
              -1.328068155288572e01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
            4.374664141464968e00, 2.938163982698783e00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def ln_gamma(c: Column | str) -> Column:
    """ln Gamma(x) for x > 0: the argument is moved up by 8 and the Stirling series is used."""
    x = _col(c).cast("double")
    product = x
    for i in range(1, SHIFT):
        product = product * (x + i)
    z = x + SHIFT
    series, power = F.lit(0.0), 1 / z
    for coefficient in STIRLING:
        series = series + coefficient * power
        power = power / (z * z)
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def ln_poisson(y: Column, mu: Column) -> Column:
    return y * F.ln(mu) - mu - ln_gamma(y + 1)


def ln_negative_binomial(y: Column, mu: Column, alpha: float) -> Column:
    """NB2: variance mu + alpha mu²."""
    r = 1.0 / alpha
    gammas = ln_gamma(y + r) - math.lgamma(r) - ln_gamma(y + 1)
    return gammas - r * F.log1p(alpha * mu) + y * (F.ln(alpha * mu) - F.log1p(alpha * mu))


def ln_zero_inflated(y: Column, ln_count: Column, pi: Column) -> Column:
    at_zero = F.ln(pi + (1 - pi) * F.exp(ln_count))
    return F.when(y == 0, at_zero).otherwise(F.log1p(-pi) + ln_count)


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def normal_cdf(c: Column) -> Column:
    """Standard normal distribution function of a column; see :func:`erfc_column` for its accuracy."""
    return erfc_column(-c / math.sqrt(2)) / 2


# Chebyshev fit of erfc, fractional error below 1.2e-7 (Numerical Recipes, section 6.2).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def erfc_column(c: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(c))
    poly = F.lit(ERFC[-1])
    for a in reversed(ERFC[:-1]):
        poly = poly * t + a
    value = t * F.exp(-c * c + poly)
    return F.when(c >= 0, value).otherwise(2 - value)


def _horner(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(c: Column | str) -> Column:
    """Inverse of the standard normal distribution function, relative error below 1.2e-9."""
    p = _col(c)
    q = p - 0.5
    centre = q * _horner(CENTRE_NUM, q * q) / _horner(CENTRE_DEN, q * q)

    def tail(t: Column) -> Column:
        s = F.sqrt(-2 * F.ln(t))
        return _horner(TAIL_NUM, s) / _horner(TAIL_DEN, s)

    return F.when(p < TAIL, tail(p)).when(p > 1 - TAIL, -tail(1 - p)).otherwise(centre)


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square > x) for whole degrees of freedom, by the recurrence in steps of two."""
    if x <= 0:
        return 1.0
    if df % 2:
        tail, term, k = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        tail, term, k = math.exp(-x / 2), x / 2 * math.exp(-x / 2), 2
    while k < df:
        tail += term
        k += 2
        term *= x / k
    return min(1.0, tail)


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b), by the continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail(x: float, d1: float, d2: float) -> float:
    return beta_tail(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)
