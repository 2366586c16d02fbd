"""The regularised incomplete gamma function as column expressions.

Below a + 1 the lower tail's power series converges fast, above it the continued fraction
of the upper tail; both are folded over a sequence whose length follows the square
root of a, which is how the number of terms grows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Coefficients of Lanczos' approximation of the gamma function for g = 7.
_LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
_TINY = 1e-300


def log_gamma(a: Column) -> Column:
    """Logarithm of the gamma function for a > 0."""
    z = a - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def _steps(a: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(60) + 12 * F.sqrt(a)).cast("int"))


def _lower_series(a: Column, x: Column) -> Column:
    """Sum of x^n / ((a + 1) ... (a + n)) from n = 0."""
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(state: Column, n: Column) -> Column:
        term = state["term"] * x / (a + n)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    return F.aggregate(_steps(a), start, add, lambda state: state["sum"])


def _upper_fraction(a: Column, x: Column) -> Column:
    """The continued fraction of the upper tail, from the front by the rule of Lentz."""
    away = lambda c: F.when(F.abs(c) < _TINY, F.lit(_TINY)).otherwise(c)
    first = F.lit(1.0) / away(x + 1 - a)
    start = F.struct(F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h"))

    def add(state: Column, n: Column) -> Column:
        top = -n * (n - a)
        below = x + 2 * n + 1 - a
        d = F.lit(1.0) / away(top * state["d"] + below)
        c = away(below + top / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

    return F.aggregate(_steps(a), start, add, lambda state: state["h"])


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x) for a > 0; 1 at and below x = 0, null for null."""
    a, x = a.cast("double"), x.cast("double")
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    low = 1 - scale / a * _lower_series(a, x)
    high = scale * _upper_fraction(a, x)
    return F.when(x <= 0, 1.0).when(x.isNull() | a.isNull(), F.lit(None)).when(x < a + 1, low).otherwise(high)
