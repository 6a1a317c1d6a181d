"""Special functions as column expressions: logarithm of gamma, incomplete gamma, error function."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' approximation for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TERMS = 200  # of a series or a continued fraction; enough for shapes up to some 1,000


def log_gamma(z: Column) -> Column:
    """For z > 0."""
    x = z - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def gamma_p(s: Column, z: Column) -> Column:
    """The lower incomplete gamma function over the whole one, for s > 0 and z >= 0."""
    return F.when(z <= 0, 0.0).when(z < s + 1, _series(s, z)).otherwise(1 - _fraction(s, z))


def gamma_q(s: Column, z: Column) -> Column:
    """The upper one: 1 - gamma_p(), exact also where that is near 1."""
    return F.when(z <= 0, 1.0).when(z < s + 1, 1 - _series(s, z)).otherwise(_fraction(s, z))


def _scale(s: Column, z: Column) -> Column:
    return F.exp(s * F.ln(z) - z - log_gamma(s))


def _series(s: Column, z: Column) -> Column:
    """The sum of z^k / (s (s+1) ... (s+k)), times the common factor."""
    start = F.struct((1 / s).cast("double").alias("term"), (1 / s).cast("double").alias("sum"))

    def step(a, k):
        term = a["term"] * z / (s + k)
        return F.struct(term.cast("double").alias("term"), (a["sum"] + term).cast("double").alias("sum"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["sum"]) * _scale(s, z)


def _fraction(s: Column, z: Column) -> Column:
    """1 / (z + 1 - s - 1 (1 - s) / (z + 3 - s - 2 (2 - s) / ...)), from its end, times the common factor."""
    inner = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(0.0), lambda a, k: (k * (k - s) / (z + 2 * k + 1 - s - a)).cast("double"))
    return _scale(s, z) / (z + 1 - s - inner)


def erfc(x: Column) -> Column:
    """2 / sqrt(pi) times the integral of exp(-t^2) from x on."""
    q = gamma_q(F.lit(0.5), x * x)
    return F.when(x >= 0, q).otherwise(2 - q)
