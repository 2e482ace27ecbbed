"""Statistics Spark has no built-in for, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL without spread.

    The built-in divides by zero, an error in ANSI mode, when one side is constant.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def ln_gamma(x: Column) -> Column:
    """Log of the gamma function for x > 0, by Stirling's series shifted eight steps up."""
    z = x + F.lit(8.0)
    inverse = F.lit(1.0) / z
    square = inverse * inverse
    # Stirling series coefficients B(2n) / (2n (2n - 1)).
    series = inverse * (
        1 / 12 + square * (-1 / 360 + square * (1 / 1260 + square * (-1 / 1680 + square / 1188)))
    )
    high = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    product = x
    for step in range(1, 8):
        product = product * (x + F.lit(float(step)))
    return high - F.log(product)


def student_t_two_sided(theta: Column, dof: Column) -> Column:
    """Two-sided p-value for an integer number of degrees of freedom, from atan(|t| / sqrt(dof)).

    The finite trigonometric series of Abramowitz & Stegun 26.7.3 and 26.7.4: each term is the one
    before times a ratio and cos^2, so it folds over a short sequence inside the JVM. ``theta``
    should be a plain column, as it appears in the expression several times.
    """
    odd = dof % 2 == 1
    offset = F.when(odd, 0).otherwise(1)
    # Odd: terms cos * 1, 2/3, 2*4/(3*5), ...; even: terms 1, 1/2, 1*3/(2*4), ...
    start = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    last = F.floor(dof / 2).cast("int") - 1

    def grow(acc: Column, i: Column) -> Column:
        ratio = (2 * i - offset) / (2 * i + 1 - offset)
        term = acc["term"] * ratio * F.pow(F.cos(theta), F.lit(2.0))
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    summed = F.aggregate(
        steps, F.struct(start.alias("sum"), start.alias("term")), grow, lambda acc: acc["sum"]
    )
    total = F.when(dof > 1, summed).otherwise(0.0)
    inside = F.when(odd, (theta + F.sin(theta) * total) * (2 / math.pi)).otherwise(
        F.sin(theta) * total
    )
    return F.greatest(F.lit(0.0), 1 - inside)
