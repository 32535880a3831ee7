"""Column helpers with the arithmetic of IEEE doubles, where ANSI SQL would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1.7976931348623157e308


def nan_to_num(x: Column, fill: float = 0.0) -> Column:
    """NaN becomes `fill`, infinities the largest doubles; null stays null."""
    return F.when(F.isnan(x), F.lit(fill)).when(x == float("inf"), F.lit(LARGEST)).when(x == float("-inf"), F.lit(-LARGEST)).otherwise(x)


def divide(a: Column, b: Column) -> Column:
    """a / b with 0/0 = NaN and x/0 = signed infinity."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def ln(x: Column) -> Column:
    """Natural logarithm with ln 0 = -infinity and NaN below."""
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


def nan_mean(x: Column) -> Column:
    """Mean of what is neither null nor NaN; 0 if nothing is."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(0.0))


def geometric_mean(x: Column) -> Column:
    """exp of the mean logarithm; 0 if any value is 0."""
    return F.exp(F.avg(ln(x)))


def l1_norm(x: Column) -> Column:
    return F.sum(F.abs(x))


def l2_norm(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))
