"""Growth curves, weights of transformed observations and intensity curves, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def four_parameter(x: Column, low: float, steepness: float, middle: float, high: float) -> Column:
    """The logistic curve of four parameters."""
    return five_parameter(x, low, steepness, middle, high, 1.0)


def five_parameter(x: Column, low: float, steepness: float, middle: float, high: float, asymmetry: float) -> Column:
    """The logistic curve of four parameters with an exponent for its asymmetry."""
    return F.lit(high) + F.try_divide(F.lit(low - high), F.pow(1 + F.pow(x / middle, F.lit(steepness)), F.lit(asymmetry)))


def gompertz(x: Column, a: float, b: float) -> Column:
    return F.exp(-a * F.exp(-b * x))


def sigmoid(x: Column, a: float = 10.0, b: float = 0.5) -> Column:
    """An S-curve that enhances high and low intensities."""
    return 1 / (1 + F.exp(-a * (x - b)))


def logit(y: Column) -> Column:
    """Decimal log odds; null outside 0 to 1."""
    return F.log10(F.try_divide(y, 1 - y))


def logit_weight(y: Column, variance: Column | float = 1.0, unit: float = 1.0) -> Column:
    """Weight of an observation that was transformed by ``logit``."""
    return y * y * (1 - y) * (1 - y) * (F.lit(variance) / unit)


def log_weight(y: Column, variance: Column | float = 1.0, unit: float = 1.0) -> Column:
    return y * y * (F.lit(variance) / unit)


def reciprocal_weight(y: Column, variance: Column | float = 1.0, unit: float = 1.0) -> Column:
    return F.pow(y, F.lit(4.0)) * (F.lit(variance) / unit)


def exponential_weight(y: Column, variance: Column | float = 1.0, unit: float = 1.0) -> Column:
    return F.try_divide(F.lit(float(unit)), F.exp(2 * y) * F.lit(variance))


def square_weight(y: Column, variance: Column | float = 1.0, unit: float = 1.0) -> Column:
    """Null where ``y`` is zero."""
    return F.try_divide(F.lit(float(unit) ** 2), 4 * y * y * F.lit(variance))


def gamma(value: Column, exponent: float = 1.0) -> Column:
    """The power of an intensity from 0 to 1."""
    return F.pow(value, F.lit(exponent))


def arctangent(value: Column) -> Column:
    return F.atan(value)


def point_error(variance_x: Column, variance_y: Column) -> Column:
    """Size of the error of a point from the errors along both axes."""
    return F.hypot(variance_x, variance_y)


def mean_axis(variance_x: Column, variance_y: Column) -> Column:
    """Fourth root of the product of both variances; 0 if the product is not positive."""
    product = variance_x * variance_y
    return F.when(product > 0, F.pow(product, F.lit(0.25))).otherwise(F.lit(0.0))
