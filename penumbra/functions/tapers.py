"""Frequencies of a discrete spectrum and the weights of its cells, as column expressions.

A cell is given by its row ``i`` and column ``j`` in a spectrum of ``rows`` x
``columns`` cells. Weights have the zero frequency in the corner, as a discrete
Fourier transform leaves it, unless ``shift`` is false.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series of the modified Bessel function; enough for arguments up to about 40.
_TERMS = 60
#: Length of an axis by system (fixed values).
EXTENTS = {"normalized": 1.0, "unit": 2.0, "radians": 2 * math.pi}


def turned(k: Column, size: int) -> Column:
    """The place of cell ``k`` before an axis is turned by half its size."""
    return F.pmod(k - size // 2, F.lit(size))


def fourier_grid(i: Column, j: Column, rows: int, columns: int, system: str = "normalized", shift: bool = True) -> tuple[Column, Column]:
    """(x, y) frequencies of a cell, x to the right and y upwards; axes of one cell have frequency 0."""

    def axis(k: Column, size: int) -> Column:
        stretch = size / (size - 1) if size > 1 else 1.0
        return (k * stretch - size // 2) * (EXTENTS[system] / size)

    if shift:
        i, j = turned(i, rows), turned(j, columns)
    return axis(j, columns), axis(rows - 1 - i, rows)


def _radius(i: Column, j: Column, rows: int, columns: int, shift: bool = True) -> Column:
    return F.hypot(*fourier_grid(i, j, rows, columns, shift=shift))


def _flag(inside: Column) -> Column:
    return inside.cast("double")


def raised_cosine(i: Column, j: Column, rows: int, columns: int, beta: float = 0.35) -> Column:
    """1 up to a radius, from there to 0.5 a squared cosine, 0 beyond; ``beta`` is the width of the slope."""
    r = _radius(i, j, rows, columns)
    slope = F.pow(F.cos((r - (0.5 - beta)) * (math.pi / (2 * beta))), F.lit(2.0))
    return F.when(r < 0.5 - beta, F.lit(1.0)).when(r <= 0.5, slope).otherwise(F.lit(0.0))


def cosine_bell(i: Column, j: Column, rows: int, columns: int) -> Column:
    r = _radius(i, j, rows, columns)
    return F.when(r <= 0.5, 0.5 * F.cos(2 * math.pi * r) + 0.5).otherwise(F.lit(0.0))


def low_pass_rectangle(i: Column, j: Column, rows: int, columns: int, r: float = 0.5) -> Column:
    x, y = fourier_grid(i, j, rows, columns)
    return _flag((F.abs(x) <= r) & (F.abs(y) <= r))


def low_pass_circle(i: Column, j: Column, rows: int, columns: int, r: float = 0.5) -> Column:
    """1 within a radius of the middle: the zero frequency is in the middle here."""
    return _flag(_radius(i, j, rows, columns, shift=False) <= r)


def low_pass_ellipse(i: Column, j: Column, rows: int, columns: int, r_x: float = 0.5, r_y: float = 0.5) -> Column:
    x, y = fourier_grid(i, j, rows, columns)
    return _flag(F.hypot(x * (r_x / r_y), y) <= r_x)


def high_pass_circle(i: Column, j: Column, rows: int, columns: int, r: float = 0.5) -> Column:
    return _flag(_radius(i, j, rows, columns) >= r)


def _outer(i: Column, j: Column, rows: int, columns: int, along) -> Column:
    """Geometric mean of the weights along both axes."""
    return F.sqrt(F.greatest(along(turned(i, rows), rows) * along(turned(j, columns), columns), F.lit(0.0)))


def _cosines(*terms: float):
    """The weight along an axis that is a sum of cosines of whole periods."""

    def along(k: Column, size: int) -> Column:
        if size == 1:
            return F.lit(1.0)
        return sum((a * F.cos(k * (2 * math.pi * p / (size - 1))) for p, a in enumerate(terms[1:], 1)), F.lit(terms[0]))

    return along


def hanning_window(i: Column, j: Column, rows: int, columns: int) -> Column:
    return _outer(i, j, rows, columns, _cosines(0.5, -0.5))


def hamming_window(i: Column, j: Column, rows: int, columns: int) -> Column:
    return _outer(i, j, rows, columns, _cosines(0.54, -0.46))


def blackman_window(i: Column, j: Column, rows: int, columns: int) -> Column:
    return _outer(i, j, rows, columns, _cosines(0.42, -0.5, 0.08))


def bessel_i0(x: Column) -> Column:
    """The modified Bessel function of order zero, by its power series."""
    quarter = x * x / 4
    falling = F.array(*(F.lit(float(k * k)) for k in range(_TERMS, 0, -1)))
    return F.aggregate(falling, F.lit(1.0), lambda rest, square: 1 + rest * quarter / square)


def kaiser_window(i: Column, j: Column, rows: int, columns: int, beta: float = 14.0) -> Column:
    def along(k: Column, size: int) -> Column:
        if size == 1:
            return F.lit(1.0)
        out = k * (2 / (size - 1)) - 1
        return bessel_i0(beta * F.sqrt(F.greatest(1 - out * out, F.lit(0.0)))) / bessel_i0(F.lit(float(beta)))

    return _outer(i, j, rows, columns, along)
