"""Places of a peak between cells, from the scores before, at and after the highest cell of an axis, as column expressions.

Places are relative to the highest cell, in cells. Where a form has no value
(flat scores, logarithms of scores that are not positive) it is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parabolic(before: Column, top: Column, after: Column) -> Column:
    """Vertex of the parabola through the three scores."""
    return F.try_divide(after - before, 2 * (2 * top - before - after))


def gaussian(before: Column, top: Column, after: Column) -> Column:
    """Middle of the bell curve through the three scores."""
    positive = (before > 0) & (top > 0) & (after > 0)
    return F.when(positive, parabolic(F.log(before), F.log(top), F.log(after)))


def mass(before: Column, top: Column, after: Column) -> Column:
    """Centroid of the three scores."""
    return F.try_divide(after - before, before + top + after)


def equiangular(before: Column, top: Column, after: Column) -> Column:
    """Meeting point of two lines of equal slope."""
    return F.try_divide(after - before, 2 * (top - F.least(before, after)))


def triangular(before: Column, top: Column, after: Column) -> Column:
    """Triangle by the difference of both neighbours; it points to ``before`` if they are equal."""
    size = F.try_divide(1 - F.abs(after - before), top - F.least(before, after))
    return F.when(after > before, size).otherwise(-size)


def ratio(before: Column, top: Column, after: Column) -> Column:
    """The neighbours' difference against it and the top together; 0 if they are equal."""
    step = after - before
    return F.when(step == 0, F.lit(0.0)).otherwise(F.try_divide(step, F.abs(step) + top))


def half_step(before: Column, top: Column, after: Column) -> Column:
    """The larger of both half steps down from the top, which is without sign."""
    return 0.5 * F.greatest(F.abs(top - before), F.abs(top - after))


def gaussian_surface(scores: list[list[Column]]) -> tuple[Column, Column]:
    """(rows, columns) of the middle of the two-dimensional bell curve nearest to 3 x 3 scores in least squares."""
    logs = [[F.when(s > 0, F.log(s)) for s in row] for row in scores]
    steps = (-1, 0, 1)

    def moment(weight) -> Column:
        terms = [logs[a + 1][b + 1] * F.lit(float(weight(a, b))) for a in steps for b in steps]
        return sum(terms[1:], terms[0])

    slope_i, slope_j = moment(lambda a, b: a) / 6, moment(lambda a, b: b) / 6
    twist = moment(lambda a, b: a * b) / 4
    bend_i, bend_j = moment(lambda a, b: 3 * a * a - 2) / 6, moment(lambda a, b: 3 * b * b - 2) / 6
    below = 4 * bend_i * bend_j - twist * twist
    return F.try_divide(twist * slope_j - 2 * slope_i * bend_j, below), F.try_divide(twist * slope_i - 2 * slope_j * bend_i, below)


def gradient_crossing(scores: list[Column]) -> Column:
    """Where the slope of seven scores along an axis, four wide, crosses zero; the middle one is the top."""
    a, b, c, d, e, f, g = scores
    here = b + c - e - f
    after, before = c + d - f - g, a + b - d - e
    return F.when(e > c, F.try_divide(here, here - after)).otherwise(F.try_divide(before, before - here) - 1)


def paraboloid(scores: list[list[Column]]) -> tuple[Column, Column]:
    """(rows, columns) of the top of the paraboloid through the middle, its four neighbours and the highest corner."""
    middle = scores[1][1]
    up, down, left, right = scores[0][1], scores[2][1], scores[1][0], scores[1][2]
    bend_i, bend_j = up + down - 2 * middle, left + right - 2 * middle
    corners = {(-1, -1): scores[0][0], (-1, 1): scores[0][2], (1, -1): scores[2][0], (1, 1): scores[2][2]}
    highest = F.greatest(*corners.values())
    twist = None
    for (a, b), corner in corners.items():
        # the corner's score is that of the middle, two slopes, two half bends and the twist
        beside = (down if a > 0 else up) + (right if b > 0 else left)
        found = (corner + middle - beside) * (a * b)
        twist = F.when(corner == highest, found) if twist is None else twist.when(corner == highest, found)
    slope_i, slope_j = (down - up) / 2, (right - left) / 2
    det = bend_i * bend_j - twist * twist
    return F.try_divide(twist * slope_j - bend_j * slope_i, det), F.try_divide(twist * slope_i - bend_i * slope_j, det)
