"""Geotransforms and boxes as column expressions.

A geotransform is six columns or numbers, as in ``geo``; a box is four, least
and greatest x and least and greatest y.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from penumbra.functions.geo import Number

Transform = Sequence[Number]
Box = Sequence[Number]


def _columns(values: Sequence[Number]) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(float(v)) for v in values]


def shifted(transform: Transform, di: Number, dj: Number) -> tuple[Column, ...]:
    """The geotransform of a raster that starts ``di`` rows and ``dj`` columns further."""
    x0, dxj, dxi, y0, dyj, dyi = _columns(transform)
    return x0 + dxj * dj + dxi * di, dxj, dxi, y0 + dyj * dj + dyi * di, dyj, dyi


def scaled(transform: Transform, factor: Number) -> tuple[Column, ...]:
    """The geotransform of pixels that are ``factor`` times as wide; the origin moves by half a new step of each axis."""
    x0, dxj, dxi, y0, dyj, dyi = _columns(transform)
    return x0 + dxj * factor / 2, dxj * factor, dxi * factor, y0 + dyi * factor / 2, dyj * factor, dyi * factor


def turned(transform: Transform, angle: Number) -> tuple[Column, ...]:
    """The geotransform with both steps turned by an angle in degrees about the origin."""
    x0, dxj, dxi, y0, dyj, dyi = _columns(transform)
    (a,) = _columns([angle])
    c, s = F.cos(F.radians(a)), F.sin(F.radians(a))
    return x0, dxj * c + dyj * s, dxi * c + dyi * s, y0, dyj * c - dxj * s, dyi * c - dxi * s


def displacement_in_pixels(transform: Transform, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Rows and columns of a displacement. With a turned raster both quotients add up, which is no inverse of the geotransform."""
    _, dxj, dxi, _, dyj, dyi = _columns(transform)
    di = F.when(dyj == 0, dy / dyi).otherwise(F.try_divide(dx, dyj) + dy / dyi)
    dj = F.when(dxi == 0, dx / dxj).otherwise(dx / dxj + F.try_divide(dy, dxi))
    return di, dj


def offset_pixels(transform: Transform, i: Column, j: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Fractional row and column of a pixel that a displacement moves."""
    di, dj = displacement_in_pixels(transform, dx, dy)
    return i + di, j + dj


def from_box(box: Box, dx: Number, dy: Number) -> tuple[Column, ...]:
    """The geotransform of a box with these spacings, and its whole rows and columns."""
    west, east, south, north = _columns(box)
    dx, dy = _columns([dx, dy])
    zero = F.lit(0.0)
    return west, dx, zero, north, zero, -dy, F.floor((north - south) / dy), F.floor((east - west) / dx)


def box_shape(box: Box, transform: Transform) -> tuple[Column, Column]:
    """Whole rows and columns of a box."""
    west, east, south, north = _columns(box)
    _, dxj, dxi, _, dyj, dyi = _columns(transform)
    return ((north - south) / F.hypot(dyj, dyi)).cast("bigint"), ((east - west) / F.hypot(dxj, dxi)).cast("bigint")


def largest_spacing(transform: Transform) -> Column:
    """The larger of both pixel sides, each from the two steps of one map axis."""
    _, dxj, dxi, _, dyj, dyi = _columns(transform)
    return F.greatest(F.hypot(dxj, dxi), F.hypot(dyj, dyi))


def box_ring(box: Box) -> Column:
    """The closed ring of a box as an array of (x, y), from the upper left corner against the clock."""
    west, east, south, north = _columns(box)
    corners = ((west, north), (west, south), (east, south), (east, north), (west, north))
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners))


def ring_mean(box: Box) -> tuple[Column, Column]:
    """Mean of the five points of a box's ring, so its first corner counts twice."""
    west, east, south, north = _columns(box)
    return (west * 3 + east * 2) / 5, (north * 3 + south * 2) / 5


def box_text(box: Box) -> Column:
    """A box's ring as well-known text."""
    points = F.transform(box_ring(box), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def template_points(radius: Column, matrix: Sequence[Sequence[Number]], between: bool = False) -> Column:
    """Places (x, y) of a template's samples under a 2 by 2 matrix, row by row as an array.

    The template has ``2 * radius + 1`` samples along each axis, or with
    ``between`` the ``2 * radius`` places between them.
    """
    (a, b), (c, d) = (_columns(row) for row in matrix)
    along = F.sequence(-radius, radius - 1) if between else F.sequence(-radius, radius)
    half = 0.5 if between else 0.0

    def sample(x: Column, y: Column) -> Column:
        x, y = x + half, y + half
        return F.struct((x * a + y * b).alias("x"), (x * c + y * d).alias("y"))

    return F.flatten(F.transform(along, lambda y: F.transform(along, lambda x: sample(x, y))))


def turned_template_points(radius: Column, angle: Column) -> Column:
    """Places of a template's samples turned by an angle in degrees."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return template_points(radius, ((c, s), (-s, c)))
