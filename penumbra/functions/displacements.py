"""Displacement fields as column expressions. Azimuths run clockwise from north, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penumbra.functions.geo import Number


def along_flow(dx: Column, dy: Column, prior_x: Column, prior_y: Column, across_x: Number, across_y: Number) -> tuple[Column, Column]:
    """A displacement projected on the direction of a prior one, along the flight line that ``across`` stands on; null where they are parallel."""
    share = F.try_divide(dx * across_x - dy * across_y, prior_x * across_x - prior_y * across_y)
    return prior_x * share, prior_y * share


def turned(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """A displacement turned against the clock by an angle in degrees."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    return u * c - v * s, u * s + v * c


def strain(ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column, Column]:
    """Strain along x, along y and between them, from the four slopes of a displacement field."""
    return ux, vy, (uy + vx) / 2


def slopes_along(zx: Column, zy: Column, azimuth: Column) -> tuple[Column, Column]:
    """Slopes in degrees along a direction and across it, from the two slopes of the terrain.

    The direction is taken as degrees; its sine and cosine are those of the angle.
    """
    c, s = F.cos(F.radians(azimuth)), F.sin(F.radians(azimuth))
    return F.degrees(F.atan(zx * c + zy * s)), F.degrees(F.atan(zx * s - zy * c))


def ortho_offset(dz: Column, azimuth: Column, zenith: Column) -> tuple[Column, Column]:
    """Rows and columns by which an elevation error moves a pixel that is seen at these angles."""
    rho = F.tan(F.radians(zenith)) * dz
    return -F.cos(F.radians(azimuth)) * rho, F.sin(F.radians(azimuth)) * rho
