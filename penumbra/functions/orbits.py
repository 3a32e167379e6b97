"""Orbits and lines of sight as column expressions.

Vectors are triples of columns in the earth-centred frame, in metres. Angles of
orbits (inclination, argument, longitude of the node) are in radians, those of
lines of sight in degrees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from penumbra.functions.geo import ECCENTRICITY_SQUARED, MAJOR_AXIS, Number

Vector = Sequence[Column]

MINOR_AXIS = MAJOR_AXIS * math.sqrt(1 - ECCENTRICITY_SQUARED)
#: Seconds in which the earth turns once below an orbit.
DAY = 24 * 60 * 60


def dot(u: Vector, v: Vector) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: Vector, v: Vector) -> tuple[Column, Column, Column]:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def unit(v: Vector) -> tuple[Column, Column, Column]:
    """The vector at length one; null for a vector without length."""
    size = F.sqrt(dot(v, v))
    return F.try_divide(v[0], size), F.try_divide(v[1], size), F.try_divide(v[2], size)


def inclination(position: Vector, velocity: Vector) -> Column:
    """The orbit's inclination in degrees: the supplement of the angle between its angular momentum and the pole."""
    return 180 - F.degrees(F.acos(unit(cross(position, velocity))[2]))


def line_of_sight(lat: Column, lon: Column, zenith: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Unit vector from a place towards the satellite that is seen at these angles."""
    phi, lam, zn, az = (F.radians(c) for c in (lat, lon, zenith, azimuth))
    east, north, up = F.sin(zn) * F.sin(az), F.sin(zn) * F.cos(az), F.cos(zn)
    outward = up * F.cos(phi) - north * F.sin(phi)
    return outward * F.cos(lam) - east * F.sin(lam), outward * F.sin(lam) + east * F.cos(lam), up * F.sin(phi) + north * F.cos(phi)


def acquisition_angles(satellite: Vector, ground: Vector) -> tuple[Column, Column]:
    """Zenith and azimuth in degrees at which a satellite is seen from a place on the ellipsoid.

    Up is the place with each coordinate divided by its axis, which is a little
    off the ellipsoid's normal.
    """
    sight = unit([s - g for s, g in zip(satellite, ground, strict=True)])
    up = [g / a for g, a in zip(ground, (MAJOR_AXIS, MAJOR_AXIS, MINOR_AXIS), strict=True)]
    level = F.hypot(up[0], up[1])
    east = (-up[1] / level, up[0] / level, F.lit(0.0))
    zenith = F.acos(F.greatest(F.least(dot(sight, up), F.lit(1.0)), F.lit(-1.0)))
    return F.degrees(zenith), F.degrees(F.atan2(dot(sight, east), dot(sight, cross(up, east))))


def node(phi: Column, lam: Column, inclination: Number) -> tuple[Column, Column]:
    """Argument and longitude of the ascending node of an orbit that passes over a place; null where it can't."""
    i = F.lit(inclination) if not isinstance(inclination, Column) else inclination
    sine, tangent = F.sin(phi) / F.sin(i), F.tan(phi) / F.tan(i)
    reached = (F.abs(sine) <= 1) & (F.abs(tangent) <= 1)
    return F.when(reached, F.asin(sine)), F.when(reached, lam + F.asin(tangent))


def ground_track(time: Column, period: Number, inclination: Number, argument: Column, longitude: Column) -> tuple[Column, Column, Column]:
    """Angle along the orbit and geocentric latitude and longitude below it, ``time`` seconds before the argument was reached."""
    i = F.lit(inclination) if not isinstance(inclination, Column) else inclination
    along = argument - time * (2 * math.pi) / period
    sine = F.sin(along) * F.sin(i)
    lat = F.asin(sine)
    return along, lat, longitude - F.asin(F.tan(lat) / F.tan(i)) - time * (2 * math.pi / DAY)


def orbit_position(time: Column, radius: Number, inclination: Number, period: Number, argument: Column, longitude: Column) -> tuple[Column, Column, Column]:
    """Place of the satellite on its circular orbit."""
    _, lat, lon = ground_track(time, period, inclination, argument, longitude)
    return F.cos(lat) * F.cos(lon) * radius, F.cos(lat) * F.sin(lon) * radius, F.sin(lat) * radius


def sight_residual(time: Column, sight: Vector, ground: Vector, radius: Number, inclination: Number, period: Number, argument: Column, longitude: Column) -> tuple[Column, ...]:
    """Unit vector from a place to the satellite on its orbit, less the observed one."""
    place = orbit_position(time, radius, inclination, period, argument, longitude)
    return tuple(u - s for u, s in zip(unit([p - g for p, g in zip(place, ground, strict=True)]), sight, strict=True))


def slope(of: Callable[[Column], Sequence[Column]], at: Column, step: float) -> tuple[Column, ...]:
    """Change of vectors by a parameter, from the values half a step to either side."""
    return tuple((after - before) / step for after, before in zip(of(at + step / 2), of(at - step / 2), strict=True))
