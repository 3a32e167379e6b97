"""Coordinates, map projection and geometry as column expressions.

A geotransform is six columns or numbers (x0, dx by column, dx by row, y0, dy by
column, dy by row) that give the centre of pixel (0, 0) and the steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, and the scale and false origin of UTM.
MAJOR_AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_SOUTH_NORTHING = 0.9996, 500000.0, 10000000.0
GRAVITY_PARAMETER = 3.986004418e14
ECCENTRICITY_SQUARED = 2 * FLATTENING - FLATTENING**2

Number = Column | float


def cartesian_to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def polar_to_cartesian(rho: Column, phi: Column) -> tuple[Column, Column]:
    return rho * F.cos(phi), rho * F.sin(phi)


def unit_vector(azimuth: Column, zenith: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a direction in degrees."""
    a, z = F.radians(azimuth), F.radians(zenith)
    return F.sin(a) * F.sin(z), F.cos(a) * F.sin(z), F.cos(z)


def sun_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Azimuth and zenith in degrees of a unit vector."""
    return F.degrees(F.atan2(x, y)), F.degrees(F.acos(z))


def pixel_to_map(transform: Sequence[Number], i: Column, j: Column) -> tuple[Column, Column]:
    x0, dxj, dxi, y0, dyj, dyi = transform
    return j * dxj + i * dxi + x0, j * dyj + i * dyi + y0


def map_to_pixel(transform: Sequence[Number], x: Column, y: Column) -> tuple[Column, Column]:
    """Fractional row and column."""
    x0, dxj, dxi, y0, dyj, dyi = transform
    det = dxj * dyi - dxi * dyj
    dx, dy = x - x0, y - y0
    return (dy * dxj - dx * dyj) / det, (dx * dyi - dy * dxi) / det


def utm_zone_number(lon: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number with the exceptions of Norway and Svalbard, and the latitude band."""
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
    for first, last, number in ((0, 9, 31), (9, 21, 33), (21, 33, 35), (33, 42, 37)):
        zone = zone.when((lat >= 72) & (lat <= 84) & (lon >= first) & (lon < last), number)
    zone = zone.otherwise(utm_zone_number(lon))
    band = F.substring(F.lit("CDEFGHJKLMNPQRSTUVWXX"), (F.floor((lat + 80) / 8) + 1).cast("int"), F.lit(1))
    return F.concat(zone.cast("int").cast("string"), band)


def utm_epsg(zone: Column, northern: Column) -> Column:
    return F.when(northern, 32600).otherwise(32700) + zone


def utm_from_geographic(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the series of Kruger to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(ECCENTRICITY_SQUARED)
    phi, away = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(t * t + 1))
    east, north = eta, xi
    for k, a in enumerate(alpha, 1):
        east = east + F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * a
        north = north + F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * a
    scale = UTM_SCALE * radius
    return east * scale + UTM_EAST, north * scale + F.when(lat < 0, UTM_SOUTH_NORTHING).otherwise(0.0)


def geographic_from_utm(x: Column, y: Column, zone: Column, northern: Column) -> tuple[Column, Column]:
    """Latitude and longitude, the inverse series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR_AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    scale = UTM_SCALE * radius
    xi = (y - F.when(northern, 0.0).otherwise(UTM_SOUTH_NORTHING)) / scale
    eta = (x - UTM_EAST) / scale
    xi_, eta_ = xi, eta
    for k, b in enumerate(beta, 1):
        xi_ = xi_ - F.sin(xi * (2 * k)) * F.cosh(eta * (2 * k)) * b
        eta_ = eta_ - F.cos(xi * (2 * k)) * F.sinh(eta * (2 * k)) * b
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    phi = chi
    for k, d in enumerate(delta, 1):
        phi = phi + F.sin(chi * (2 * k)) * d
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_))) + (zone * 6 - 183)


def earth_centred(lat: Column, lon: Column, height: Number = 0.0) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a place on the ellipsoid."""
    phi, lam = F.radians(lat), F.radians(lon)
    normal = F.lit(MAJOR_AXIS) / F.sqrt(1 - F.sin(phi) * F.sin(phi) * ECCENTRICITY_SQUARED)
    return (normal + height) * F.cos(phi) * F.cos(lam), (normal + height) * F.cos(phi) * F.sin(lam), (normal * (1 - ECCENTRICITY_SQUARED) + height) * F.sin(phi)


def geographic_from_earth_centred(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and height in one step of Bowring's method."""
    minor = MAJOR_AXIS * (1 - FLATTENING)
    second = ECCENTRICITY_SQUARED / (1 - ECCENTRICITY_SQUARED)
    p = F.hypot(x, y)
    theta = F.atan2(z * MAJOR_AXIS, p * minor)
    sine, cosine = F.sin(theta), F.cos(theta)
    phi = F.atan2(z + sine * sine * sine * (second * minor), p - cosine * cosine * cosine * (ECCENTRICITY_SQUARED * MAJOR_AXIS))
    normal = F.lit(MAJOR_AXIS) / F.sqrt(1 - F.sin(phi) * F.sin(phi) * ECCENTRICITY_SQUARED)
    return F.degrees(phi), F.degrees(F.atan2(y, x)), p * F.cos(phi) + z * F.sin(phi) - F.lit(MAJOR_AXIS) * MAJOR_AXIS / normal


def earth_radius(lat: Column) -> Column:
    """Radius of the ellipsoid at a latitude."""
    minor, phi = MAJOR_AXIS * (1 - FLATTENING), F.radians(lat)
    c, s = F.cos(phi), F.sin(phi)
    return F.sqrt((F.pow(c * MAJOR_AXIS**2, F.lit(2)) + F.pow(s * minor**2, F.lit(2))) / (F.pow(c * MAJOR_AXIS, F.lit(2)) + F.pow(s * minor, F.lit(2))))


def haversine(dlat: Column, dlon: Column, lat: Column, radius: Number | None = None) -> Column:
    """Great-circle distance for differences in degrees near a latitude."""
    a = F.pow(F.sin(F.radians(dlat) / 2), F.lit(2)) + F.cos(F.radians(lat)) * F.cos(F.radians(lat + dlat)) * F.pow(F.sin(F.radians(dlon) / 2), F.lit(2))
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * 2 * (earth_radius(lat) if radius is None else radius)


def rotated_covariance(qii: Column, qjj: Column, qij: Column, angle: Column) -> tuple[Column, Column, Column]:
    """R Q R' of a 2 by 2 covariance, for an angle in degrees."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    first = c * c * qii - c * s * qij * 2 + s * s * qjj
    second = s * s * qii + c * s * qij * 2 + c * c * qjj
    return first, second, c * s * (qii - qjj) + (c * c - s * s) * qij


def error_ellipse(s1: Column, s2: Column, rho: Column) -> tuple[Column, Column, Column]:
    """Large and small axis and orientation (degrees) of standard deviations and their correlation."""
    half, spread = (s1 * s1 + s2 * s2) / 2, (s1 * s1 - s2 * s2) / 2
    root = F.sqrt(spread * spread + F.pow(rho * s1 * s2, F.lit(2)))
    return F.sqrt(half + root), F.sqrt(F.greatest(half - root, F.lit(0.0))), F.degrees(F.atan2(rho * s1 * s2 * 2, s1 * s1 - s2 * s2) / 2)


def orientation(px, py, qx, qy, rx, ry) -> Column:
    """Twice the signed area of the triangle."""
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def side_of_line(px, py, qx, qy, rx, ry) -> Column:
    return F.signum(orientation(px, py, qx, qy, rx, ry))


def distance_to_line(px, py, qx, qy, rx, ry) -> Column:
    return F.try_divide(F.abs(orientation(px, py, qx, qy, rx, ry)), F.hypot(qx - px, qy - py))


def oriented_area(px, py, qx, qy, rx, ry) -> Column:
    return orientation(px, py, qx, qy, rx, ry) / 2


def segments_intersect(px, py, qx, qy, rx, ry, sx, sy) -> Column:
    """Whether segments pq and rs meet; parallel ones don't."""
    det = (qx - px) * (sy - ry) - (qy - py) * (sx - rx)
    t = F.try_divide((rx - px) * (sy - ry) - (ry - py) * (sx - rx), det)
    u = F.try_divide((rx - px) * (qy - py) - (ry - py) * (qx - px), det)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def bounding_box(transform: Sequence[Number], rows: Number, cols: Number) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x, least and greatest y of the pixel centres."""
    corners = [pixel_to_map(transform, F.lit(i), F.lit(j)) for i in (0, rows - 1) for j in (0, cols - 1)]
    xs, ys = zip(*corners, strict=True)
    return F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)


def pixel_spacing(transform: Sequence[Number]) -> Column:
    """The larger of the two steps."""
    _, dxj, dxi, _, dyj, dyi = (F.lit(v) if not isinstance(v, Column) else v for v in transform)
    return F.greatest(F.hypot(dxj, dyj), F.hypot(dxi, dyi))


def principal_strain(exx: Column, eyy: Column, exy: Column) -> tuple[Column, Column, Column]:
    """Largest and smallest strain and the orientation of the largest in degrees."""
    half, root = (exx + eyy) / 2, F.sqrt(F.pow((exx - eyy) / 2, F.lit(2)) + exy * exy)
    return half + root, half - root, F.degrees(F.atan2(exy * 2, exx - eyy) / 2)


def d8_direction(vx: Column, vy: Column) -> Column:
    """Code 0 to 7 of the flow direction, 8 where there is none."""
    still = vx.isNull() | vy.isNull() | F.isnan(vx) | F.isnan(vy) | ((vx == 0) & (vy == 0))
    return F.when(still, 8).otherwise(F.pmod(F.bround(F.atan2(vx, vy) * 4 / math.pi, 0).cast("int"), F.lit(8)))
