"""Queries of orbits, geotransforms, displacements and principal components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import colour, displacements, geo, orbits, transforms
from penumbra.operators import axes, photohypsometry
from penumbra.operators.orbits import fit_orbits
from penumbra.plans.pixels import rounded, rounded_sql
from penumbra.plans.registry import register
from penumbra.plans.views import CONNECTIONS, PIXELS, connections, pixels, read

_AWAY = 786000.0
_INCLINATION, _PERIOD, _RADIUS = math.radians(98.5), 5970.0, 7167000.0
#: Customers stand for places, and for satellites that are seen from there.
_SEEN = "(SELECT c_custkey AS id, c_acctbal / 200e0 AS lat, CAST((c_custkey * 37) % 360 AS DOUBLE) - 180 AS lon, CAST(c_custkey % 20 AS DOUBLE) + 1 AS zn, CAST((c_custkey * 7) % 360 AS DOUBLE) - 18e1 AS az, CAST(c_custkey % 60 AS DOUBLE) AS t FROM customer)"
_SIGHT = f"""(SELECT *, {geo.MAJOR_AXIS!r}::DOUBLE / sqrt(1 - {geo.ECCENTRICITY_SQUARED!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS n,
 -sin(radians(lon)) AS ex, cos(radians(lon)) AS ey, -sin(radians(lat)) * cos(radians(lon)) AS nx, -sin(radians(lat)) * sin(radians(lon)) AS ny, cos(radians(lat)) AS nz,
 cos(radians(lat)) * cos(radians(lon)) AS ux, cos(radians(lat)) * sin(radians(lon)) AS uy, sin(radians(lat)) AS uz,
 sin(radians(zn)) * sin(radians(az)) AS e, sin(radians(zn)) * cos(radians(az)) AS nn, cos(radians(zn)) AS u FROM {_SEEN})"""
_GROUND = f"(SELECT *, e * ex + nn * nx + u * ux AS sx, e * ey + nn * ny + u * uy AS sy, nn * nz + u * uz AS sz, n * ux AS gx, n * uy AS gy, n * {1 - geo.ECCENTRICITY_SQUARED!r}::DOUBLE * uz AS gz FROM {_SIGHT})"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    places = read(spark, sf_dir, "customer").select(
        k.alias("id"), (F.col("c_acctbal") / 200.0).alias("lat"), ((k * 37) % 360 - 180).cast("double").alias("lon"),
        (k % 20 + 1).cast("double").alias("zn"), ((k * 7) % 360 - 180).cast("double").alias("az"), (k % 60).cast("double").alias("t"),
    )
    sight = orbits.line_of_sight(*(F.col(c) for c in ("lat", "lon", "zn", "az")))
    ground = geo.earth_centred(F.col("lat"), F.col("lon"))
    return places.select("*", *(c.alias(n) for n, c in zip(("sx", "sy", "sz", "gx", "gy", "gz"), (*sight, *ground), strict=True)))


def _vector(names: str) -> tuple:
    return tuple(F.col(n) for n in names.split())


_SCALED = f"(SELECT *, gx / {geo.MAJOR_AXIS!r}::DOUBLE AS qx, gy / {geo.MAJOR_AXIS!r}::DOUBLE AS qy, gz / {orbits.MINOR_AXIS!r}::DOUBLE AS qz FROM {_GROUND})"


@register("lines_of_sight", rounded_sql(_SCALED, {
    "x": "sx", "y": "sy", "z": "sz", "zenith": "degrees(acos(sx * qx + sy * qy + sz * qz))",
    "azimuth": "degrees(atan2(sy * qx - sx * qy, (qx * qx + qy * qy) * sz - qz * (sx * qx + sy * qy)))",
}, keys=("id",), digits=5))
def lines_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sights of satellites, and the angles at which the satellites are seen there."""
    seen = _seen(spark, sf_dir)
    ground, sight = _vector("gx gy gz"), _vector("sx sy sz")
    zenith, azimuth = orbits.acquisition_angles([g + s * _AWAY for g, s in zip(ground, sight, strict=True)], ground)
    return rounded(seen, {"x": sight[0], "y": sight[1], "z": sight[2], "zenith": zenith, "azimuth": azimuth}, keys=("id",), digits=5)


_I = f"{_INCLINATION!r}::DOUBLE"
_TRACK = f"""(SELECT *, asin(sin(along) * sin({_I})) AS glat FROM (SELECT *, w - 2 * pi() * t / {_PERIOD!r}::DOUBLE AS along FROM (
 SELECT *, asin(sin(radians(lat)) / sin({_I})) AS w, radians(lon) - asin(tan(radians(lat)) / -tan({_I})) AS l FROM {_GROUND})))"""
_PLACE = f"(SELECT *, {_RADIUS!r}::DOUBLE * cos(glat) * cos(glon) AS px, {_RADIUS!r}::DOUBLE * cos(glat) * sin(glon) AS py, {_RADIUS!r}::DOUBLE * sin(glat) AS pz FROM (SELECT *, l + asin(tan(glat) / -tan({_I})) - 2 * pi() * t / 864e2 AS glon FROM {_TRACK}))"
_DISTANCE = "sqrt((px - gx) * (px - gx) + (py - gy) * (py - gy) + (pz - gz) * (pz - gz))"


@register("orbit_tracks", rounded_sql(_PLACE, {
    "argument": "w", "node": "l", "track_lat": "glat", "track_lon": "glon", "px": "px / 1e6", "py": "py / 1e6", "pz": "pz / 1e6",
    "rx": f"(px - gx) / {_DISTANCE} - sx", "ry": f"(py - gy) / {_DISTANCE} - sy", "rz": f"(pz - gz) / {_DISTANCE} - sz",
}, keys=("id",), digits=6))
def orbit_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbits over places, the satellite some seconds earlier, and how far its sight is from the observed one."""
    argument, longitude = orbits.node(F.radians("lat"), F.radians("lon"), _INCLINATION)
    seen = _seen(spark, sf_dir).select("*", argument.alias("w"), longitude.alias("l"))
    of = (F.col("w"), F.col("l"))
    _, lat, lon = orbits.ground_track(F.col("t"), _PERIOD, _INCLINATION, *of)
    place = orbits.orbit_position(F.col("t"), _RADIUS, _INCLINATION, _PERIOD, *of)
    left = orbits.sight_residual(F.col("t"), _vector("sx sy sz"), _vector("gx gy gz"), _RADIUS, _INCLINATION, _PERIOD, *of)
    names = {"argument": of[0], "node": of[1], "track_lat": lat, "track_lon": lon}
    names |= {n: c / 1e6 for n, c in zip(("px", "py", "pz"), place, strict=True)} | dict(zip(("rx", "ry", "rz"), left, strict=True))
    return rounded(seen, names, keys=("id",), digits=6)


_H = "gy * sz - gz * sy AS hx, gz * sx - gx * sz AS hy, gx * sy - gy * sx AS hz"


@register("orbit_inclinations", rounded_sql(f"(SELECT id, {_H} FROM {_GROUND})", {"inclination": "180 - degrees(acos(hz / sqrt(hx * hx + hy * hy + hz * hz)))"}, keys=("id",), digits=5))
def orbit_inclinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclinations of orbits through places in the direction of sights."""
    return rounded(_seen(spark, sf_dir), {"inclination": orbits.inclination(_vector("gx gy gz"), _vector("sx sy sz"))}, keys=("id",), digits=5)


#: Rows of x0, dxj, dxi, y0, dyj, dyi: every third raster is turned.
_TRANSFORMS = """(SELECT s_suppkey AS id, s_acctbal AS x0, 1e1 + s_suppkey % 5 AS dxj, CASE WHEN s_suppkey % 3 = 0 THEN 2e0 ELSE 0e0 END AS dxi, s_acctbal * 2 AS y0,
 CASE WHEN s_suppkey % 3 = 0 THEN 1e0 ELSE 0e0 END AS dyj, -1e1 - s_suppkey % 7 AS dyi, CAST(s_suppkey % 90 AS DOUBLE) AS a FROM supplier)"""
_NAMES = ("x0", "dxj", "dxi", "y0", "dyj", "dyi")


def _transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    turn = k % 3 == 0
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"), F.col("s_acctbal").alias("x0"), (k % 5 + 10.0).alias("dxj"), F.when(turn, 2.0).otherwise(0.0).alias("dxi"), (F.col("s_acctbal") * 2).alias("y0"),
        F.when(turn, 1.0).otherwise(0.0).alias("dyj"), (-10.0 - k % 7).alias("dyi"), (k % 90).cast("double").alias("a"),
    )


_COS, _SIN = "cos(radians(a))", "sin(radians(a))"


@register("geotransforms", rounded_sql(_TRANSFORMS, {
    "shift_x": "x0 + 4 * dxj + 3 * dxi", "shift_y": "y0 + 4 * dyj + 3 * dyi", "scale_x": "x0 + dxj * 125e-2", "scale_dxj": "dxj * 25e-1", "scale_y": "y0 + dyi * 125e-2", "scale_dyi": "dyi * 25e-1",
    "turn_dxj": f"dxj * {_COS} + dyj * {_SIN}", "turn_dxi": f"dxi * {_COS} + dyi * {_SIN}", "turn_dyj": f"dyj * {_COS} - dxj * {_SIN}", "turn_dyi": f"dyi * {_COS} - dxi * {_SIN}",
    "di": "CASE WHEN dyj = 0 THEN a / dyi ELSE 5e0 / dyj + a / dyi END", "dj": "CASE WHEN dxi = 0 THEN 5e0 / dxj ELSE 5e0 / dxj + a / dxi END",
    "spacing": "greatest(sqrt(dxj * dxj + dxi * dxi), sqrt(dyj * dyj + dyi * dyi))",
}, keys=("id",), digits=6))
def geotransforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geotransforms shifted, scaled and turned, and displacements in their pixels."""
    t = tuple(F.col(n) for n in _NAMES)
    shift, scale, turn = transforms.shifted(t, 3.0, 4.0), transforms.scaled(t, 2.5), transforms.turned(t, F.col("a"))
    di, dj = transforms.displacement_in_pixels(t, F.lit(5.0), F.col("a"))
    return rounded(_transforms(spark, sf_dir), {
        "shift_x": shift[0], "shift_y": shift[3], "scale_x": scale[0], "scale_dxj": scale[1], "scale_y": scale[3], "scale_dyi": scale[5],
        "turn_dxj": turn[1], "turn_dxi": turn[2], "turn_dyj": turn[4], "turn_dyi": turn[5], "di": di, "dj": dj, "spacing": transforms.largest_spacing(t),
    }, keys=("id",), digits=6)


_BOX_SQL = f"(SELECT *, x0 + 1000 + a * 3 AS east, y0 - 2000 - a AS south FROM {_TRANSFORMS})"


@register("boxes_as_rasters", f"""SELECT id, CAST(floor((y0 - south) / 7e0) AS BIGINT) AS n_rows, CAST(floor((east - x0) / 9e0) AS BIGINT) AS n_cols,
 CAST(trunc((y0 - south) / sqrt(dyj * dyj + dyi * dyi)) AS BIGINT) AS whole_rows, CAST(trunc((east - x0) / sqrt(dxj * dxj + dxi * dxi)) AS BIGINT) AS whole_cols,
 round((3 * x0 + 2 * east) / 5, 6) AS mean_x, round((3 * y0 + 2 * south) / 5, 6) AS mean_y, 5 AS n_points, round(y0 - 7e0 * floor((y0 - south) / 7e0), 6) AS last_y FROM {_BOX_SQL}""")
def boxes_as_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as geotransforms, their shapes and rings."""
    box = (F.col("x0"), F.col("x0") + 1000 + F.col("a") * 3, F.col("y0") - 2000 - F.col("a"), F.col("y0"))
    made, shape, mean = transforms.from_box(box, 9.0, 7.0), transforms.box_shape(box, tuple(F.col(n) for n in _NAMES)), transforms.ring_mean(box)
    return _transforms(spark, sf_dir).select(
        "id", made[6].alias("n_rows"), made[7].alias("n_cols"), shape[0].alias("whole_rows"), shape[1].alias("whole_cols"),
        F.round(mean[0], 6).alias("mean_x"), F.round(mean[1], 6).alias("mean_y"), F.size(transforms.box_ring(box)).alias("n_points"), F.round(made[3] + made[5] * made[6], 6).alias("last_y"),
    )


@register("template_samples", f"""SELECT id, count(*) AS n, round(sum(x * (y + 2)), 6) + 0e0 AS moment, round(max(x), 8) AS east, round(min(y), 8) AS south FROM (
 SELECT id, p * {_COS} + q * {_SIN} AS x, q * {_COS} - p * {_SIN} AS y FROM {_TRANSFORMS}, range(-3, 4) r(p), range(-3, 4) s(q)) GROUP BY id""")
def template_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of turned templates of seven by seven."""
    points = _transforms(spark, sf_dir).select("id", F.explode(transforms.turned_template_points(F.lit(3), F.col("a"))).alias("p")).select("id", "p.*")
    return points.groupBy("id").agg(F.count("*").alias("n"), (F.round(F.sum(F.col("x") * (F.col("y") + 2)), 6) + 0.0).alias("moment"), F.round(F.max("x"), 8).alias("east"), F.round(F.min("y"), 8).alias("south"))


_SHARE = "((red * 618034e-6 + nir * 786151e-6) / nullif(green * 618034e-6 + blue * 786151e-6, 0))"
_AZ = "radians(i % 360)"


@register("displacement_fields", rounded_sql(PIXELS, {
    "flow_x": f"green * {_SHARE}", "flow_y": f"blue * {_SHARE}", "turn_x": f"red * cos({_AZ}) - nir * sin({_AZ})", "turn_y": f"red * sin({_AZ}) + nir * cos({_AZ})", "shear": "(green + blue) / 2",
    "along": f"degrees(atan(red * cos({_AZ}) + nir * sin({_AZ})))", "across": f"degrees(atan(red * sin({_AZ}) - nir * cos({_AZ})))",
    "offset_i": f"-cos({_AZ}) * tan(radians(8e0)) * dz", "offset_j": f"sin({_AZ}) * tan(radians(8e0)) * dz",
}, digits=7))
def displacement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands taken as displacements and slopes: projected, turned and along an azimuth."""
    blue, green, red, nir, azimuth = (*(F.col(c) for c in ("blue", "green", "red", "nir")), (F.col("i") % 360).cast("double"))
    flow, turn = displacements.along_flow(red, nir, green, blue, 0.618034, -0.786151), displacements.turned(red, nir, azimuth)
    along, offset = displacements.slopes_along(red, nir, azimuth), displacements.ortho_offset(F.col("dz"), azimuth, F.lit(8.0))
    return rounded(pixels(spark, sf_dir), {
        "flow_x": flow[0], "flow_y": flow[1], "turn_x": turn[0], "turn_y": turn[1], "shear": displacements.strain(red, green, blue, nir)[2],
        "along": along[0], "across": along[1], "offset_i": offset[0], "offset_j": offset[1],
    }, digits=7)


# SQL has no eigenvectors: powers of the covariance turn a start vector into its first axis
_POWER = f"""WITH RECURSIVE c AS (SELECT zone, var_samp(red) AS xx, var_samp(green) AS yy, var_samp(nir) AS zz, covar_samp(red, green) AS xy, covar_samp(red, nir) AS xz, covar_samp(green, nir) AS yz FROM {PIXELS} GROUP BY zone),
 p AS (SELECT zone, 0 AS step, 1e0 AS u, 11e-1 AS v, 12e-1 AS w, 0e0 AS n FROM c UNION ALL
 SELECT zone, step + 1, a / sqrt(a * a + b * b + d * d), b / sqrt(a * a + b * b + d * d), d / sqrt(a * a + b * b + d * d), sqrt(a * a + b * b + d * d) FROM (
 SELECT p.zone, step, xx * u + xy * v + xz * w AS a, xy * u + yy * v + yz * w AS b, xz * u + yz * v + zz * w AS d FROM p JOIN c ON p.zone = c.zone WHERE step < 200)),
 e AS (SELECT zone, n AS largest, sign(u + v + w) AS s, u, v, w FROM p WHERE step = 200)"""


@register("first_axes", f"{_POWER} SELECT zone, round(largest, 7) + 0e0 AS largest, round(u * s, 5) + 0e0 AS e1, round(v * s, 5) + 0e0 AS e2, round(w * s, 5) + 0e0 AS e3 FROM e")
def first_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First principal axes of three bands in each zone."""
    return rounded(axes.first_axis(pixels(spark, sf_dir), ["zone"], ["red", "green", "nir"]).select("zone", F.round("largest", 7).alias("largest"), "e1", "e2", "e3"), {n: F.col(n) for n in ("e1", "e2", "e3")}, keys=("zone", "largest"), digits=5)


@register("fitted_geotransforms", f"""WITH m AS (SELECT label, i * 1e0 AS i, j * 1e0 AS j, 100 + 3 * j - i + red AS x, 50 - 2 * j + 4 * i + nir AS y FROM {PIXELS}),
 c AS (SELECT label, var_pop(i) AS ii, var_pop(j) AS jj, covar_pop(i, j) AS ij, covar_pop(i, x) AS ix, covar_pop(j, x) AS jx, covar_pop(i, y) AS iy, covar_pop(j, y) AS jy, avg(i) AS mi, avg(j) AS mj, avg(x) AS mx, avg(y) AS my FROM m GROUP BY label),
 s AS (SELECT *, (jx * ii - ix * ij) / (ii * jj - ij * ij) AS dxj, (ix * jj - jx * ij) / (ii * jj - ij * ij) AS dxi, (jy * ii - iy * ij) / (ii * jj - ij * ij) AS dyj, (iy * jj - jy * ij) / (ii * jj - ij * ij) AS dyi FROM c)
 SELECT label, round(mx - dxj * mj - dxi * mi, 4) AS x0, round(dxj, 6) AS dxj, round(dxi, 6) AS dxi, round(my - dyj * mj - dyi * mi, 4) AS y0, round(dyj, 6) AS dyj, round(dyi, 6) AS dyi FROM s""")
def fitted_geotransforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geotransforms in least squares of pixels that bands move a little."""
    i, j = F.col("i"), F.col("j")
    moved = pixels(spark, sf_dir).select("label", "i", "j", (100 + 3 * j - i + F.col("red")).alias("x"), (50 - 2 * j + 4 * i + F.col("nir")).alias("y"))
    out = axes.fitted_transform(moved, ["label"])
    return out.select("label", *(F.round(n, 4 if n.endswith("0") else 6).alias(n) for n in _NAMES))


@register("mask_extents", f"SELECT label, min(i) AS i_min, max(i) AS i_max, min(j) AS j_min, max(j) AS j_max FROM {PIXELS} WHERE red > 9e-1 GROUP BY label")
def mask_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last rows and columns of bright pixels."""
    return axes.mask_extent(pixels(spark, sf_dir), ["label"], F.col("red") > 0.9)


@register("component_shadows")
def component_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadow indices by the first component of each label, and by hue over lightness."""
    bands = pixels(spark, sf_dir)
    axis = axes.first_axis(bands, ["label"], ["red", "green", "blue"])
    blue, green, red = (F.col(c) for c in ("blue", "green", "red"))
    lightness, a, b = colour.xyz_to_lab(*colour.xyz(red, green, blue))
    _, hue = colour.lab_to_lch(lightness, a, b)
    return rounded(bands.join(axis, "label"), {"component": axes.component_shadow(blue, green, red), "detector": axes.shadow_detector(blue, green, red), "ratio": F.try_divide(hue + 1, lightness + 1)})


# casters stand at heights up to 500 m; every month has a profile of five levels
_AIR = """(SELECT m, h * 100e0 AS z, 290e0 - h * 2 - m AS t, 1013e2 - h * 1100 + m * 10 AS p FROM range(1, 13) a(m), range(0, 5) b(h))"""
_MONTH = f"(SELECT row_id, zenith, month(timestamp) AS m, CAST(row_id % 601 AS DOUBLE) - 50 AS z FROM {CONNECTIONS})"
_MET = f"""(SELECT row_id, zenith, a.t + (coalesce(b.t, a.t) - a.t) * s - 273.15e0 AS t, a.p + (coalesce(b.p, a.p) - a.p) * s AS p FROM (
 SELECT *, least(greatest(floor(z / 100), 0), 4) * 100e0 AS low, (greatest(least(z, 4e2), 0e0) - least(greatest(floor(z / 100), 0), 4) * 100) / 100 AS s FROM {_MONTH}) c
 JOIN {_AIR} a ON a.m = c.m AND a.z = low LEFT JOIN {_AIR} b ON b.m = c.m AND b.z = low + 100)"""
_INDEX = "(1 + (15998e0 / (38.9e0 - 1 / 0.3025e0) + 2406147e0 / (130 - 1 / 0.3025e0) + 8342.54e0) * 1e-8 * p / 96095.43e0 * (1 + p * (0.601e0 - t * 0.00972e0) * 1e-8) / (1 + t * 0.003661e0))"


@register("refracted_zeniths", rounded_sql(_MET, {"zenith_refrac": f"degrees(asin(sin(radians(zenith)) / {_INDEX}))"}, keys=("row_id",), digits=8))
def refracted_zeniths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sun angles of shadow connections below the air of the month."""
    level = spark.range(60).select((F.col("id") % 12 + 1).cast("int").alias("timestamp"), F.floor(F.col("id") / 12).alias("h"))
    air = level.select("timestamp", (F.col("h") * 100.0).alias("z"), (290.0 - F.col("h") * 2 - F.col("timestamp")).alias("temperature"), (101300.0 - F.col("h") * 1100 + F.col("timestamp") * 10).alias("pressure"))
    rows = connections(spark, sf_dir).select("row_id", "zenith", F.month("timestamp").alias("timestamp"), ((F.col("row_id") % 601).cast("double") - 50).alias("caster_Z"))
    out = photohypsometry.with_refracted_zenith(rows, air, 0.55)
    return rounded(out, {"zenith_refrac": F.col("zenith_refrac")}, keys=("row_id",), digits=8)


_VIEWS = "(SELECT p_partkey // 40 AS i, p_partkey % 40 AS j, p_retailprice / 100 AS value FROM part)"
_CASTERS = f"(SELECT row_id, x % 40 AS cx, CAST(row_id % 7 AS DOUBLE) + x / 1e3 AS cy FROM {CONNECTIONS})"


@register("caster_view_angles", f"""SELECT row_id, CAST(trunc(coalesce(v.value, 0)) AS INTEGER) AS caster_zn, CAST(trunc(coalesce(v.value / 2 - 8, 0)) AS INTEGER) AS caster_az FROM {_CASTERS} c
 LEFT JOIN {_VIEWS} v ON v.i = CAST(round_even(cy, 0) AS BIGINT) AND v.j = CAST(round_even(cx, 0) AS BIGINT)""")
def caster_view_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View angles at casters, from rasters that parts stand for."""
    k = F.col("p_partkey")
    views = read(spark, sf_dir, "part").select(F.floor(k / 40).alias("i"), (k % 40).alias("j"), (F.col("p_retailprice") / 100).alias("value"))
    casters = connections(spark, sf_dir).select("row_id", (F.col("x") % 40).alias("caster_X"), ((F.col("row_id") % 7).cast("double") + F.col("x") / 1000.0).alias("caster_Y"))
    out = photohypsometry.with_view_angles(casters, views, views.withColumn("value", F.col("value") / 2 - 8), (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    return out.select("row_id", "caster_zn", "caster_az")


_GROUP = "c_custkey % 3"


@register("orbit_fits", f"SELECT {_GROUP} AS orbit, count(*) AS n, round(716e4 + 1e4 * ({_GROUP}), 1) AS radius, round(985e-1 - 2e-1 * ({_GROUP}), 6) AS inclination FROM customer GROUP BY ALL")
def orbit_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orbits seen from places of customers: radius and inclination come back from the directions of sight."""
    key = F.col("c_custkey")
    group = key % 3
    seen = read(spark, sf_dir, "customer").select(
        group.alias("orbit"), key.alias("row_id"), (group * 0.05 + 0.7).alias("lat"), (group * 0.2).alias("lon"), (group * 1e4 + 7.16e6).alias("radius"), F.radians(98.5 - group * 0.2).alias("inclination"),
        ((key % 400) / 10.0 - 20).alias("time"), ((key * 7 % 41 - 20) / 1000.0).alias("off_lat"), ((key * 13 % 41 - 20) / 1000.0).alias("off_lon"),
    )
    argument, longitude = orbits.node(F.col("lat"), F.col("lon"), F.col("inclination"))
    place = orbits.orbit_position(F.col("time"), F.col("radius"), F.col("inclination"), 6040.0, argument, longitude)
    _, lat, lon = orbits.ground_track(F.col("time"), 6040.0, F.col("inclination"), argument, longitude)
    lat, lon = lat + F.col("off_lat"), lon + F.col("off_lon")
    ground = [F.cos(lat) * F.cos(lon) * 6_371_000.0, F.cos(lat) * F.sin(lon) * 6_371_000.0, F.sin(lat) * 6_371_000.0]
    sight = orbits.unit([p - g for p, g in zip(place, ground, strict=True)])
    rows = seen.select("orbit", "row_id", *(c.alias(f"sight_{x}") for c, x in zip(sight, "xyz", strict=True)), *(c.alias(f"ground_{x}") for c, x in zip(ground, "xyz", strict=True)))
    start = seen.groupBy("orbit").agg(*((F.min(n) + off).alias(n) for n, off in (("lat", 0.002), ("lon", -0.003), ("radius", 5000.0), ("inclination", 0.001)))).withColumn("period", F.lit(6040.0))
    found, _ = fit_orbits(rows, ["orbit"], start, rounds=4)
    return found.select("orbit", "n", F.round("radius", 1).alias("radius"), F.round(F.degrees("inclination"), 6).alias("inclination"))
