"""Queries of per-pixel expressions: indices, colours, atmosphere, coordinates, units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import atmosphere, colour, geo, spectral, units
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, connections, CONNECTIONS, pixels, read


def band_columns() -> tuple:
    """Blue, green, red, near infrared, red edge and short-wave infrared."""
    return tuple(F.col(c) for c in ("blue", "green", "red", "nir", "rededge", "swir"))


def rounded(df: DataFrame, columns: dict, keys: tuple[str, ...] = ("i", "j"), digits: int = 12) -> DataFrame:
    """The keys and each column rounded; rounding keeps both engines' last bits apart from the comparison."""
    return df.select(*keys, *(F.round(c, digits).alias(n) for n, c in columns.items()))


def rounded_sql(source: str, columns: dict[str, str], keys: tuple[str, ...] = ("i", "j"), digits: int = 12) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({c}, {digits}) + 0e0 AS {n}' for n, c in columns.items())} FROM {source}"


@register(
    "spectral_vegetation",
    rounded_sql(PIXELS, {
        "fai": "nir - (red + (swir - red) * (2e-1 / 945e-3))",
        "afai": "(nir - red) / nullif(rededge - red, 0)",
        "ndvi": "(nir - red) / nullif(nir + red, 0)",
        "ipvi": "nir / nullif(nir + red, 0)",
        "rdvi": "(nir - red) / nullif(sqrt(nir + red), 0)",
        "sr": "red / nullif(nir, 0)",
        "msr": "(red / nullif(nir, 0) - 1) / nullif(sqrt(red / nullif(nir, 0) + 1), 0)",
        "vari": "(green - red) / nullif(green + red - blue, 0)",
        "savi": "(nir - red) * 15e-1 / nullif(nir + red + 5e-1, 0)",
        "msavi": "(2 * nir + 1 - sqrt((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red))) * 5e-1",
        "arvi": "(nir - (red - (blue - red))) * 15e-1 / nullif(nir + (red - (blue - red)) + 5e-1, 0)",
        "mcari": "(rededge - red - (rededge - green) * 2e-1) * (red / nullif(green, 0))",
        "tvi": "((rededge - green) * 120 - (red - green) * 200) * 5e-1",
        "evi": "(nir - red) / nullif(nir + red * 6e0 - blue * 75e-1 + 1, 0) * 25e-1",
    }, digits=10),
)
def spectral_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, R, N, E, S = band_columns()
    return rounded(pixels(spark, sf_dir), {
        "fai": spectral.floating_algae(R, N, S, 0.665, 0.865, 1.61),
        "afai": spectral.alternative_floating_algae(R, E, N),
        "ndvi": spectral.ndvi(R, N),
        "ipvi": spectral.infrared_percentage(R, N),
        "rdvi": spectral.renormalized_difference(R, N),
        "sr": spectral.simple_ratio(R, N),
        "msr": spectral.modified_simple_ratio(R, N),
        "vari": spectral.visible_resistant(B, G, R),
        "savi": spectral.soil_adjusted(R, N),
        "msavi": spectral.modified_soil_adjusted(R, N),
        "arvi": spectral.atmospherically_resistant(B, R, N),
        "mcari": spectral.chlorophyll_absorption(G, R, E),
        "tvi": spectral.triangular(G, R, E),
        "evi": spectral.enhanced_vegetation(B, R, N),
    }, digits=10)


@register(
    "spectral_snow",
    rounded_sql(PIXELS, {
        "scf": "nir / swir", "sf": "red / swir", "ndsi": "(green - swir) / (green + swir)", "ndsii": "(red - swir) / (red + swir)",
        "s3": "nir * (red - swir) / ((red + nir) * (red + swir))", "swi": "green * (nir - swir) / ((green + nir) * (nir + swir))", "agei": "(red * 5e-1 + nir * 5e-1) / swir",
    }),
)
def spectral_snow(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, G, R, N, _, S = band_columns()
    return rounded(pixels(spark, sf_dir), {
        "scf": spectral.snow_cover_fraction(N, S), "sf": spectral.snow_fraction(R, S), "ndsi": spectral.snow_index(G, S), "ndsii": spectral.snow_ice_index(R, S),
        "s3": spectral.s3(R, N, S), "swi": spectral.snow_water(G, N, S), "agei": spectral.glacier_extraction(R, N, S),
    })


@register(
    "spectral_water",
    rounded_sql(PIXELS, {"ndwi": "coalesce((green - nir) / nullif(green + nir, 0), 0)", "mndwi": "(green - swir) / (green + swir)", "ndmi": "(nir - swir) / (nir + swir)", "ndbwi": "(blue - nir) / (blue + nir)"}, digits=10),
)
def spectral_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, _, N, _, S = band_columns()
    return rounded(pixels(spark, sf_dir), {"ndwi": spectral.water_index(G, N), "mndwi": spectral.modified_water(G, S), "ndmi": spectral.moisture(N, S), "ndbwi": spectral.blue_water(B, N)}, digits=10)


_TSAI1 = "((red + green) * (-sqrt(6e0) / 6) + blue * (-sqrt(6e0) / 3))"
_TSAI2 = "(red * (1 / sqrt(6e0)) - green * (2 / sqrt(6e0)))"
_HUE = f"(atan2({_TSAI1}, {_TSAI2}) / pi() - floor(atan2({_TSAI1}, {_TSAI2}) / pi()))"
_SAT = f"sqrt({_TSAI1} * {_TSAI1} + {_TSAI2} * {_TSAI2})"
_INT = "((red + green + blue) / 3)"
_Y = "(red * 257e-3 + green * 504e-3 + blue * 98e-3 + 625e-4)"
_CB = "(red * -148e-3 + green * -291e-3 + blue * 439e-3 + 5e-1)"
_CR = "(red * 439e-3 + green * -368e-3 + blue * -71e-3 + 5e-1)"
_YIQ_Y = "(red * 299e-3 + green * 587e-3 + blue * 114e-3)"
_YIQ_Q = "(red * 212e-3 + green * -523e-3 + blue * 311e-3)"
_SEI = "((blue + nir) - (green + red)) / ((blue + nir) + (green + red))"
_NDWI = "coalesce((green - nir) / nullif(green + nir, 0), 0)"


@register(
    "shadow_transforms",
    rounded_sql(PIXELS, {
        "siz": f"({_CB} - {_Y}) / nullif({_CB} + {_Y}, 0)",
        "shsv": f"({_HUE} + 1) / ({_INT} + 1)",
        "sycbcr": f"({_CR} + 1) / ({_Y} + 1)",
        "syiq": f"({_YIQ_Q} + 1) / ({_YIQ_Y} + 1)",
        "isi": f"(({_SAT} - {_INT}) / ({_SAT} + {_INT}) + 1 - nir) / nullif(({_SAT} - {_INT}) / ({_SAT} + {_INT}) + 1 + nir, 0)",
        "sei": _SEI,
        "csi": f"{_SEI} - CASE WHEN nir >= {_NDWI} THEN nir ELSE {_NDWI} END",
        "nsvdi": f"({_SAT} - {_INT}) / ({_SAT} + {_INT})",
        "sil": f"{_SAT} - {_INT}",
        "mpsi": f"({_HUE} - {_INT}) * (green - blue)",
        "c3": "atan2(blue, greatest(red, green))",
        "gevers": f"atan2(blue, greatest(red, green)) * {_NDWI}",
        "shi": "(1 - blue) * (1 - green) * (1 - red) * (1 - nir)",
        "nri": "(greatest(blue, green, red, nir) - least(blue, green, red, nir)) / (greatest(blue, green, red, nir) + least(blue, green, red, nir))",
        "fri": "least(blue, green, red, nir) / greatest(blue, green, red, nir)",
    }),
)
def shadow_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, R, N, _, _ = band_columns()
    bands = {"blue": B, "green": G, "red": R, "nir": N}
    codes = ("siz", "shsv", "sycbcr", "syiq", "isi", "sei", "csi", "nsvdi", "sil", "mpsi", "c3", "gevers", "shi", "nri", "fri")
    return rounded(pixels(spark, sf_dir), {code: spectral.shadow_transform(code, **bands) for code in codes})


@register(
    "colour_spaces",
    rounded_sql(PIXELS, {
        "yiq_y": _YIQ_Y, "yiq_i": "red * 596e-3 + green * -275e-3 + blue * -321e-3", "yiq_q": _YIQ_Q,
        "luma": _Y, "cb": _CB, "cr": _CR, "hue": _HUE, "sat": _SAT, "intensity": _INT,
        "x": "red * 5141e-4 + green * 3239e-4 + blue * 1604e-4", "y": "red * 2651e-4 + green * 6702e-4 + blue * 641e-4", "z_xyz": "red * 241e-4 + green * 1228e-4 + blue * 8444e-4",
        "l": "red * 3811e-4 + green * 5783e-4 + blue * 402e-4", "m": "red * 1967e-4 + green * 7244e-4 + blue * 782e-4",
        "erdas_i": "(greatest(red, green, blue) + least(red, green, blue)) / 2",
        "erdas_s": "CASE WHEN (greatest(red, green, blue) + least(red, green, blue)) / 2 <= 5e-1 THEN (greatest(red, green, blue) - least(red, green, blue)) / (greatest(red, green, blue) + least(red, green, blue)) ELSE (greatest(red, green, blue) - least(red, green, blue)) / (2 - greatest(red, green, blue) + least(red, green, blue)) END",
    }),
)
def colour_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, R, _, _, _ = band_columns()
    names = ("yiq_y", "yiq_i", "yiq_q", "luma", "cb", "cr", "hue", "sat", "intensity", "x", "y", "z_xyz", "l", "m")
    columns = (*colour.yiq(R, G, B), *colour.ycbcr(R, G, B), *colour.hsi(R, G, B), *colour.xyz(R, G, B), *colour.rgb_to_lms(R, G, B)[:2])
    _, saturation, intensity = colour.erdas_hsi(B, G, R)
    return rounded(pixels(spark, sf_dir), dict(zip(names, columns, strict=True)) | {"erdas_i": intensity, "erdas_s": saturation})


_LAB = "CASE WHEN {0} > 8856e-6 THEN pow({0}, 1e0 / 3) ELSE {0} * 7787e-3 + 16e0 / 116 END"


@register(
    "colour_lab",
    f"""WITH p AS (SELECT i, j, (red * 5141e-4 + green * 3239e-4 + blue * 1604e-4) * 100 / 95047e-3 AS xn, (red * 2651e-4 + green * 6702e-4 + blue * 641e-4) * 100 / 100e0 AS yn,
 (red * 241e-4 + green * 1228e-4 + blue * 8444e-4) * 100 / 108883e-3 AS zn FROM {PIXELS}),
 q AS (SELECT i, j, CASE WHEN yn <= 8856e-6 THEN yn * 9033e-1 ELSE pow(yn, 1e0 / 3) * 116 END AS l,
 ({_LAB.format('xn')} - {_LAB.format('zn')}) * 500 AS a, ({_LAB.format('yn')} - {_LAB.format('zn')}) * 200 AS b FROM p)
 SELECT i, j, round(l, 5) AS l, round(a, 5) AS a, round(b, 5) AS b, round(sqrt(a * a + b * b), 5) AS chroma FROM q""",
)
def colour_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, R, _, _, _ = band_columns()
    x, y, z = colour.xyz(R, G, B)
    lightness, a, b = colour.xyz_to_lab(x * 100, y * 100, z * 100)
    chroma, _ = colour.lab_to_lch(lightness, a, b)
    return rounded(pixels(spark, sf_dir), {"l": lightness, "a": a, "b": b, "chroma": chroma}, digits=5)


_AIR = "(SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, l_quantity + 2735e-1 AS k, l_quantity + 35e-2 AS t, 60000e0 + l_extendedprice / 2 AS p, l_discount * 5 AS h, 4e-1 + l_tax * 5 AS w FROM lineitem)"


def _air(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j"), (F.col("l_quantity") + 273.5).alias("k"), (F.col("l_quantity") + 0.35).alias("t"),
        (F.col("l_extendedprice") / 2 + 60000.0).alias("p"), (F.col("l_discount") * 5).alias("h"), (F.col("l_tax") * 5 + 0.4).alias("w"),
    )


@register(
    "refraction_index",
    rounded_sql(_AIR, {
        "edlen_ppm": "((8342.54e0 + 15998e0 / (38.9e0 - 1 / (w * w)) + 2406147e0 / (130 - 1 / (w * w))) * 1e-8 * p / 96095.43e0 * ((1 + p * (601e-3 - t * 972e-5) * 1e-8) / (1 + t * 3661e-6))) * 1e6",
        "simple_ppm": "(p * 786e-6 / (t + 273) - h * (t * t + 160) * 15e-12) * 1e6",
        "refracted": "degrees(asin(sin(radians(t + 20)) / 1.0002904e0))",
    }, digits=4),
)
def refraction_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p, h, w = (F.col(c) for c in "tphw")
    return rounded(_air(spark, sf_dir), {
        "edlen_ppm": (atmosphere.refractive_index_visible(w, t, p) - 1) * 1e6,
        "simple_ppm": (atmosphere.refractive_index_simple(p, h, t) - 1) * 1e6,
        "refracted": atmosphere.refraction_spherical(t + 20),
    }, digits=4)


_OMEGA = "(k + -238555575678e-12 / (k - 650175348448e-9))"


@register(
    "saturation_pressure",
    f"""WITH o AS (SELECT i, j, k, p, {_OMEGA} AS o FROM {_AIR}), q AS (SELECT i, j, k, p,
 o * o + o * 1167.05214528e0 - 724213.167032e0 AS a, o * o * -17.0738469401e0 + o * 12020.8247025e0 - 3232555.03223e0 AS b,
 o * o * 14.9151086135e0 + o * -4823.26573616e0 + 405113.405421e0 AS c FROM o)
 SELECT i, j, round(pow(2 * c / (sqrt(b * b - 4 * a * c) - b), 4) * 1e6, 3) AS svp,
 round(611.657e0 * exp((1 - pow(k / 273.16e0, -15e-1)) * -13.928169e0 + (1 - pow(k / 273.16e0, -125e-2)) * 34.7078238e0), 3) AS svp_ice,
 round(pow(10e0, -2663.5e0 / k + 12.537e0), 3) AS pressure_ice,
 round(p * 314e-10 + (k - 273.15e0) * (k - 273.15e0) * 56e-8 + 1.00062e0, 6) AS enhancement FROM q""",
)
def saturation_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("k"), F.col("p")
    out = _air(spark, sf_dir)
    enhancement = atmosphere.enhancement_factor(units.kelvin_to_celsius(k), p)
    return out.select("i", "j", F.round(atmosphere.saturation_pressure(k), 3).alias("svp"), F.round(atmosphere.saturation_pressure_ice(k), 3).alias("svp_ice"), F.round(atmosphere.vapour_pressure_ice(k), 3).alias("pressure_ice"), F.round(enhancement, 6).alias("enhancement"))


@register(
    "coordinate_conversions",
    rounded_sql(f"(SELECT row_id, x, y, zenith, x - 100e0 AS lon, y / 997e0 * 160 - 75 AS lat FROM {CONNECTIONS})", {
        "rho": "sqrt(x * x + y * y)", "phi": "atan2(y, x)",
        "map_x": "x * 10e0 + y * 5e-1 + 1000", "map_y": "x * 2e-1 - y * 10e0 + 5000",
        "row": "((y - 5000) * 10e0 - (x - 1000) * 2e-1) / (10e0 * -10e0 - 5e-1 * 2e-1)", "col": "((x - 1000) * -10e0 - (y - 5000) * 5e-1) / (10e0 * -10e0 - 5e-1 * 2e-1)",
        "zone_number": "(((CAST(floor((lon + 180) / 6) AS BIGINT) % 60) + 60) % 60) + 1",
        "vx": "sin(radians(x)) * sin(radians(zenith))", "vy": "cos(radians(x)) * sin(radians(zenith))", "vz": "cos(radians(zenith))",
        "kilometres": "atan2(sqrt(pow(sin(radians(zenith / 100) / 2), 2) + cos(radians(lat)) * cos(radians(lat + zenith / 100)) * pow(sin(radians(zenith / 50) / 2), 2)), sqrt(1 - (pow(sin(radians(zenith / 100) / 2), 2) + cos(radians(lat)) * cos(radians(lat + zenith / 100)) * pow(sin(radians(zenith / 50) / 2), 2)))) * 2 * 6371e0",
    }, ("row_id",), 6),
)
def coordinate_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connections(spark, sf_dir).withColumns({"lon": F.col("x") - 100.0, "lat": F.col("y") / 997.0 * 160 - 75})
    x, y, zenith = F.col("x"), F.col("y"), F.col("zenith")
    transform = (1000.0, 10.0, 0.5, 5000.0, 0.2, -10.0)
    rho, phi = geo.cartesian_to_polar(x, y)
    map_x, map_y = geo.pixel_to_map(transform, y, x)
    row, col = geo.map_to_pixel(transform, x, y)
    vx, vy, vz = geo.unit_vector(x, zenith)
    return rounded(c, {
        "rho": rho, "phi": phi, "map_x": map_x, "map_y": map_y, "row": row, "col": col, "zone_number": geo.utm_zone_number(F.col("lon")),
        "vx": vx, "vy": vy, "vz": vz, "kilometres": geo.haversine(zenith / 100, zenith / 50, F.col("lat"), 6371.0),
    }, ("row_id",), 6)


@register(
    "units_and_dates",
    f"""SELECT row_id, CAST(year(timestamp) AS BIGINT) AS year, CAST(dayofyear(timestamp) AS BIGINT) AS doy,
 CAST(strftime(timestamp, '%Y%m%d') AS BIGINT) AS datenum,
 CAST(floor(x) AS BIGINT) AS d, CAST(floor(x * 60 - 60 * floor(x * 60 / 60)) AS BIGINT) AS m, round(x * 3600 - 60 * floor(x * 3600 / 60), 4) AS s,
 round(zenith * (400e0 / 360), 6) AS gon, round((x * 7 - 360 * floor(x * 7 / 360)), 6) AS compass, round(x * 7 + 180 - 360 * floor((x * 7 + 180) / 360) - 180, 6) AS argument,
 round(y * 750061683e-9, 6) AS torr, round(y + 273.15e0, 6) AS kelvin FROM {CONNECTIONS}""",
)
def units_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, zenith, date = F.col("x"), F.col("y"), F.col("zenith"), F.col("timestamp")
    year, doy = units.day_of_year(date)
    d, m, s = units.degrees_to_dms(x)
    return connections(spark, sf_dir).select(
        "row_id", year.alias("year"), doy.alias("doy"), units.date_number(date).alias("datenum"), d.cast("bigint").alias("d"), m.cast("bigint").alias("m"), F.round(s, 4).alias("s"),
        F.round(units.degrees_to_gon(zenith), 6).alias("gon"), F.round(units.degrees_to_compass(x * 7), 6).alias("compass"), F.round(units.degrees_to_argument(x * 7), 6).alias("argument"),
        F.round(units.mbar_to_torr(y), 6).alias("torr"), F.round(units.celsius_to_kelvin(y), 6).alias("kelvin"),
    )


@register(
    "strain_and_ellipse",
    rounded_sql(PIXELS, {
        "e_max": "(blue + green) / 2 + sqrt(pow((blue - green) / 2, 2) + red * red)", "e_min": "(blue + green) / 2 - sqrt(pow((blue - green) / 2, 2) + red * red)",
        "major": "sqrt((blue * blue + green * green) / 2 + sqrt(pow((blue * blue - green * green) / 2, 2) + pow(5e-1 * blue * green, 2)))",
        "q_ii": "pow(cos(radians(30)), 2) * blue - cos(radians(30)) * sin(radians(30)) * red * 2 + pow(sin(radians(30)), 2) * green",
        "area": "((green - blue) * (swir - red) - (nir - red) * (rededge - blue)) / 2",
        "d8": "CASE WHEN dz = 0 AND red = 5e-1 THEN 8 ELSE ((CAST(round_even(atan2(dz, red - 5e-1) * 4 / pi(), 0) AS INTEGER) % 8) + 8) % 8 END",
    }),
)
def strain_and_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    B, G, R, N, E, S = band_columns()
    e_max, e_min, _ = geo.principal_strain(B, G, R)
    major, _, _ = geo.error_ellipse(B, G, F.lit(0.5))
    q_ii, _, _ = geo.rotated_covariance(B, G, R, F.lit(30.0))
    return rounded(pixels(spark, sf_dir), {
        "e_max": e_max, "e_min": e_min, "major": major, "q_ii": q_ii,
        "area": geo.oriented_area(B, R, G, N, E, S), "d8": geo.d8_direction(F.col("dz"), R - 0.5),
    })
