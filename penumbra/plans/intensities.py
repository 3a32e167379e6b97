"""Queries of curves, attitudes and intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import attitude, curves
from penumbra.operators import intensity
from penumbra.plans.pixels import rounded, rounded_sql
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, pixels


@register("growth_curves", rounded_sql(PIXELS, {
    "four": "9e-1 + (1e-1 - 9e-1) / (1 + pow(red / 5e-1, 3e0))", "five": "9e-1 + (1e-1 - 9e-1) / pow(1 + pow(red / 5e-1, 3e0), 2e0)",
    "gompertz": "exp(-10e0 * exp(-25e-1 * red))", "sigmoid": "1 / (1 + exp(-10e0 * (red - 5e-1)))", "logit": "log10(blue / (1 - blue))",
    "gamma": "pow(red, 7e-1)", "arctangent": "atan(dz)",
}))
def growth_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, blue = F.col("red"), F.col("blue")
    return rounded(pixels(spark, sf_dir), {
        "four": curves.four_parameter(red, 0.1, 3.0, 0.5, 0.9), "five": curves.five_parameter(red, 0.1, 3.0, 0.5, 0.9, 2.0),
        "gompertz": curves.gompertz(red, 10.0, 2.5), "sigmoid": curves.sigmoid(red), "logit": curves.logit(blue),
        "gamma": curves.gamma(red, 0.7), "arctangent": curves.arctangent(F.col("dz")),
    })


@register("transformed_weights", rounded_sql(PIXELS, {
    "of_logit": "blue * blue * (1 - blue) * (1 - blue) * (nir / 2)", "of_log": "red * red * (nir / 2)", "of_reciprocal": "pow(red, 4e0) * (nir / 2)",
    "of_exponential": "2e0 / (exp(2 * red) * nir)", "of_square": "4e0 / (4 * red * red * nir)", "point_error": "sqrt(red * red + nir * nir)", "mean_axis": "pow(red * nir, 25e-2)",
}))
def transformed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, blue, nir = F.col("red"), F.col("blue"), F.col("nir")
    return rounded(pixels(spark, sf_dir), {
        "of_logit": curves.logit_weight(blue, nir, 2.0), "of_log": curves.log_weight(red, nir, 2.0), "of_reciprocal": curves.reciprocal_weight(red, nir, 2.0),
        "of_exponential": curves.exponential_weight(red, nir, 2.0), "of_square": curves.square_weight(red, nir, 2.0),
        "point_error": curves.point_error(red, nir), "mean_axis": curves.mean_axis(red, nir),
    })


_UNIT = f"(SELECT i, j, red / n AS a, nir / n AS b, blue / n AS c, green / n AS d FROM (SELECT *, sqrt(red * red + nir * nir + blue * blue + green * green) AS n FROM {PIXELS}))"
_R = {"xx": "1 - 2 * (b * b + c * c)", "xy": "2 * (a * b + c * d)", "xz": "2 * (a * c - b * d)", "yx": "2 * (a * b - c * d)", "yz": "2 * (b * c + a * d)", "zy": "2 * (b * c - a * d)", "zx": "2 * (a * c + b * d)", "zz": "1 - 2 * (a * a + b * b)", "yy": "1 - 2 * (a * a + c * c)"}


@register("attitudes", f"""WITH u AS {_UNIT}, m AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _R.items())} FROM u)
 SELECT i, j, round(degrees(atan2(2 * (b * c + a * d), 1 - 2 * (a * a + b * b))), 6) AS roll, round(degrees(asin(2 * (b * d - a * c))), 6) AS pitch, round(degrees(atan2(2 * (a * b + c * d), 1 - 2 * (b * b + c * c))), 6) AS yaw,
 round(degrees(acos((xx + yy + zz - 1) / 2)), 5) AS turn, round(yz - zy, 8) AS axis_x, round(zx - xz, 8) AS axis_y, round(xy - yx, 8) AS axis_z FROM m""")
def attitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler angles of unit quaternions made from four bands, and the turn and axis of their matrices."""
    n = F.sqrt(F.col("red") * F.col("red") + F.col("nir") * F.col("nir") + F.col("blue") * F.col("blue") + F.col("green") * F.col("green"))
    unit = pixels(spark, sf_dir).withColumn("n", n).select("i", "j", *((F.col(k) / F.col("n")).alias(v) for k, v in (("red", "a"), ("nir", "b"), ("blue", "c"), ("green", "d"))))
    m = unit.select("*", *(F.expr(e).alias(k) for k, e in _R.items()))
    matrix = [[F.col(f"{r}{c}") for c in "xyz"] for r in "xyz"]
    roll, pitch, yaw = attitude.quaternion_to_euler(*(F.col(k) for k in "abcd"))
    x, y, z = attitude.rotation_axis(matrix)
    return m.select(
        "i", "j", F.round(roll, 6).alias("roll"), F.round(pitch, 6).alias("pitch"), F.round(yaw, 6).alias("yaw"), F.round(attitude.rotation_angle(matrix), 5).alias("turn"),
        F.round(x, 8).alias("axis_x"), F.round(y, 8).alias("axis_y"), F.round(z, 8).alias("axis_z"),
    )


@register("intensity_adjustments", f"""WITH e AS (SELECT zone, max(z) AS high, min(red) AS low FROM {PIXELS} GROUP BY 1)
 SELECT p.i, p.j, CAST(floor(65535e0 / ln(1 + high) * ln(1 + z)) AS BIGINT) AS logarithmic, round(least(asinh((red - 6e-1) * (10e0 / abs(low - 6e-1))) / 3, 1), 8) AS hyperbolic FROM {PIXELS} p JOIN e USING (zone)""")
def intensity_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = intensity.log_adjusted(pixels(spark, sf_dir), ["zone"], "z", "logarithmic")
    return intensity.hyperbolic(logs, ["zone"], "red", "hyperbolic", 0.6).select("i", "j", "logarithmic", F.round("hyperbolic", 8).alias("hyperbolic"))


def _quantiles_sql(value: str) -> str:
    return f"(SELECT zone, v, sum(n) OVER (PARTITION BY zone ORDER BY v)::DOUBLE / sum(n) OVER (PARTITION BY zone) AS q FROM (SELECT zone, {value} AS v, count(*) AS n FROM {PIXELS} GROUP BY 1, 2))"


@register("hist_match", f"""WITH u AS (SELECT zone, q, v AS of, NULL::DOUBLE AS k, NULL::DOUBLE AS kq FROM {_quantiles_sql('z')} UNION ALL SELECT zone, q, NULL, v, q FROM {_quantiles_sql('dz')}),
 b AS (SELECT zone, q, of, last_value(k IGNORE NULLS) OVER up AS v1, last_value(kq IGNORE NULLS) OVER up AS q1, last_value(k IGNORE NULLS) OVER down AS v2, last_value(kq IGNORE NULLS) OVER down AS q2 FROM u
  WINDOW up AS (PARTITION BY zone ORDER BY q, k IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY zone ORDER BY q DESC, k IS NULL ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 m AS (SELECT zone, of, CASE WHEN q1 IS NULL THEN v2 WHEN q2 IS NULL OR q1 = q2 THEN v1 ELSE v1 + (q - q1) / (q2 - q1) * (v2 - v1) END AS mapped FROM b WHERE of IS NOT NULL),
 f AS (SELECT zone FROM {PIXELS} GROUP BY 1 HAVING count(*) >= 4)
 SELECT p.i, p.j, round(CASE WHEN f.zone IS NULL THEN p.z ELSE m.mapped END, 6) AS matched FROM {PIXELS} p JOIN m ON m.zone = p.zone AND m.of = p.z LEFT JOIN f ON f.zone = p.zone""")
def hist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations of each zone mapped to the distribution of its changes."""
    image = pixels(spark, sf_dir)
    return intensity.match_histogram(image, image, ["zone"], "z", "dz", "matched").select("i", "j", F.round("matched", 6).alias("matched"))
