"""Queries on a raster: samples, neighbourhoods, shadows and flow.

The raster has a row for each part key over 40 and a column for each remainder;
its values are retail prices. One in 17 pixels is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions.geo import d8_direction
from penumbra.operators import rasters
from penumbra.plans.registry import register
from penumbra.plans.views import read

COLS = 40
_RASTER = f"(SELECT 'dem' AS raster_id, CAST(p_partkey // {COLS} AS BIGINT) AS i, CAST(p_partkey % {COLS} AS BIGINT) AS j, p_retailprice AS value FROM part)"
_POINTS = "(SELECT c_custkey AS id, (c_custkey % 397) / 10e0 AS x, -((c_custkey % 211) / 10e0) AS y FROM customer)"
TRANSFORM = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.lit("dem").alias("raster_id"), F.floor(n / COLS).cast("bigint").alias("i"), (n % COLS).alias("j"), F.col("p_retailprice").alias("value"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 397 / 10.0).alias("x"), (-(F.col("c_custkey") % 211 / 10.0)).alias("y"))


@register("raster_nearest", f"SELECT id, coalesce(value, 0) AS z FROM {_POINTS} LEFT JOIN {_RASTER} ON i = CAST(round_even(-y, 0) AS BIGINT) AND j = CAST(round_even(x, 0) AS BIGINT)")
def raster_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.sample_nearest(points(spark, sf_dir), raster(spark, sf_dir), TRANSFORM, "x", "y", "z").select("id", "z")


@register("raster_bilinear", f"""WITH p AS (SELECT id, least(greatest(-y, 0), 20) AS fi, least(greatest(x, 0), 39) AS fj FROM {_POINTS}), q AS (SELECT *, floor(fi) AS a, floor(fj) AS b FROM p),
 w AS (SELECT id, a + di AS i, b + dj AS j, (CASE WHEN di = 1 THEN fi - a ELSE 1 - (fi - a) END) * (CASE WHEN dj = 1 THEN fj - b ELSE 1 - (fj - b) END) AS w FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(di, dj))
 SELECT id, round(CASE WHEN count(*) = count(value) THEN sum(w * value) END, 6) AS z FROM w LEFT JOIN {_RASTER} r ON w.i = r.i AND w.j = r.j WHERE w > 0 GROUP BY id""")
def raster_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rasters.sample_bilinear(points(spark, sf_dir), raster(spark, sf_dir), TRANSFORM, (21, COLS), "x", "y", "z", "id")
    return out.select("id", F.round("z", 6).alias("z"))


_WINDOW = "SELECT a.i, a.j, {0} FROM {1} a {2} JOIN {1} b ON b.i BETWEEN a.i - {3} AND a.i + {3} AND b.j BETWEEN a.j - {3} AND a.j + {3} {4} GROUP BY a.i, a.j"


@register("curvature", _WINDOW.format("round(CASE WHEN count(*) = 9 THEN sum(CASE WHEN a.i = b.i AND a.j = b.j THEN b.value ELSE -b.value / 8 END) END, 6) + 0e0 AS curvature", _RASTER, "", 1, ""))
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.curvature(raster(spark, sf_dir)).select("i", "j", F.round("curvature", 6).alias("curvature"))


_SLOPES = _WINDOW.format(
    "CASE WHEN count(*) = 9 THEN sum((b.i - a.i) * (CASE WHEN a.j = b.j THEN 61e0 ELSE 17e0 END) / 190 / 10 * b.value) END AS down, CASE WHEN count(*) = 9 THEN sum((b.j - a.j) * (CASE WHEN a.i = b.i THEN 61e0 ELSE 17e0 END) / 190 / 10 * b.value) END AS righ",
    _RASTER, "", 1, "",
)


@register("slope_aspect", f"SELECT i, j, round(degrees(atan(sqrt(down * down + righ * righ))), 5) AS slope, round(down, 6) AS down FROM ({_SLOPES})")
def slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.slopes(raster(spark, sf_dir)).select("i", "j", F.round("slope", 5).alias("slope"), F.round("down", 6).alias("down"))


@register("shading", f"SELECT i, j, round((down * cos(radians(135)) * sin(radians(60)) - righ * sin(radians(135)) * sin(radians(60)) + cos(radians(60))) / sqrt(1 + down * down + righ * righ), 6) AS shade FROM ({_SLOPES})")
def shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.shading(raster(spark, sf_dir), 135.0, 60.0).select("i", "j", F.round("shade", 6).alias("shade"))


_CAST = f"(SELECT i, j, coalesce(max(r) OVER (PARTITION BY j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > r, false) AS shadow FROM (SELECT i, j, value + i * (10 / tan(radians(45))) AS r FROM {_RASTER}))"


@register("shadow_cast_rows", f"SELECT i, j, shadow FROM {_CAST}")
def shadow_cast_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.shadow_cast(raster(spark, sf_dir), 45.0).select("i", "j", "shadow")


@register("suntrace_islands", f"SELECT j, min(i) AS first, max(i) AS last FROM (SELECT i, j, i - row_number() OVER (PARTITION BY j ORDER BY i) AS g FROM {_CAST} WHERE shadow) GROUP BY j, g")
def suntrace_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.shadow_runs(rasters.shadow_cast(raster(spark, sf_dir), 45.0)).select("j", "first", "last")


_MASK = f"(SELECT i, j FROM {_RASTER} WHERE value > 950)"


@register("mask_boundary", f"SELECT a.i, a.j FROM {_MASK} a LEFT JOIN {_MASK} b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j HAVING count(b.i) < 4")
def mask_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = raster(spark, sf_dir).withColumn("value", (F.col("value") > 950).cast("int"))
    return rasters.mask_boundary(mask).select("i", "j")


_HOLES = f"(SELECT i, j, CASE WHEN (i * 40 + j) % 17 = 0 THEN NULL ELSE value END AS value FROM {_RASTER})"


@register("local_infill", f"""SELECT a.i, a.j, round(CASE WHEN a.value IS NOT NULL THEN any_value(a.value) ELSE sum(b.value / (pow(b.i - a.i, 2) + pow(b.j - a.j, 2))) / sum(1 / (pow(b.i - a.i, 2) + pow(b.j - a.j, 2))) END, 5) AS value
 FROM {_HOLES} a LEFT JOIN {_HOLES} b ON b.value IS NOT NULL AND b.i BETWEEN a.i - 2 AND a.i + 2 AND b.j BETWEEN a.j - 2 AND a.j + 2 AND (a.i <> b.i OR a.j <> b.j) GROUP BY a.i, a.j, a.value""")
def local_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = raster(spark, sf_dir).withColumn("value", F.when((F.col("i") * 40 + F.col("j")) % 17 != 0, F.col("value")))
    return rasters.local_fill(holes, 2).select("i", "j", F.round("value", 5).alias("value"))


@register("local_mad", f"""WITH n AS (SELECT a.i, a.j, any_value(a.value) AS v, median(b.value) AS m, list(b.value) AS l FROM {_RASTER} a JOIN {_RASTER} b ON b.i BETWEEN a.i - 1 AND a.i + 1 AND b.j BETWEEN a.j - 1 AND a.j + 1 GROUP BY a.i, a.j),
 d AS (SELECT i, j, any_value(v) AS v, any_value(m) AS m, median(abs(x - m)) AS d FROM (SELECT i, j, v, m, unnest(l) AS x FROM n) GROUP BY i, j) SELECT i, j, abs(v - m) < d * 14826e-4 AS inlier FROM d""")
def local_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.local_median_filter(raster(spark, sf_dir), 1).select("i", "j", "inlier")


_D8 = f"(SELECT i, j, CAST(((CAST(round_even(atan2(sin(i), cos(j * 13e-1)) * 4 / pi(), 0) AS INTEGER) % 8) + 8) % 8 AS INTEGER) AS d8 FROM {_RASTER})"


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("i", "j", d8_direction(F.sin("i"), F.cos(F.col("j") * 1.3)).cast("int").alias("d8"))


@register("d8_direction", f"SELECT i, j, d8 FROM {_D8}")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow(spark, sf_dir)


_STEP = f"(SELECT i, j, i + [0, 1, 1, 1, 0, -1, -1, -1][d8 + 1] AS to_i, j + [1, 1, 0, -1, -1, -1, 0, 1][d8 + 1] AS to_j FROM {_D8})"


@register("d8_streamflow", f"""WITH RECURSIVE f AS {_STEP}, r AS (SELECT i * 40 + j AS id, i, j, 0 AS step, [{{'i': i, 'j': j}}] AS path FROM f WHERE j = 0 UNION ALL SELECT r.id, f.to_i, f.to_j, r.step + 1, list_append(path, {{'i': f.to_i, 'j': f.to_j}}) FROM r JOIN f ON r.i = f.i AND r.j = f.j WHERE NOT list_contains(path, {{'i': f.to_i, 'j': f.to_j}}))
 SELECT id, i, j, step FROM r""")
def d8_streamflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = raster(spark, sf_dir).filter("j = 0").select((F.col("i") * 40 + F.col("j")).alias("id"), "i", "j")
    return rasters.downstream(flow(spark, sf_dir), starts)


@register("d8_catchment", f"""WITH RECURSIVE f AS {_STEP}, r AS (SELECT i * 40 + j AS id, i, j FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.i = f.to_i AND g.j = f.to_j) UNION SELECT r.id, f.i, f.j FROM r JOIN f ON f.to_i = r.i AND f.to_j = r.j) SELECT id, i, j FROM r""")
def d8_catchment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What flows into each cell whose own flow leaves the raster."""
    cells = flow(spark, sf_dir)
    return rasters.catchment(cells, rasters.outlets(cells).select((F.col("i") * 40 + F.col("j")).alias("id"), "i", "j"))
