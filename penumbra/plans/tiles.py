"""Queries on whole grids: rasterised polygons, regions, filters on tiles and Fourier transforms.

The grid has a pixel for each part, 40 to a row, without a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import fourier, polygons, rasters, regions, tiles
from penumbra.plans.registry import register
from penumbra.plans.views import read

COLS = 40
GRID = f"(SELECT 'grid' AS raster_id, CAST(p_partkey // {COLS} AS BIGINT) AS i, CAST(p_partkey % {COLS} AS BIGINT) AS j, p_retailprice / 1000e0 AS value, CAST(p_size AS BIGINT) AS size FROM part)"
_ROWS = f"(SELECT max(i) + 1 FROM {GRID})"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.lit("grid").alias("raster_id"), F.floor(at / COLS).alias("i"), (at % COLS).alias("j"), (F.col("p_retailprice") / 1000.0).alias("value"), F.col("p_size").cast("bigint").alias("size"))


def shape_of(pixels: DataFrame) -> tuple[int, int]:
    return pixels.agg(F.max("i")).first()[0] + 1, COLS


# polygons: eight-cornered stars around a place of each supplier
_CORNERS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
_SIDE = 64


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of suppliers with a square hole in the middle of every third; place and value are the key."""
    key = F.col("s_suppkey")
    x0, y0 = key * 17 % 61 + 0.37, key * 29 % 53 + 0.41
    ring = F.array(*(F.struct((x0 + a * (key * (k + 3) % 7 + 1.3)).alias("x"), (y0 + b * (key * (k + 3) % 7 + 1.3)).alias("y")) for k, (a, b) in enumerate(_CORNERS)))
    hole = F.array(*(F.struct((x0 + a * 0.9).alias("x"), (y0 + b * 0.9).alias("y")) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))))
    return read(spark, sf_dir, "supplier").select(key.alias("place"), key.alias("value"), F.when(key % 3 == 0, F.array(ring, hole)).otherwise(F.array(ring)).alias("rings"))


_STAR_EDGES = f"""WITH corners AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(_CORNERS))}) c(k, a, b)),
 holes AS (SELECT * FROM (VALUES (0, 1, 1), (1, 1, -1), (2, -1, -1), (3, -1, 1)) h(k, a, b)),
 points AS (SELECT s_suppkey AS place, 0 AS ring, k, 8 AS n, (s_suppkey * 17) % 61 + 37e-2 + a * ((s_suppkey * (k + 3)) % 7 + 13e-1) AS x, (s_suppkey * 29) % 53 + 41e-2 + b * ((s_suppkey * (k + 3)) % 7 + 13e-1) AS y FROM supplier, corners
  UNION ALL SELECT s_suppkey, 1, k, 4, (s_suppkey * 17) % 61 + 37e-2 + a * 9e-1, (s_suppkey * 29) % 53 + 41e-2 + b * 9e-1 FROM supplier, holes WHERE s_suppkey % 3 = 0),
 edges AS (SELECT p.place, p.x AS x1, {_SIDE} - p.y AS i1, q.x AS x2, {_SIDE} - q.y AS i2 FROM points p JOIN points q ON p.place = q.place AND p.ring = q.ring AND q.k = (p.k + 1) % p.n),
 cells AS (SELECT a.i, b.j FROM range({_SIDE}) a(i), range({_SIDE}) b(j)),
 held AS (SELECT i, j, place FROM cells JOIN edges ON (i1 - 5e-1 > i) <> (i2 - 5e-1 > i) AND j < x1 - 5e-1 + (i - (i1 - 5e-1)) * (x2 - x1) / (i2 - i1) GROUP BY ALL HAVING count(*) % 2 = 1)"""


@register("polygon_raster", _STAR_EDGES + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, max(place) AS value FROM held GROUP BY ALL")
def polygon_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars as a raster, the last supplier on top."""
    return polygons.rasterise(stars(spark, sf_dir), (0.0, 1.0, 0.0, float(_SIDE), 0.0, -1.0), (_SIDE, _SIDE))


@register("polygon_areas", _STAR_EDGES + " SELECT place, count(*) AS n, CAST(min(j) AS BIGINT) AS west, CAST(max(j) AS BIGINT) AS east FROM held GROUP BY place")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each star, those under others counted."""
    runs = polygons.spans(stars(spark, sf_dir), (0.0, 1.0, 0.0, float(_SIDE), 0.0, -1.0), (_SIDE, _SIDE))
    return runs.groupBy("place").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"), F.min("first").alias("west"), F.max("last").alias("east"))


@register("polygons_meeting", _STAR_EDGES + """, outer_edges AS (SELECT p.place, p.k, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM points p JOIN points q ON p.place = q.place AND p.ring = 0 AND q.ring = 0 AND q.k = (p.k + 1) % p.n),
 starts AS (SELECT place, x1 AS x, y1 AS y FROM outer_edges WHERE k = 0),
 crossing AS (SELECT DISTINCT a.place AS id_1, b.place AS id_2 FROM outer_edges a JOIN outer_edges b ON a.place < b.place
  WHERE sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  AND sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0),
 holding AS (SELECT e.place AS holder, s.place AS held FROM outer_edges e JOIN starts s ON e.place <> s.place AND (e.y1 > s.y) <> (e.y2 > s.y) AND s.x < e.x1 + (s.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) GROUP BY ALL HAVING count(*) % 2 = 1)
 SELECT id_1, id_2, 'crosses' AS relation FROM crossing
 UNION ALL SELECT least(holder, held), greatest(holder, held), CASE WHEN bool_or(holder < held) THEN 'holds' ELSE 'within' END FROM holding h WHERE NOT EXISTS (SELECT 1 FROM crossing WHERE id_1 = least(holder, held) AND id_2 = greatest(holder, held)) GROUP BY ALL""")
def polygons_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stars, without their holes, that share area."""
    rings = stars(spark, sf_dir).select(F.col("place").alias("id"), F.get("rings", F.lit(0)).alias("ring"))
    return polygons.meeting(rings, rings, 8.0).filter("id_1 < id_2")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in three classes, the lowest not marked."""
    return grid(spark, sf_dir).withColumn("value", F.floor(F.col("size") / 17))


_CLASSES = f"(SELECT raster_id, i, j, size // 17 AS value FROM {GRID})"
_REGIONS = f"""WITH RECURSIVE marked AS MATERIALIZED (SELECT i, j, value, i * 4294967296 + j AS code FROM {_CLASSES} WHERE value <> 0),
 edges AS MATERIALIZED (SELECT a.code AS u, b.code AS v FROM marked a JOIN marked b ON a.value = b.value AND a.i - b.i BETWEEN -1 AND 1 AND a.j - b.j BETWEEN -1 AND 1),
 reached AS (SELECT u AS node, v AS seen FROM edges UNION SELECT r.node, e.v FROM reached r JOIN edges e ON r.seen = e.u),
 named AS MATERIALIZED (SELECT node, min(seen) AS region FROM reached GROUP BY node),
 labelled AS MATERIALIZED (SELECT i, j, value, region FROM marked JOIN named ON node = code)"""


@register("label_regions", _REGIONS + " SELECT i, j, CAST(value AS BIGINT) AS value, region FROM labelled")
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of equal class that touch, corners included, on small tiles."""
    return regions.regions(_classes(spark, sf_dir), neighbours=8, side=16).drop("raster_id")


#: The sun's azimuth; SQL has the slope of its lines as a number.
_AZIMUTH, _SLOPE = 30.0, -0.5773502691896257


@register("casters_and_casted", _REGIONS + f""", lined AS (SELECT *, CAST(floor(j - i * {_SLOPE}e0 + 5e-1 + 1e-9) AS BIGINT) AS line FROM labelled),
 runs AS (SELECT *, i - row_number() OVER (PARTITION BY region, line ORDER BY i) AS run FROM lined)
 SELECT region, min(i) AS caster_i, arg_min(j, i) AS caster_j, max(i) AS casted_i, arg_max(j, i) AS casted_j, max(i) - min(i) AS length FROM runs GROUP BY region, line, run""")
def casters_and_casted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of each run of a region along the light."""
    labelled = regions.regions(_classes(spark, sf_dir), neighbours=8, side=16)
    return regions.casters_and_casted(labelled, _AZIMUTH).drop("raster_id")


def _mirrored(k: str, size: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN -1 - ({k}) WHEN {k} >= {size} THEN 2 * {size} - 1 - ({k}) ELSE {k} END)"


def _near(source: str, radius: int) -> str:
    """SQL: each pixel (i, j) with what lies (a, b) from it in the mirrored image."""
    return f"""(SELECT c.i, c.j, a, b, v.value FROM {source} c, range(-{radius}, {radius + 1}) x(a), range(-{radius}, {radius + 1}) y(b)
 JOIN {source} v ON v.i = {_mirrored('c.i + a', _ROWS)} AND v.j = {_mirrored('c.j + b', str(COLS))})"""


@register("kuwahara", f"""WITH g AS MATERIALIZED (SELECT i, j, value + size * 37e-2 AS value FROM {GRID}), near AS {_near('g', 2)},
 blocks AS (SELECT i, j, q, var_pop(value) AS spread, avg(value) AS mean FROM near, (VALUES (0, -1, -1), (1, 1, -1), (2, -1, 1), (3, 1, 1)) q(q, sa, sb) WHERE a * sa >= 0 AND b * sb >= 0 GROUP BY ALL)
 SELECT i, j, round(arg_min(mean, round(spread, 12) * 10 + q * 1e-13), 6) AS value FROM blocks GROUP BY ALL""")
def kuwahara(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and sizes together, of which no two blocks vary alike."""
    g = grid(spark, sf_dir).withColumn("value", F.col("value") + F.col("size") * 0.37)
    return tiles.kuwahara_filter(g, shape_of(g), 5, side=16).select("i", "j", F.round("value", 6).alias("value"))


@register("repeated_median", f"""WITH g AS MATERIALIZED (SELECT i, j, value FROM {GRID}),
 once AS MATERIALIZED (SELECT i, j, median(value) AS value FROM {_near('g', 1)} GROUP BY ALL), twice AS MATERIALIZED (SELECT i, j, median(value) AS value FROM {_near('once', 1)} GROUP BY ALL)
 SELECT i, j, median(value) AS value FROM {_near('twice', 1)} GROUP BY ALL""")
def repeated_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three medians of nine, for which tiles meet once."""
    g = grid(spark, sf_dir)
    return tiles.median_filter(g, shape_of(g), 3, 3, side=16).select("i", "j", "value")


def _diffused(source: str) -> str:
    sides = [f"{f}(value) OVER (PARTITION BY {p} ORDER BY {o}) - value AS {n}" for n, f, p, o in (("d0", "lag", "j", "i"), ("d1", "lead", "j", "i"), ("d2", "lag", "i", "j"), ("d3", "lead", "i", "j"))]
    flow = " + ".join(f"d{k} * exp(-(d{k} / 2e-1) * (d{k} / 2e-1))" for k in range(4))
    return f"(SELECT i, j, value + coalesce(25e-2 * ({flow}), 0) AS value FROM (SELECT i, j, value, {', '.join(sides)} FROM {source}))"


@register("diffusion", f"WITH g AS (SELECT i, j, value FROM {GRID}), a AS {_diffused('g')}, b AS {_diffused('a')}, c AS {_diffused('b')} SELECT i, j, round(value, 7) AS value FROM c")
def diffusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of diffusion, for which tiles meet once."""
    g = grid(spark, sf_dir)
    return tiles.diffusion_filter(g, shape_of(g), steps=3, noise=0.2, side=16).select("i", "j", F.round("value", 7).alias("value"))


@register("plane_misfit", f"""WITH g AS MATERIALIZED (SELECT i, j, value FROM {GRID}),
 sums AS (SELECT i, j, regr_slope(value, a) AS sa, regr_slope(value, b) AS sb, avg(value) AS m FROM {_near('g', 2)} GROUP BY ALL)
 SELECT i, j, round(sqrt(avg(pow(value - m - sa * a - sb * b, 2))), 7) AS value FROM {_near('g', 2)} JOIN sums USING (i, j) GROUP BY ALL""")
def plane_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return tiles.plane_misfit(g, shape_of(g), 5, side=16).select("i", "j", F.round("value", 7).alias("value"))


def _dft(source: str, values: str, sign: int, scale: str = "1") -> str:
    """SQL: the transform of complex columns (re_k, im_k) of cells (a, b)."""
    turn = f"(2 * pi() * ((a * u) % {_ROWS} / {_ROWS} + (b * v) % {COLS} / {COLS}e0))"
    sums = ", ".join(f"sum(re_{k} * cos(t) - im_{k} * sin(t)) / {scale} AS re_{k}, sum(re_{k} * sin(t) + im_{k} * cos(t)) / {scale} AS im_{k}" for k in values)
    return f"""(SELECT u, v, {sums} FROM (SELECT *, {sign} * {turn} AS t FROM {source}, (SELECT i AS u, j AS v FROM {GRID})) GROUP BY u, v)"""


_SPECTRUM = f"WITH s AS MATERIALIZED {_dft(f'(SELECT i AS a, j AS b, value AS re_0, 0e0 AS im_0 FROM {GRID})', '0', -1)}"


@register("raster_spectrum", _SPECTRUM + " SELECT u, v, round(re_0, 5) + 0e0 AS re, round(im_0, 5) + 0e0 AS im FROM s")
def raster_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fourier.spectrum(g, shape_of(g)).select("u", "v", *((F.round(c, 5) + 0.0).alias(c) for c in ("re", "im")))


_FLOW = f"(SELECT i AS a, j AS b, value AS re_0, 0e0 AS im_0, size / 50e0 AS re_1, 0e0 AS im_1 FROM {GRID})"


def _signed(k: str, size: str) -> str:
    return f"((CASE WHEN 2 * {k} < {size} THEN {k} WHEN 2 * {k} > {size} THEN {k} - {size} ELSE 0 END) / CAST({size} AS DOUBLE))"


@register("flow_parts", f"""WITH s AS MATERIALIZED {_dft(_FLOW, '01', -1)}, w AS (SELECT *, {_signed('v', str(COLS))} AS wx, {_signed('u', _ROWS)} AS wy FROM s),
 d AS (SELECT *, coalesce((wx * re_0 + wy * re_1) / nullif(wx * wx + wy * wy, 0), 0) AS re, coalesce((wx * im_0 + wy * im_1) / nullif(wx * wx + wy * wy, 0), 0) AS im FROM w),
 p AS MATERIALIZED (SELECT u AS a, v AS b, wx * re AS re_0, wx * im AS im_0, wy * re AS re_1, wy * im AS im_1 FROM d),
 back AS {_dft('p', '01', 1, f'({_ROWS} * {COLS})')}
 SELECT i, j, round(value - re_0, 6) + 0e0 AS turning_x, round(size / 50e0 - re_1, 6) + 0e0 AS turning_y, round(re_0, 6) + 0e0 AS spreading_x, round(re_1, 6) + 0e0 AS spreading_y FROM back JOIN {GRID} ON u = i AND v = j""")
def flow_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and sizes taken as a field: its parts without sources and without turn."""
    g = grid(spark, sf_dir)
    out = fourier.flow_parts(g.withColumn("dy", F.col("size") / 50.0), shape_of(g), "value", "dy")
    return out.select("i", "j", *((F.round(c, 6) + 0.0).alias(c) for c in ("turning_x", "turning_y", "spreading_x", "spreading_y")))


@register("periodic_parts", f"""WITH g AS MATERIALIZED (SELECT i, j, value FROM {GRID}),
 jumps AS (SELECT i AS a, j AS b, sum(d) AS re_0, 0e0 AS im_0 FROM (
  SELECT p.i, p.j, q.value - p.value AS d FROM g p JOIN g q ON p.j = q.j AND p.i + q.i = {_ROWS} - 1 AND (p.i = 0 OR q.i = 0)
  UNION ALL SELECT p.i, p.j, q.value - p.value FROM g p JOIN g q ON p.i = q.i AND p.j + q.j = {COLS - 1} AND (p.j = 0 OR q.j = 0)) GROUP BY i, j),
 s AS MATERIALIZED {_dft('jumps', '0', -1)},
 d AS (SELECT *, CASE WHEN u = 0 AND v = 0 THEN 0e0 ELSE 1 / (2 * cos(2 * pi() * u / {_ROWS}) + 2 * cos(2 * pi() * v / {COLS}) - 4) END AS w FROM s),
 back AS {_dft('(SELECT u AS a, v AS b, re_0 * w AS re_0, im_0 * w AS im_0 FROM d)', '0', 1, f'({_ROWS} * {COLS})')}
 SELECT i, j, round(value - re_0, 6) + 0e0 AS periodic, round(re_0, 6) + 0e0 AS smooth FROM back JOIN g ON u = i AND v = j""")
def periodic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return fourier.periodic_parts(g, shape_of(g)).select("i", "j", *((F.round(c, 6) + 0.0).alias(c) for c in ("periodic", "smooth")))


@register("surface_of_shading", _SPECTRUM + f""", w AS (SELECT u AS a, v AS b, re_0, im_0, {_signed('v', str(COLS))} * 2 * pi() * cos(radians(40e0)) * sin(radians(50e0)) + {_signed('u', _ROWS)} * 2 * pi() * sin(radians(40e0)) * sin(radians(50e0)) AS slope FROM s),
 d AS (SELECT a, b, CASE WHEN abs(slope) > 1e-12 THEN im_0 / slope ELSE 0 END AS re_0, CASE WHEN abs(slope) > 1e-12 THEN -re_0 / slope ELSE 0 END AS im_0 FROM w),
 back AS {_dft('d', '0', 1, f'({_ROWS} * {COLS})')} SELECT u AS i, v AS j, round(re_0, 5) + 0e0 AS value FROM back""")
def surface_of_shading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of prices taken as shading."""
    g = grid(spark, sf_dir)
    return fourier.surface_of_shading(g, shape_of(g), 40.0, 50.0).select("i", "j", (F.round("value", 5) + 0.0).alias("value"))


@register("shadows_along_light", f"""WITH lined AS (SELECT *, CAST(floor(j - i * {_SLOPE}e0 + 5e-1 + 1e-9) AS BIGINT) AS line, value * 1000 + i * (10 / cos(radians(30e0)) / tan(radians(80e0))) AS raised FROM {GRID})
 SELECT i, j, coalesce(max(raised) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > raised, false) AS shadow FROM lined""")
def shadows_along_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices taken as heights under a low sun that shines across rows and columns."""
    heights = grid(spark, sf_dir).select("raster_id", "i", "j", (F.col("value") * 1000).alias("value"))
    return rasters.shadow_cast(heights, 80.0, azimuth=_AZIMUTH).select("i", "j", "shadow")
