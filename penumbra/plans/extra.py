"""Further queries: histograms, lines, gradients, boxes, bands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penumbra.operators import statistics
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, pixels, posts, posts_sql
from penumbra.sources import bands, vectors


@register("histogram_valleys", f"""WITH h AS (SELECT zone, CAST(floor(z / 2000e0) AS BIGINT) AS bin, count(*) AS n FROM {PIXELS} GROUP BY 1, 2),
 l AS (SELECT *, lag(n, 1) OVER w AS p1, lag(n, 2) OVER w AS p2, lead(n, 1) OVER w AS n1, lead(n, 2) OVER w AS n2 FROM h WINDOW w AS (PARTITION BY zone ORDER BY bin))
 SELECT zone, bin, n FROM l WHERE n < p1 AND n < p2 AND n < n1 AND n < n2""")
def histogram_valleys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with fewer values than the two bins on either side."""
    h = statistics.histogram(pixels(spark, sf_dir), ["zone"], "z", 2000.0)
    line = Window.partitionBy("zone").orderBy("bin")
    around = [F.lag("n", k).over(line) for k in (1, 2)] + [F.lead("n", k).over(line) for k in (1, 2)]
    marked = h.withColumns({f"_{k}": c for k, c in enumerate(around)})
    low = F.lit(True)
    for k in range(4):
        low &= F.col("n") < F.col(f"_{k}")
    return marked.filter(low).select("zone", "bin", "n")


@register("hough_votes", f"""SELECT t AS theta, CAST(floor((x * cos(radians(t * 5e0)) + y * sin(radians(t * 5e0))) / 20) AS BIGINT) AS rho, count(*) AS votes FROM {posts_sql('customer')}, range(36) r(t) GROUP BY 1, 2""")
def hough_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of each post for the lines through it, by direction (5 degrees) and distance (20)."""
    angles = F.array(*(F.struct(F.lit(t).cast("bigint").alias("theta"), F.lit(math.cos(math.radians(t * 5.0))).alias("c"), F.lit(math.sin(math.radians(t * 5.0))).alias("s")) for t in range(36)))
    voted = posts(spark, sf_dir, "customer").withColumn("a", F.explode(angles))
    rho = F.floor((F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s")) / 20)
    return voted.groupBy(F.col("a.theta").alias("theta"), rho.alias("rho")).agg(F.count("*").alias("votes"))


@register("lucas_kanade", f"""WITH s AS (SELECT zone, sum(blue * blue) AS xx, sum(blue * green) AS xy, sum(green * green) AS yy, sum(blue * dz) AS xt, sum(green * dz) AS yt FROM {PIXELS} GROUP BY 1)
 SELECT zone, round((xy * yt - yy * xt) / (xx * yy - xy * xy), 6) AS u, round((xy * xt - xx * yt) / (xx * yy - xy * xy), 6) AS v FROM s""")
def lucas_kanade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement of each zone from its sums of gradient products."""
    b, g, t = (F.col(c) for c in ("blue", "green", "dz"))
    s = pixels(spark, sf_dir).groupBy("zone").agg(F.sum(b * b).alias("xx"), F.sum(b * g).alias("xy"), F.sum(g * g).alias("yy"), F.sum(b * t).alias("xt"), F.sum(g * t).alias("yt"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    u, v = F.col("xy") * F.col("yt") - F.col("yy") * F.col("xt"), F.col("xy") * F.col("xt") - F.col("xx") * F.col("yt")
    return s.select("zone", F.round(F.try_divide(u, det), 6).alias("u"), F.round(F.try_divide(v, det), 6).alias("v"))


@register("band_covariance", f"SELECT zone, {', '.join(f'round(covar_samp({a}, {b}), 8) AS {a}_{b}' for a, b in (('blue', 'green'), ('blue', 'red'), ('green', 'red'), ('red', 'nir')))}, round(var_samp(nir), 8) AS nir_nir FROM {PIXELS} GROUP BY zone")
def band_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (("blue", "green"), ("blue", "red"), ("green", "red"), ("red", "nir"))
    return pixels(spark, sf_dir).groupBy("zone").agg(*(F.round(F.covar_samp(a, b), 8).alias(f"{a}_{b}") for a, b in pairs), F.round(F.var_samp("nir"), 8).alias("nir_nir"))


_BOXES = "(SELECT id, x AS west, x + 4 + id % 5 AS east, y AS south, y + 3 + id % 7 AS north FROM {0})"


@register("boxes_overlap", f"SELECT a.id AS id_1, b.id AS id_2 FROM {_BOXES.format(posts_sql('supplier'))} a JOIN {_BOXES.format(posts_sql('customer'))} b ON a.west < b.east AND b.west < a.east AND a.south < b.north AND b.south < a.north")
def boxes_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    def boxes(name: str) -> DataFrame:
        k = F.col("id")
        return posts(spark, sf_dir, name).select("id", F.col("x").alias("west"), (F.col("x") + 4 + k % 5).alias("east"), F.col("y").alias("south"), (F.col("y") + 3 + k % 7).alias("north"))

    return vectors.boxes_overlap(boxes("supplier"), boxes("customer"), 10.0)


@register("band_table", "SELECT * FROM (VALUES ('blue', 'B02', 492e-3, 'B2', 482e-3), ('cirrus', 'B10', 1374e-3, 'B9', 1373e-3), ('coastal', 'B01', 443e-3, 'B1', 443e-3), ('green', 'B03', 56e-2, 'B3', 561e-3), ('nir08', 'B8A', 865e-3, 'B5', 865e-3), ('red', 'B04', 665e-3, 'B4', 655e-3), ('swir16', 'B11', 1614e-3, 'B6', 1609e-3), ('swir22', 'B12', 2202e-3, 'B7', 2201e-3)) t(common_name, band_1, wavelength_1, band_2, wavelength_2)")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of two sensors with a common name."""
    a, b = bands.table(spark, bands.SENTINEL_2).alias("a"), bands.table(spark, bands.LANDSAT_8).alias("b")
    return a.join(b, "common_name").select("common_name", F.col("a.band").alias("band_1"), F.col("a.wavelength").alias("wavelength_1"), F.col("b.band").alias("band_2"), F.col("b.wavelength").alias("wavelength_2"))
