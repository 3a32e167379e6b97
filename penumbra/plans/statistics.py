"""Queries of zonal statistics, filters, tests and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import rasters, statistics, zonal
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, pixels, read


@register("zonal_stats", f"SELECT label, round(median(z), 4) AS median, max(z) AS high, min(z) AS low, count(*) AS n FROM {PIXELS} GROUP BY label")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.zonal(pixels(spark, sf_dir), "label", "z", {"median": F.round(F.median("z"), 4), "high": F.max("z"), "low": F.min("z")})


@register("zonal_matrix", f"SELECT label, {', '.join(f'round(coalesce(median(dz) FILTER (zone = {k}), 0), 6) AS z{k}' for k in range(11))} FROM {PIXELS} GROUP BY label")
def zonal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = zonal.zonal_matrix(pixels(spark, sf_dir), "label", "zone", "dz", list(range(11)))
    return wide.select("label", *(F.round(str(k), 6).alias(f"z{k}") for k in range(11)))


@register("general_hypsometry", f"SELECT CAST(floor(z / 5000) * 5000 AS DOUBLE) AS bin, round(median(dz), 6) AS median, count(*) AS n FROM {PIXELS} GROUP BY 1")
def general_hypsometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zonal.general_hypsometry(pixels(spark, sf_dir), "z", "dz", 5000.0)
    return out.select(F.col("bin").cast("double").alias("bin"), F.round("median", 6).alias("median"), "n")


@register("hypsometric_index", f"SELECT label, round((max(z) - median(z)) / nullif(median(z) - min(z), 0), 6) AS index, count(*) AS n FROM {PIXELS} GROUP BY label")
def hypsometric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.hypsometric_index(pixels(spark, sf_dir), "label", "z").withColumn("index", F.round("index", 6))


@register("kurowsky_altitude", f"SELECT label, round((max(z) + min(z)) / 2, 6) AS kurowsky, count(*) AS n FROM {PIXELS} GROUP BY label")
def kurowsky_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.kurowsky_altitude(pixels(spark, sf_dir), "label", "z").withColumn("kurowsky", F.round("kurowsky", 6))


@register("midpoint_altitude", f"SELECT label, round(quantile_cont(z, 5e-1), 4) AS midpoint, count(*) AS n FROM {PIXELS} GROUP BY label")
def midpoint_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.midpoint_altitude(pixels(spark, sf_dir), "label", "z").withColumn("midpoint", F.round("midpoint", 4))


@register("normalized_hypsometry", f"""WITH p AS {PIXELS}, r AS (SELECT *, min(z) OVER (PARTITION BY label) AS lo, max(z) OVER (PARTITION BY label) AS hi FROM p),
 b AS (SELECT label, CAST(floor((z - lo) / nullif(hi - lo, 0) * 19) AS BIGINT) AS bin, dz FROM r), m AS (SELECT label, bin, median(dz) AS m FROM b WHERE bin IS NOT NULL GROUP BY 1, 2)
 SELECT bin, round(avg(m), 6) AS mean, count(*) AS labels FROM m GROUP BY bin""")
def normalized_hypsometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.normalized_hypsometry(pixels(spark, sf_dir), "label", "z", "dz").withColumn("mean", F.round("mean", 6))


@register("ice_mass", """SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, round(l_discount * l_quantity * CASE WHEN l_extendedprice > 20000 + abs(s_acctbal) * 2 THEN 300 ELSE 900 END, 4) AS mass
 FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def ice_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), (F.abs("s_acctbal") * 2 + 20000).alias("ela"))
    return zonal.ice_mass(pixels(spark, sf_dir), lines, "label", "dz", "z").select("i", "j", F.round("mass", 4).alias("mass"))


@register("glacier_hypsometry_rank", f"""WITH c AS (SELECT label, CAST(floor(least(greatest(z, 10000e0), 90000e0) / 20000) AS BIGINT) AS bin, median(dz) AS m, count(*) AS n FROM {PIXELS} GROUP BY 1, 2),
 t AS (SELECT label, sum(n) AS total FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, label) AS place FROM t)
 SELECT label, bin, round(m, 6) AS median, n, CAST(total AS BIGINT) AS total, place FROM c JOIN r USING (label)""")
def glacier_hypsometry_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zonal.specific_hypsometries(pixels(spark, sf_dir), "label", "z", "dz", 20000.0, 10000.0, 90000.0)
    return out.select("label", "bin", F.round("median", 6).alias("median"), "n", "total", F.col("place").cast("bigint").alias("place"))


@register("void_fill_line", f"WITH p AS {PIXELS} SELECT round(regr_intercept(dz, z), 8) AS c0, round(regr_slope(dz, z) * 1e6, 8) AS c1 FROM p")
def void_fill_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    c0, c1 = zonal.polynomial_fill(pixels(spark, sf_dir), "z", "dz", 1)
    return spark.range(1).select(F.round(F.lit(c0), 8).alias("c0"), F.round(F.lit(c1 * 1e6), 8).alias("c1"))


_MEASURES = "WITH p AS (SELECT i, j, label, z, red FROM " + PIXELS + ")"


@register("sigma_filter", _MEASURES + ", s AS (SELECT label, avg(z) AS m, stddev_pop(z) AS s FROM p GROUP BY 1) SELECT i, j, label, abs(z - m) < s * 15e-1 AS inlier FROM p JOIN s USING (label)")
def sigma_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sigma_filter(pixels(spark, sf_dir), ["label"], "z", 1.5).select("i", "j", "label", "inlier")


@register("weighted_sigma_filter", _MEASURES + """, m AS (SELECT label, sum(red * z) / sum(red) AS m FROM p GROUP BY 1), s AS (SELECT label, any_value(m) AS m, sqrt(sum(red * pow(z - m, 2)) / sum(red)) AS s FROM p JOIN m USING (label) GROUP BY 1)
 SELECT i, j, label, abs(z - m) < s * 15e-1 AS inlier FROM p JOIN s USING (label)""")
def weighted_sigma_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.weighted_sigma_filter(pixels(spark, sf_dir), ["label"], "z", "red", 1.5).select("i", "j", "label", "inlier")


@register("mad_filter", _MEASURES + """, m AS (SELECT label, median(z) AS m FROM p GROUP BY 1), d AS (SELECT label, any_value(m) AS m, median(abs(z - m)) AS d FROM p JOIN m USING (label) GROUP BY 1)
 SELECT i, j, label, z > m - d * 14826e-4 AND z < m + d * 14826e-4 AS inlier FROM p JOIN d USING (label)""")
def mad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.mad_filter(pixels(spark, sf_dir), ["label"], "z").select("i", "j", "label", "inlier")


@register("standardized", _MEASURES + """, s AS (SELECT label, avg(z) AS a, stddev_pop(z) AS s, median(z) AS m FROM p GROUP BY 1), d AS (SELECT label, median(abs(z - m)) AS d FROM p JOIN s USING (label) GROUP BY 1)
 SELECT i, j, label, round((z - a) / nullif(s, 0), 6) AS score, round((z - m) / nullif(d, 0), 6) AS robust FROM p JOIN s USING (label) JOIN d USING (label)""")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = statistics.standardize(pixels(spark, sf_dir), ["label"], "z").withColumnRenamed("score", "plain")
    both = statistics.standardize(plain, ["label"], "z", robust=True)
    return both.select("i", "j", "label", F.round("plain", 6).alias("score"), F.round("score", 6).alias("robust"))


@register("robust_weights", f"SELECT i, j, round(1 / greatest(1e0, abs(dz) / 1345e-3), 6) AS huber, round(1 / (1 + pow(dz / 2385e-3, 2)), 6) AS cauchy FROM {PIXELS}")
def robust_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("i", "j", F.round(statistics.huber_weight(F.col("dz")), 6).alias("huber"), F.round(statistics.cauchy_weight(F.col("dz")), 6).alias("cauchy"))


@register("prefix_tests", """WITH e AS (SELECT event_id, user_id, value, avg(value) OVER u AS ma, avg(value) OVER b AS mb, var_pop(value) OVER u AS va, var_pop(value) OVER b AS vb, count(value) OVER u AS n FROM events
 WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT event_id, round((ma - mb) / nullif(sqrt(va / n), 0), 5) AS t, round(vb / nullif(va, 0), 5) AS f FROM e""")
def prefix_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.prefix_tests(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("event_id", F.round("t", 5).alias("t"), F.round("f", 5).alias("f"))


@register("steady_state", """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT user_id, n, value AS x, 0e0 AS v, 0e0 AS d, value AS last FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.n, e.value * 2e-1 + r.x * 8e-1, pow(e.value - r.x, 2) * 1e-1 + r.v * 9e-1, pow(e.value - r.last, 2) * 1e-1 + r.d * 9e-1, e.value FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, round(arg_max(v, n) * 18e-1 / nullif(arg_max(d, n), 0), 5) AS ratio FROM r GROUP BY user_id""")
def steady_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steady-state ratio of each user's events, in chunks that are put together."""
    out = statistics.steady_states(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return out.select("user_id", F.round("ratio", 5).alias("ratio"))


@register("minmax_scale", f"SELECT i, j, round((z - min(z) OVER w) / nullif(max(z) OVER w - min(z) OVER w, 0), 8) AS gray FROM {PIXELS} WINDOW w AS (PARTITION BY label)")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.minmax_scale(pixels(spark, sf_dir), ["label"], "z", "gray").select("i", "j", F.round("gray", 8).alias("gray"))


_BINS = f"WITH h AS (SELECT zone, CAST(floor(z / 5000e0) AS BIGINT) AS bin, count(*) AS n FROM {PIXELS} GROUP BY 1, 2)"


@register("cumulative_histogram", _BINS + " SELECT zone, bin, n, round(n / sum(n) OVER (PARTITION BY zone), 6) AS share, round(sum(n) OVER (PARTITION BY zone ORDER BY bin) / sum(n) OVER (PARTITION BY zone), 6) AS cumulative FROM h")
def cumulative_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.histogram(pixels(spark, sf_dir), ["zone"], "z", 5000.0)
    return out.select("zone", "bin", "n", F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"))


@register("histogram_equalized", f"SELECT i, j, zone, round(cume_dist() OVER (PARTITION BY zone ORDER BY z), 6) AS equal FROM {PIXELS}")
def histogram_equalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value's share of values up to it; distinct values are counted first, so only they are sorted."""
    from pyspark.sql import Window

    p = pixels(spark, sf_dir)
    counts = p.groupBy("zone", "z").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("zone")
    upto = F.sum("n").over(whole.orderBy("z").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)
    return p.join(counts.select("zone", "z", upto.alias("equal")), ["zone", "z"]).select("i", "j", "zone", F.round("equal", 6).alias("equal"))


@register("entropy_hist", _BINS + ", s AS (SELECT zone, n / sum(n) OVER (PARTITION BY zone) AS p FROM h) SELECT zone, round(sum(-p * ln(p)), 6) AS entropy FROM s GROUP BY zone")
def entropy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.entropy(pixels(spark, sf_dir), ["zone"], "z", 5000.0).withColumn("entropy", F.round("entropy", 6))


@register("directional_tests", f"""WITH a AS (SELECT zone, count(*) AS n, sum(cos(radians(z))) AS c, sum(sin(radians(z))) AS s FROM {PIXELS} GROUP BY 1)
 SELECT zone, n, round(sqrt(c * c + s * s) / n, 5) AS resultant, round(degrees(atan2(s, c)), 2) AS direction, round(n * pow(sqrt(c * c + s * s) / n, 2), 3) AS rayleigh, round(sqrt(c * c + s * s) / n * cos(atan2(s, c) - radians(90)) * sqrt(2 * n), 3) AS v_test FROM a""")
def directional_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.directional_statistics(pixels(spark, sf_dir), ["zone"], "z", 90.0)
    return out.select("zone", "n", F.round("resultant", 5).alias("resultant"), F.round("direction", 2).alias("direction"), F.round("rayleigh", 3).alias("rayleigh"), F.round("v_test", 3).alias("v_test"))


@register("line_fit", f"SELECT zone, round(regr_slope(dz, z) * 1e6, 6) AS slope, round(regr_intercept(dz, z), 6) AS intercept, round(corr(dz, z), 6) AS corr, count(*) AS n FROM {PIXELS} GROUP BY zone")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.normal_sums(pixels(spark, sf_dir), ["zone"], "z", "dz")
    return out.select("zone", F.round(F.col("slope") * 1e6, 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("corr", 6).alias("corr"), "n")


@register("psnr", f"SELECT zone, round(20 * log10(255 / sqrt(avg(pow(red * 255 - nir * 255, 2)))), 6) AS psnr, round(sum(pow(red - nir, 2)), 4) AS ssd FROM {PIXELS} GROUP BY zone")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.pow(F.col("red") - F.col("nir"), F.lit(2))
    wide = F.pow(F.col("red") * 255 - F.col("nir") * 255, F.lit(2))
    return pixels(spark, sf_dir).groupBy("zone").agg(F.round(F.log10(F.lit(255) / F.sqrt(F.avg(wide))) * 20, 6).alias("psnr"), F.round(F.sum(square), 4).alias("ssd"))
