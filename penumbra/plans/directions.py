"""Queries of directional tests and error ellipses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import directions, least_squares, ranks
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, pixels


@register("spacing_tests", f"""WITH a AS (SELECT zone, z % 360e0 AS a FROM {PIXELS}),
 r AS (SELECT zone, a, row_number() OVER w AS k, count(*) OVER (PARTITION BY zone) AS n, lead(a) OVER w AS next, first_value(a) OVER w AS low FROM a WINDOW w AS (PARTITION BY zone ORDER BY a))
 SELECT zone, max(n) AS n, round(sum(abs(coalesce(next - a, 360 - (a - low)) - 360e0 / n)) / 2, 5) AS rao, round(sqrt(max(n)) * (max(k / n - a / 360) + max(a / 360 - (k - 1) / n)), 6) AS kuiper FROM r GROUP BY zone""")
def spacing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rao's and Kuiper's tests of elevations taken as angles."""
    out = directions.spacing_tests(pixels(spark, sf_dir), ["zone"], "z")
    return out.select("zone", "n", F.round("rao", 5).alias("rao"), F.round("kuiper", 6).alias("kuiper"))


@register("share_in_ellipse", f"""WITH p AS (SELECT zone, red - 5e-1 AS x, nir - 4e-1 AS y FROM {PIXELS}),
 c AS (SELECT zone, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM p GROUP BY 1),
 d AS (SELECT zone, (x * x * yy - 2 * x * y * xy + y * y * xx) / nullif(xx * yy - xy * xy, 0) / 4 AS d FROM p JOIN c USING (zone))
 SELECT zone, count(*) AS n, round(avg(CASE WHEN d < 1 THEN 1e0 WHEN d >= 1 THEN 0e0 END), 8) AS inside FROM d GROUP BY zone""")
def share_in_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements between two bands within twice their error ellipse."""
    moved = pixels(spark, sf_dir).select("zone", (F.col("red") - 0.5).alias("x"), (F.col("nir") - 0.4).alias("y"))
    out = directions.share_in_ellipse(moved, ["zone"], "x", "y", 4.0)
    return out.select("zone", "n", F.round("inside", 8).alias("inside"))


_WHOLE_ANGLES = f"(SELECT label, CAST(floor(z) AS BIGINT) % 360 AS a FROM {PIXELS})"


@register("half_circles", f"""WITH p AS (SELECT label, a, count(*) AS m FROM {_WHOLE_ANGLES} GROUP BY ALL), n AS (SELECT label, sum(m) AS n FROM p GROUP BY label),
 h AS (SELECT p.label, p.a, sum(q.m) AS held FROM p JOIN p q ON p.label = q.label AND (q.a - p.a + 360) % 360 < 180 GROUP BY ALL),
 f AS (SELECT label, CAST(n AS BIGINT) AS n, CAST(min(least(held, n - held)) AS BIGINT) AS fewest FROM h JOIN n USING (label) GROUP BY ALL),
 w AS (SELECT *, pi() * sqrt(n) / 2 / nullif(n - 2 * fewest, 0) AS wide FROM f)
 SELECT label, n, fewest, round(CASE WHEN n = 2 * fewest THEN 1 ELSE least(1, CASE WHEN n < 50 THEN sqrt(2 * pi()) / wide * exp(-pi() * pi() / 8 / (wide * wide))
  ELSE exp((1 - n) * ln(2) + ln(n - 2 * fewest) + lgamma(n + 1) - lgamma(fewest + 1) - lgamma(n - fewest + 1)) END) END, 7) AS p FROM w""")
def half_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hodges' and Ajne's test of whole degrees."""
    angles = pixels(spark, sf_dir).select("label", (F.floor("z") % 360).alias("a"))
    return ranks.half_circles(angles, ["label"], "a").withColumn("p", F.round("p", 7))


def _ranks(value: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2e0"


@register("moore_test", f"""WITH p AS (SELECT zone, red - 5e-1 AS x, nir - 4e-1 AS y FROM {PIXELS}), l AS (SELECT *, sqrt(x * x + y * y) AS l FROM p), r AS (SELECT *, {_ranks('l', 'zone')} AS t FROM l)
 SELECT zone, count(*) AS n, round(sqrt(pow(sum(t * cos(atan2(y, x))), 2) + pow(sum(t * sin(atan2(y, x))), 2)) / pow(count(*), 15e-1), 4) AS moore FROM r GROUP BY zone""")
def moore_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements between two bands, weighed by the rank of their length."""
    moved = pixels(spark, sf_dir).select("zone", (F.col("red") - 0.5).alias("x"), (F.col("nir") - 0.4).alias("y"))
    return ranks.moore(moved, ["zone"], "x", "y").withColumn("moore", F.round("moore", 4))


@register("rank_correlation", f"WITH r AS (SELECT label, {_ranks('red', 'label')} AS a, {_ranks('nir', 'label')} AS b FROM {PIXELS}) SELECT label, count(*) AS n, round(corr(a, b), 7) AS rho FROM r GROUP BY label")
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_correlation(pixels(spark, sf_dir), ["label"], "red", "nir").withColumn("rho", F.round("rho", 7))


@register("quantiles_by_ranges", f"SELECT zone, count(z) AS n, round(quantile_cont(z, 1e-1), 5) AS low, round(quantile_cont(z, 5e-1), 5) AS middle, round(quantile_cont(z, 95e-2), 5) AS high FROM {PIXELS} GROUP BY zone")
def quantiles_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of elevation, in ordered ranges whatever the size of a zone."""
    out = ranks.quantiles(pixels(spark, sf_dir), ["zone"], "z", [0.1, 0.5, 0.95])
    return out.select("zone", "n", *(F.round(F.get("quantiles", F.lit(k)), 5).alias(name) for k, name in enumerate(("low", "middle", "high"))))


def _fit_step(k: int) -> str:
    """SQL: one step of Gauss and Newton for z = a x^b."""
    return f"""f{k + 1} AS MATERIALIZED (SELECT label, any_value(a) + (sum(r * e) * sum(s * s) - sum(s * e) * sum(r * s)) / (sum(r * r) * sum(s * s) - sum(r * s) * sum(r * s)) AS a,
 any_value(b) + (sum(r * r) * sum(s * e) - sum(r * s) * sum(r * e)) / (sum(r * r) * sum(s * s) - sum(r * s) * sum(r * s)) AS b
 FROM (SELECT label, a, b, pow(x, b) AS r, a * pow(x, b) * ln(x) AS s, z - a * pow(x, b) AS e FROM p JOIN f{k} USING (label)) GROUP BY label)"""


@register("power_law_fits", f"""WITH p AS (SELECT label, red AS x, z / 1000 AS z FROM {PIXELS}), f0 AS (SELECT label, avg(z / x) AS a, 1e0 AS b FROM p GROUP BY label), {', '.join(_fit_step(k) for k in range(10))}
 SELECT label, count(*) AS n, round(any_value(a), 2) AS a, round(any_value(b), 3) + 0e0 AS b, round(sum(pow(z - a * pow(x, b), 2)), 2) AS cost FROM p JOIN f10 USING (label) GROUP BY label""")
def power_law_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation as a power of a band, by label, in rounds of summed normal equations."""
    rows = pixels(spark, sf_dir).select("label", F.col("red").alias("x"), (F.col("z") / 1000).alias("z"))
    start = rows.groupBy("label").agg(F.array(F.avg(F.col("z") / F.col("x")), F.lit(1.0)).alias("parameters"))
    out = least_squares.fit(rows, ["label"], least_squares.power_law("x", "z"), start)
    return out.select("label", "n", F.round(F.get("parameters", F.lit(0)), 2).alias("a"), (F.round(F.get("parameters", F.lit(1)), 3) + 0.0).alias("b"), F.round("cost", 2).alias("cost"))
