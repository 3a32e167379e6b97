"""Queries on templates cut from the grid, and on templates of embeddings with masks and phase planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from penumbra.operators import phase_planes
from penumbra.operators import templates as cut
from penumbra.plans.matching import templates as embedding_pairs
from penumbra.plans.registry import register
from penumbra.plans.tiles import COLS, GRID, grid, shape_of
from penumbra.plans.views import read

_POSTS = f"(SELECT s_suppkey AS id, (s_suppkey * 7) % {{rows}} AS i, (s_suppkey * 11) % {COLS} AS j FROM supplier)"
_ROWS = f"(SELECT max(i) + 1 FROM {GRID})"


def posts(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.lit("grid").alias("raster_id"), key.alias("id"), (key * 7 % rows).alias("i"), (key * 11 % COLS).alias("j"))


@register("templates_at_posts", f"""SELECT id, round(sum(value * (3 * (g.i - p.i) + g.j - p.j)), 6) + 0e0 AS moment, round(max(value), 6) AS most FROM {_POSTS.format(rows=_ROWS)} p
 JOIN {GRID} g ON g.i BETWEEN p.i - 2 AND p.i + 2 AND g.j BETWEEN p.j - 2 AND p.j + 2 GROUP BY id HAVING count(*) = 25""")
def templates_at_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of the templates of five by five around suppliers, across small tiles."""
    g = grid(spark, sf_dir)
    found = cut.templates_at(posts(spark, sf_dir, shape_of(g)[0]), g, shape_of(g), 2, side=16).filter("template IS NOT NULL")
    place = F.transform("template", lambda v, k: v * (3 * (F.floor(k / 5) - 2) + (k % 5 - 2)))
    return found.select("id", (F.round(F.aggregate(place, F.lit(0.0), lambda t, v: t + v), 6) + 0.0).alias("moment"), F.round(F.array_max("template"), 6).alias("most"))


@register("moves_of_posts", f"""SELECT id, -2e0 AS di, 3e0 AS dj FROM {_POSTS.format(rows=_ROWS)} WHERE i BETWEEN 9 AND {_ROWS} - 10 AND i - 2 >= 7 AND j BETWEEN 7 AND {COLS} - 8 AND j + 3 < {COLS} - 7""")
def moves_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts in sizes that moved two rows up and three columns right; the second match takes the phases left over."""
    g = grid(spark, sf_dir).withColumn("value", F.col("size") / 50.0)
    rows, columns = shape = shape_of(g)
    moved = g.withColumns({"i": F.pmod(F.col("i") - 2, F.lit(rows)), "j": F.pmod(F.col("j") + 3, F.lit(columns))})
    placed = posts(spark, sf_dir, rows).filter(F.col("i").between(9, rows - 10) & F.col("j").between(7, columns - 8))
    out = cut.match_posts(placed, g, moved, shape, 7, side=16)
    return out.select("id", *((F.round(c, 3) + 0.0).alias(c) for c in ("di", "dj")))


_PAIRS = "WITH p AS MATERIALIZED (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)"


@register("masked_moves", _PAIRS + """, q AS (SELECT vec_id, k // 8 AS i, k % 8 AS j, CASE WHEN a[k + 1] > -2e-1 THEN CAST(a[k + 1] AS DOUBLE) END AS x, CASE WHEN b[k + 1] < 2e-1 THEN CAST(b[k + 1] AS DOUBLE) END AS y FROM p, range(64) r(k) WHERE b IS NOT NULL AND len(a) = 64),
 held AS (SELECT vec_id, least(count(x), count(y)) AS held FROM q GROUP BY vec_id),
 lags AS (SELECT p.vec_id, q.i - p.i AS di, q.j - p.j AS dj, count(*) AS overlap, corr(p.x, q.y) AS score FROM q p JOIN q ON p.vec_id = q.vec_id WHERE p.x IS NOT NULL AND q.y IS NOT NULL GROUP BY ALL)
 SELECT vec_id, arg_max(di, score) AS di, arg_max(dj, score) AS dj, round(max(score), 6) AS score, arg_max(overlap, score) AS overlap FROM lags JOIN held USING (vec_id) WHERE overlap >= greatest(2, held / 2e0) GROUP BY vec_id""")
def masked_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between embeddings as templates of eight by eight, low and high values masked."""
    pairs = embedding_pairs(spark, sf_dir).filter("size(a) = 64")
    masked = pairs.select("vec_id", F.transform("a", lambda x: F.when(x > -0.2, x)).alias("template_1"), F.transform("b", lambda x: F.when(x < 0.2, x)).alias("template_2"))
    return cut.match_masked(masked, "vec_id").withColumn("score", F.round("score", 6))


def _spectrum(values: str) -> str:
    turn = f"-2 * pi() * (((k // 8) * u + (k % 8) * v) % 8) / 8e0"
    return f"(SELECT vec_id, u, v, sum({values}[k + 1] * cos({turn})) AS re, sum({values}[k + 1] * sin({turn})) AS im FROM p, range(64) r(k), range(8) x(u), range(8) y(v) WHERE b IS NOT NULL AND len(a) = 64 GROUP BY ALL)"


@register("phase_planes", _PAIRS + f""", s AS {_spectrum('a')}, t AS {_spectrum('b')},
 c AS (SELECT vec_id, (CASE WHEN u >= 4 THEN u - 8 ELSE u END) / 8e0 AS fi, (CASE WHEN v >= 4 THEN v - 8 ELSE v END) / 8e0 AS fj, s.re * t.re + s.im * t.im AS re, s.re * t.im - s.im * t.re AS im FROM s JOIN t USING (vec_id, u, v)),
 w AS (SELECT vec_id, fi, fj, -atan2(im, re) / (2 * pi()) AS p, pow(re * re + im * im, 25e-2) AS w FROM c WHERE sqrt(fi * fi + fj * fj) < 25e-2 AND (fi <> 0 OR fj <> 0)),
 m AS (SELECT vec_id, sum(w * fi * fi) AS ii, sum(w * fi * fj) AS ij, sum(w * fj * fj) AS jj, sum(w * fi * p) AS ip, sum(w * fj * p) AS jp FROM w GROUP BY vec_id)
 SELECT vec_id, round((ip * jj - jp * ij) / (ii * jj - ij * ij), 5) + 0e0 AS di, round((jp * ii - ip * ij) / (ii * jj - ij * ij), 5) + 0e0 AS dj FROM m""")
def phase_plane_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes through the phases of pairs of embeddings, from sums over their spectra."""
    pairs = embedding_pairs(spark, sf_dir).filter("size(a) = 64").select("vec_id", F.col("a").alias("template_1"), F.col("b").alias("template_2"))
    points = phase_planes.phase_points(pairs, "vec_id", tapered=False)
    return phase_planes.least_squares_planes(points, ["vec_id"]).select("vec_id", *((F.round(c, 5) + 0.0).alias(c) for c in ("di", "dj")))


@register("phase_plane_methods")
def phase_plane_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method on embeddings and the same moved by a known part of a pixel: the largest error of each."""
    # dealt out before templates are moved and fitted: they have few bytes and much work
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = read(spark, sf_dir, "embeddings").filter("size(embedding) = 64 AND vec_id IS NOT NULL").select("vec_id", "embedding").repartition(parts, "vec_id", "embedding")
    e = e.select("vec_id", F.col("embedding").cast("array<double>").alias("template_1"))
    move = (F.col("vec_id") % 7 / 10.0 - 0.3, F.col("vec_id") % 5 / 10.0 - 0.2)
    pairs = e.select("vec_id", "template_1", _moved(F.col("template_1"), *move).alias("template_2"))
    off = F.greatest(F.abs(F.col("di") - move[0]), F.abs(F.col("dj") - move[1]))
    found = phase_planes.fit_all_planes(pairs, "vec_id", tapered=False).select("method", off.alias("off"))
    worst = found.groupBy("method").agg(F.count("*").alias("n"), F.percentile("off", F.lit(0.5)).alias("median_error"))
    every = spark.createDataFrame([(name,) for name in phase_planes.METHODS], "method string")
    return every.join(worst, "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"), F.round("median_error", 4).alias("median_error"))


@F.pandas_udf(ArrayType(DoubleType()))
def _moved(template, di, dj):
    """Square templates moved round their borders by a part of a pixel, by their spectrum."""
    import numpy as np
    import pandas as pd

    made = []
    for t, a, b in zip(template, di, dj, strict=True):
        side = int(np.sqrt(len(t)))
        shifted = np.fft.fft2(np.asarray(t, float).reshape(side, side)) * phase_planes.plane((a, b), (side, side))
        made.append(np.real(np.fft.ifft2(shifted)).ravel())
    return pd.Series(made)
