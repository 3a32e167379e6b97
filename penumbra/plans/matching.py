"""Queries on templates: similarities as array expressions, and displacement by correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import matching
from penumbra.plans.registry import register
from penumbra.plans.views import read


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding with the next of its label, in order of id."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    line = Window.partitionBy("label").orderBy("vec_id")
    return e.withColumns({"id_2": F.lead("vec_id").over(line), "b": F.lead("a").over(line)}).filter("id_2 IS NOT NULL")


_PAIRS = """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
 p AS (SELECT vec_id, a, lead(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e), q AS (SELECT * FROM p WHERE b IS NOT NULL)"""


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@register("template_similarity", _PAIRS + """ SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 5) AS ssd,
 round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 5) AS sad,
 round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 5) AS cosine FROM q""")
def template_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    difference = F.zip_with("a", "b", lambda x, y: x - y)
    total = lambda arr, f: F.aggregate(F.transform(arr, f), F.lit(0.0), lambda s, x: s + x)
    cosine = _dot(F.col("a"), F.col("b")) / F.sqrt(_dot(F.col("a"), F.col("a")) * _dot(F.col("b"), F.col("b")))
    return t.select("vec_id", F.round(total(difference, lambda x: x * x), 5).alias("ssd"), F.round(total(difference, F.abs), 5).alias("sad"), F.round(cosine, 5).alias("cosine"))


@register("template_ncc", _PAIRS + """, m AS (SELECT vec_id, a, b, list_avg(a) AS ma, list_avg(b) AS mb FROM q)
 SELECT vec_id, round(list_sum(list_transform(list_zip(list_transform(a, lambda x: x - ma), list_transform(b, lambda x: x - mb)), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(a, lambda x: (x - ma) * (x - ma))) * list_sum(list_transform(b, lambda x: (x - mb) * (x - mb)))), 5) AS ncc FROM m""")
def template_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    t = templates(spark, sf_dir).withColumns({"ma": mean(F.col("a")), "mb": mean(F.col("b"))})
    t = t.withColumns({"a": F.transform("a", lambda x: x - F.col("ma")), "b": F.transform("b", lambda x: x - F.col("mb"))})
    return t.select("vec_id", F.round(_dot(F.col("a"), F.col("b")) / F.sqrt(_dot(F.col("a"), F.col("a")) * _dot(F.col("b"), F.col("b"))), 5).alias("ncc"))


@register("peak_metrics", """WITH e AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), r AS (SELECT vec_id, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS n FROM e)
 SELECT vec_id, round(max(x) FILTER (n = 1) / max(x) FILTER (n = 2), 5) AS ratio, round(max(x) FILTER (n = 1) - max(x) FILTER (n = 2), 6) AS margin, round(pow(max(x), 2) / sum(x * x), 6) AS energy, round(max(x) / sqrt(avg(x * x)), 5) AS rms FROM r GROUP BY vec_id""")
def peak_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    ordered = e.withColumn("s", F.sort_array("a", asc=False))
    top, second, squares = F.get("s", F.lit(0)), F.get("s", F.lit(1)), F.aggregate("s", F.lit(0.0), lambda t, x: t + x * x)
    return ordered.select("vec_id", F.round(top / second, 5).alias("ratio"), F.round(top - second, 6).alias("margin"), F.round(top * top / squares, 6).alias("energy"), F.round(top / F.sqrt(squares / F.size("s")), 5).alias("rms"))


@register("match_kernel")
def match_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = templates(spark, sf_dir)
    side = F.floor(F.sqrt(F.size("a"))).cast("int")
    squares = t.select("vec_id", F.slice("a", F.lit(1), side * side).alias("template_1"), F.slice("b", F.lit(1), side * side).alias("template_2"))
    out = matching.match(squares, "vec_id", "phas_only", "moment")
    return out.select("vec_id", *(F.round(c, 5).alias(c) for c in ("di", "dj", "peak", "ratio")))
