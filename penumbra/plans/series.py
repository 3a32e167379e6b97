"""Queries over time: interval overlaps, weights, mass balance, merged series, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penumbra.operators import photohypsometry
from penumbra.plans.registry import register
from penumbra.plans.views import read

_OBSERVATIONS = """(SELECT o_orderkey AS obs_id, CAST(o_orderdate AS DATE) AS t_1, CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 700 AS INTEGER) AS t_2,
 o_totalprice / 100 AS z_12, CAST(o_orderkey % 41 AS DOUBLE) / 10 - 2 AS dz_12, o_custkey % 5 AS part, o_custkey % 101 AS glacier FROM orders)"""
_STEPS = "(SELECT CAST(y AS INTEGER) AS step, make_date(y - 1, 10, 1) AS s_1, make_date(y, 9, 30) AS s_2 FROM range(1993, 2000) r(y))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("obs_id"), day.alias("t_1"), F.date_add(day, (F.col("o_orderkey") % 700 + 30).cast("int")).alias("t_2"),
        (F.col("o_totalprice") / 100).alias("z_12"), ((F.col("o_orderkey") % 41).cast("double") / 10 - 2).alias("dz_12"), (F.col("o_custkey") % 5).alias("part"), (F.col("o_custkey") % 101).alias("glacier"),
    )


def steps(spark: SparkSession) -> DataFrame:
    made = spark.createDataFrame(photohypsometry.hydrological_steps(1993, 1999), "step int, s_1 string, s_2 string")
    return made.select("step", F.to_date("s_1").alias("s_1"), F.to_date("s_2").alias("s_2"))


@register("temporal_incidence", f"""SELECT obs_id, step, round((least(t_2, s_2) - greatest(t_1, s_1)) / CAST(s_2 - s_1 AS DOUBLE), 6) AS share
 FROM {_OBSERVATIONS} JOIN {_STEPS} ON t_1 < s_2 AND t_2 > s_1""")
def temporal_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photohypsometry.temporal_incidence(observations(spark, sf_dir), steps(spark)).withColumn("share", F.round("share", 6))


@register("temporal_incidence_closed", f"SELECT obs_id, step, CAST(1 AS DOUBLE) AS share FROM {_OBSERVATIONS} JOIN {_STEPS} ON t_1 <= s_1 AND t_2 >= s_2")
def temporal_incidence_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photohypsometry.temporal_incidence(observations(spark, sf_dir), steps(spark), open_network=False)


@register("temporal_weights", f"""WITH o AS (SELECT *, t_2 - t_1 AS d FROM {_OBSERVATIONS}), r AS (SELECT *, min(d) OVER (PARTITION BY part) AS lo, max(d) OVER (PARTITION BY part) AS hi FROM o)
 SELECT obs_id, part, round(greatest(coalesce((d - lo) / nullif(CAST(hi - lo AS DOUBLE), 0), 1), 1e-1), 6) AS weight FROM r""")
def temporal_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photohypsometry.temporal_weights(observations(spark, sf_dir), ["part"]).select("obs_id", "part", F.round("weight", 6).alias("weight"))


@register("temporal_covariance", f"""WITH e AS (SELECT DISTINCT glacier, obs_id, t FROM (SELECT glacier, obs_id, t_1 AS t FROM {_OBSERVATIONS} UNION ALL SELECT glacier, obs_id, t_2 FROM {_OBSERVATIONS}))
 SELECT DISTINCT a.obs_id AS obs_1, b.obs_id AS obs_2, CAST(5e-1 AS DOUBLE) AS covariance FROM e a JOIN e b ON a.glacier = b.glacier AND a.t = b.t AND a.obs_id < b.obs_id""")
def temporal_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of one glacier that share an epoch."""
    return photohypsometry.temporal_covariance(observations(spark, sf_dir), ["glacier"])


@register("mass_balance")
def mass_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = photohypsometry.mass_balance(observations(spark, sf_dir), 1993, 1999, 1000.0)
    return out.withColumn("rate", F.round("rate", 6))


@register("mass_balance_wide")
def mass_balance_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = photohypsometry.mass_balance(observations(spark, sf_dir), 1993, 1999, 1000.0)
    return out.groupBy("elevation").pivot("year", list(range(1993, 2000))).agg(F.round(F.first("rate"), 6)).orderBy("elevation")


@register("ordered_merge", """WITH u AS (SELECT user_id, ts, value, 1 AS part FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, date_trunc('hour', ts), value, 2 FROM events WHERE event_type = 'view'),
 n AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY part, value) AS n FROM u) SELECT user_id, epoch_us(ts) AS t, value FROM n WHERE n = 1""")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series merged; of equal times the row of the first series stays."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    both = e.filter("event_type = 'click'").withColumn("part", F.lit(1)).unionByName(e.filter("event_type = 'view'").withColumns({"ts": F.date_trunc("hour", "ts"), "part": F.lit(2)}))
    first = both.groupBy("user_id", "ts").agg(F.min(F.struct("part", "value")).alias("v"))
    return first.select("user_id", F.unix_micros("ts").alias("t"), F.col("v.value").alias("value"))


@register("profile_interpolation", """WITH l AS (SELECT n_regionkey AS k, n_nationkey AS h, 280 - n_nationkey * 15e-1 AS t FROM nation), s AS (SELECT k, h, t, lead(h) OVER w AS h2, lead(t) OVER w AS t2 FROM l WINDOW w AS (PARTITION BY k ORDER BY h)),
 q AS (SELECT c_custkey AS id, c_nationkey % 5 AS k, c_custkey % 240 / 10e0 AS z FROM customer), b AS (SELECT k, min(h) AS lo, max(h) AS hi FROM l GROUP BY k), c AS (SELECT id, q.k, least(greatest(z, lo), hi) AS z FROM q JOIN b USING (k))
 SELECT id, round(t + (coalesce(t2, t) - t) * (z - h) / coalesce(h2 - h, 1), 6) AS t FROM c JOIN s ON c.k = s.k AND c.z >= s.h AND (c.z < s.h2 OR s.h2 IS NULL)""")
def profile_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures at heights from profiles of levels: each height meets its interval, ends are held."""
    levels = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("h"), (280 - F.col("n_nationkey") * 1.5).alias("t"))
    line = Window.partitionBy("k").orderBy("h")
    spans = levels.withColumns({"h2": F.lead("h").over(line), "t2": F.lead("t").over(line)})
    ends = levels.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).alias("k"), (F.col("c_custkey") % 240 / 10.0).alias("z"))
    held = wanted.join(ends, "k").withColumn("z", F.least(F.greatest("z", F.col("lo").cast("double")), F.col("hi").cast("double"))).drop("lo", "hi")
    met = held.alias("q").join(spans.alias("s"), (F.col("q.k") == F.col("s.k")) & (F.col("z") >= F.col("h")) & ((F.col("z") < F.col("h2")) | F.col("h2").isNull()))
    value = F.col("t") + (F.coalesce("t2", "t") - F.col("t")) * (F.col("z") - F.col("h")) / F.coalesce(F.col("h2") - F.col("h"), F.lit(1))
    return met.select("id", F.round(value, 6).alias("t"))
