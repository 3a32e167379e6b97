"""Queries that pair posts, epochs and shadows; the flagship is among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import pairing, photohypsometry
from penumbra.plans.registry import register
from penumbra.plans.views import CONNECTIONS, connections, posts, posts_sql, read

_PAIRS = f"""WITH c AS (SELECT * FROM {CONNECTIONS} WHERE caster_id <> 0), m AS (SELECT *, avg(x) OVER (PARTITION BY caster_id) AS cx, avg(y) OVER (PARTITION BY caster_id) AS cy,
 row_number() OVER (PARTITION BY caster_id ORDER BY timestamp, row_id) AS n FROM c),
 p AS (SELECT a.caster_id, a.row_id AS row_1, b.row_id AS row_2, a.x AS x_1, b.x AS x_2, a.glacier_id AS g_1, b.glacier_id AS g_2, a.timestamp AS t_1, b.timestamp AS t_2,
 sqrt((a.x - a.cx) * (a.x - a.cx) + (a.y - a.cy) * (a.y - a.cy)) / tan(radians(a.zenith)) - sqrt((b.x - a.cx) * (b.x - a.cx) + (b.y - a.cy) * (b.y - a.cy)) / tan(radians(b.zenith)) AS dh
 FROM m a JOIN m b ON a.caster_id = b.caster_id AND a.n < b.n)"""


def casted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shadows = connections(spark, sf_dir).transform(photohypsometry.with_caster).transform(photohypsometry.with_mean_caster)
    return photohypsometry.casted_differences(shadows, ("timestamp", "row_id"), ("row_id", "x", "timestamp", "glacier_id"))


@register("hypsometric_change", _PAIRS + """ SELECT g_1 AS glacier_id, CAST(floor((x_1 + x_2) / 2 / 100) AS BIGINT) AS bin, count(*) AS n, round(median(dh), 4) AS dh
 FROM p WHERE g_1 = g_2 GROUP BY 1, 2""")
def hypsometric_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: shadows of a caster in time order, all pairs, elevation differences, and their median by glacier and bin."""
    pairs = casted_pairs(spark, sf_dir).transform(photohypsometry.same_glacier)
    binned = pairs.withColumn("bin", F.floor((F.col("x_1") + F.col("x_2")) / 2 / 100).cast("bigint"))
    return binned.groupBy(F.col("glacier_id_1").alias("glacier_id"), "bin").agg(F.count("*").alias("n"), F.round(F.median("dh"), 4).alias("dh"))


@register("casted_elevation_difference", _PAIRS + " SELECT caster_id, row_1, row_2, round(dh, 5) AS dh FROM p")
def casted_elevation_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casted_pairs(spark, sf_dir).select("caster_id", F.col("row_id_1").alias("row_1"), F.col("row_id_2").alias("row_2"), F.round("dh", 5).alias("dh"))


@register("hypsometric_elevation_change", _PAIRS + " SELECT row_1, row_2, round((x_1 + x_2) / 2, 7) AS z_12, round(dh - (x_1 - x_2), 7) AS dz_12 FROM p")
def hypsometric_elevation_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = photohypsometry.hypsometric_change(casted_pairs(spark, sf_dir), F.col("x_1"), F.col("x_2"))
    return changed.select(F.col("row_id_1").alias("row_1"), F.col("row_id_2").alias("row_2"), F.round("z_12", 7).alias("z_12"), F.round("dz_12", 7).alias("dz_12"))


@register("time_pairing", """SELECT a.user_id, a.event_id AS id_1, b.event_id AS id_2, epoch_us(a.ts) - epoch_us(b.ts) AS dt FROM events a JOIN events b ON a.user_id = b.user_id
 AND epoch_us(a.ts) - epoch_us(b.ts) > 300000 AND epoch_us(a.ts) - epoch_us(b.ts) < 3600000000""")
def time_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return pairing.time_pairs(events, ["user_id"], "event_id", "t", 300_000, 3_600_000_000)


_NEAR = """WITH a AS {left}, b AS {right}, p AS (SELECT a.id AS id_1, b.id AS id_2, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM a JOIN b
 ON abs(a.x - b.x) < {r} AND abs(a.y - b.y) < {r} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {r} * {r})"""


@register("nearest_post", _NEAR.format(left=posts_sql("supplier"), right=posts_sql("customer"), r="50e0") + """
 SELECT id_1, id_2, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id_2 ORDER BY d2, id_1) AS n FROM p) WHERE n = 1""")
def nearest_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.nearest(posts(spark, sf_dir, "supplier"), posts(spark, sf_dir, "customer"), 50.0)
    return found.select("id_1", "id_2", F.round("distance", 6).alias("distance"))


_GRAPH = _NEAR.format(left=posts_sql("customer"), right=posts_sql("customer"), r="20e0") + ", k AS (SELECT *, row_number() OVER (PARTITION BY id_1 ORDER BY d2, id_2) AS n FROM p WHERE id_1 <> id_2)"


@register("knn_graph", _GRAPH + " SELECT id_1, id_2, n AS place FROM k WHERE n <= 4")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.neighbour_graph(posts(spark, sf_dir, "customer"), 4, 20.0).withColumn("place", F.col("place").cast("bigint"))


@register("knn_graph_undirected", _GRAPH + " SELECT DISTINCT least(id_1, id_2) AS id_1, greatest(id_1, id_2) AS id_2 FROM k WHERE n <= 4")
def knn_graph_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.neighbour_graph(posts(spark, sf_dir, "customer"), 4, 20.0, directed=False)


@register("greedy_pairing")
def greedy_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairing.one_to_one(posts(spark, sf_dir, "supplier"), posts(spark, sf_dir, "customer"), 2500.0)
    return found.select("id_1", "id_2", F.round("distance", 6).alias("distance"))


@register("all_pairs", "SELECT a.n_regionkey, a.n_nationkey AS n_nationkey_1, b.n_nationkey AS n_nationkey_2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.ordered_pairs(read(spark, sf_dir, "nation"), "n_regionkey", ["n_nationkey"], ["n_nationkey"])


@register("incidence_coo", "SELECT o_orderkey AS edge_id, o_custkey AS node, 1 AS value FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 97, -1 FROM orders")
def incidence_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 97).alias("dst"))
    return pairing.incidence(edges)


@register("caster_id_assign", f"SELECT row_id, dense_rank() OVER (ORDER BY floor(x / 10), floor(y / 10)) AS caster_id FROM {CONNECTIONS}")
def caster_id_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connections(spark, sf_dir).select("row_id", F.floor(F.col("x") / 10).alias("cell_x"), F.floor(F.col("y") / 10).alias("cell_y"))
    return pairing.caster_ids(c, "cell_x", "cell_y").select("row_id", "caster_id")


@register("split_by_orbit", f"SELECT row_id, dense_rank() OVER (ORDER BY caster_id, orbit_id) AS split_id FROM {CONNECTIONS}")
def split_by_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.split_by_orbit(connections(spark, sf_dir), "caster_id", "orbit_id").select("row_id", "split_id")


@register("merge_common_id", f"""WITH c AS {CONNECTIONS} SELECT row_id, caster_id FROM c WHERE row_id % 2 = 0
 UNION ALL SELECT row_id, CASE WHEN caster_id % 3 = 0 THEN caster_id + 1 ELSE caster_id END FROM c WHERE row_id % 2 = 1""")
def merge_common_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connections(spark, sf_dir).select("row_id", "caster_id")
    pairs = c.filter("caster_id % 3 = 0").select((F.col("caster_id") + 1).alias("id_1"), F.col("caster_id").alias("id_2")).distinct()
    return pairing.merge_by_caster(c.filter("row_id % 2 = 0"), c.filter("row_id % 2 = 1"), pairs, "caster_id")


@register("clean_no_caster", f"SELECT row_id, caster_id FROM (SELECT row_id, caster_id % 7 AS caster_id FROM {CONNECTIONS}) WHERE caster_id <> 0")
def clean_no_caster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return photohypsometry.with_caster(connections(spark, sf_dir).select("row_id", (F.col("caster_id") % 7).alias("caster_id")))


@register("keep_refined", f"SELECT row_id, x, fine FROM (SELECT row_id, x, CASE WHEN row_id % 3 = 0 THEN NULL WHEN row_id % 3 = 1 THEN x ELSE x + 1 END AS fine FROM {CONNECTIONS}) WHERE fine IS NULL OR fine <> x")
def keep_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.when(F.col("row_id") % 3 == 0, None).when(F.col("row_id") % 3 == 1, F.col("x")).otherwise(F.col("x") + 1)
    return photohypsometry.refined(connections(spark, sf_dir).select("row_id", "x").withColumn("fine", fine), "x", "fine")


@register("common_glacier", _PAIRS + " SELECT row_1, row_2, g_1 FROM p WHERE (row_1 % 4) = (row_2 % 4)")
def common_glacier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = casted_pairs(spark, sf_dir).withColumns({"g_1": F.col("row_id_1") % 4, "g_2": F.col("row_id_2") % 4})
    kept = photohypsometry.same_glacier(pairs, "g")
    return kept.select(F.col("row_id_1").alias("row_1"), F.col("row_id_2").alias("row_2"), F.col("glacier_id_1").alias("g_1"))
