"""Queries that read names, metadata and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import names
from penumbra.plans.registry import register
from penumbra.plans.views import connections, CONNECTIONS, read
from penumbra.sources import conn

_NAMES = """(SELECT p_partkey AS id, 'S2A_MSIL1C_2020' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') || 'T094031_N0209_R'
 || lpad(CAST(p_partkey % 143 + 1 AS VARCHAR), 3, '0') || '_T' || lpad(CAST(p_partkey % 60 + 1 AS VARCHAR), 2, '0') || 'V' || chr(CAST(65 + p_partkey % 8 AS INTEGER)) || 'G_20200101T114517' AS name FROM part)"""


@register("parse_product_name", f"SELECT id, substr(name, 1, 3) AS platform, CAST(substr(name, 12, 8) AS BIGINT) AS datenum, CAST(substr(name, 35, 3) AS BIGINT) AS orbit, substr(name, 40, 5) AS tile, CAST(substr(name, 40, 2) AS BIGINT) + 32600 AS epsg FROM {_NAMES}")
def parse_product_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.concat(F.lit("S2A_MSIL1C_2020"), pad(k % 12 + 1, 2), pad(k % 28 + 1, 2), F.lit("T094031_N0209_R"), pad(k % 143 + 1, 3), F.lit("_T"), pad(k % 60 + 1, 2), F.lit("V"), F.char(k % 8 + 65), F.lit("G_20200101T114517"))
    parsed = read(spark, sf_dir, "part").select(k.alias("id"), names.sentinel_name(name).alias("p"))
    return parsed.select("id", "p.platform", "p.datenum", "p.orbit", "p.tile", names.tile_epsg(F.col("p.tile")).alias("epsg"))


@register("tile_code", "SELECT p_partkey AS id, upper(substr(p_brand, length(p_brand) - 1, 2) || 'abc') AS code, regexp_matches(upper(substr(p_brand, length(p_brand) - 1, 2) || 'abc'), '^[0-9]{2}[A-Z]{3}') AS valid FROM part")
def tile_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.substring("p_brand", -2, 2), F.lit("abc"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), names.tile_code(made).alias("code"), names.is_tile_code(made).alias("valid"))


@register("event_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@register("url_parts", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+/([a-z]{2})/', 1) AS folder FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+/([a-z]{2})/", 1).alias("folder"))


@register("conn_roundtrip", f"SELECT timestamp, floor(x * 100 + 5e-1) / 100 AS caster_X, floor(y * 100 + 5e-1) / 100 AS caster_Y, floor(zenith * 1000 + 5e-1) / 1000 AS zenith, caster_id FROM {CONNECTIONS}")
def conn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections written as text and read back."""
    c = connections(spark, sf_dir).select("timestamp", (F.floor(F.col("x") * 100 + 0.5) / 100).alias("caster_X"), (F.floor(F.col("y") * 100 + 0.5) / 100).alias("caster_Y"), (F.floor(F.col("zenith") * 1000 + 0.5) / 1000).alias("zenith"), "caster_id")
    return conn.read(spark, conn.write(c)).select("timestamp", "caster_X", "caster_Y", "zenith", F.col("caster_id").cast("bigint").alias("caster_id"))
