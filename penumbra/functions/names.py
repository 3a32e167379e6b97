"""Product names, tile codes and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = r"^(S2[A-D])_MSI(L1C|L2A)_(\d{8})T(\d{6})_N(\d{4})_R(\d{3})_T(\d{2}[A-Z]{3})_"
LANDSAT = r"^L([COTEM])(\d{2})_(L\w{3})_(\d{3})(\d{3})_(\d{8})_(\d{8})_(\d{2})_(\w{2})"


def sentinel_name(name: Column) -> Column:
    """Struct of platform, level, datenum, baseline, orbit and tile; fields of other names are null or empty."""
    part = lambda k: F.regexp_extract(name, SENTINEL, k)
    number = lambda k: part(k).try_cast("bigint")
    return F.struct(part(1).alias("platform"), part(2).alias("level"), number(3).alias("datenum"), number(5).alias("baseline"), number(6).alias("orbit"), part(7).alias("tile"))


def landsat_name(name: Column) -> Column:
    """Struct of sensor, platform, level, path, row and datenum."""
    part = lambda k: F.regexp_extract(name, LANDSAT, k)
    number = lambda k: part(k).try_cast("bigint")
    return F.struct(part(1).alias("sensor"), number(2).alias("platform"), part(3).alias("level"), number(4).alias("path"), number(5).alias("row"), number(6).alias("datenum"))


def tile_code(code: Column) -> Column:
    return F.upper(code)


def is_tile_code(code: Column) -> Column:
    return F.upper(code).rlike("^[0-9]{2}[A-Z]{3}")


def tile_epsg(tile: Column) -> Column:
    """EPSG number of a tile's UTM zone; bands from N on are northern."""
    return F.substring(tile, 1, 2).try_cast("bigint") + F.when(F.substring(tile, 3, 1) >= "N", 32600).otherwise(32700)


def elevation_tile_url(lat: Column, lon: Column, base: str, resolution: str = "10") -> Column:
    """Address of the one-degree elevation tile at a place."""
    side = lambda v, plus, minus: F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(F.floor(v)).cast("string"), 2 if plus == "N" else 3, "0"), F.lit("_00"))
    name = F.concat(F.lit(f"Copernicus_DSM_COG_{resolution}_"), side(lat, "N", "S"), F.lit("_"), side(lon, "E", "W"), F.lit("_DEM"))
    return F.concat(F.lit(f"{base.rstrip('/')}/"), name, F.lit("/"), name, F.lit(".tif"))
