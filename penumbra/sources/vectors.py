"""Polygons from GeoJSON, and joins of points and boxes with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOJSON = (
    "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
)


def read_geojson(spark: SparkSession, path: str, name: str = "Name") -> DataFrame:
    """(name, part, ring: array of (lon, lat)) of the outer rings of all polygons; features of one name are its parts."""
    features = spark.read.schema(_GEOJSON).json(path, multiLine=True).select(F.posexplode("features").alias("part", "f"))
    polygons = features.filter("f.geometry.type = 'Polygon'")
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return polygons.select(F.col("f.properties")[name].alias("name"), "part", ring.alias("ring"))


def with_box(polygons: DataFrame) -> DataFrame:
    """Polygons with the limits of their ring."""
    lon, lat = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    return polygons.withColumns({"west": F.array_min(lon), "east": F.array_max(lon), "south": F.array_min(lat), "north": F.array_max(lat)})


def holds(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether the ring holds the place: a ray to the east crosses it an odd number of times."""

    def crosses(p: Column, k: Column) -> Column:
        q = F.get(ring, F.when(k == 0, F.size(ring) - 1).otherwise(k - 1))
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        return F.when(spans & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / (q["lat"] - p["lat"]) + p["lon"]), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1


def _cells(west: Column, east: Column, south: Column, north: Column, size: float) -> Column:
    x = F.sequence(F.floor(west / size), F.floor(east / size))
    y = F.sequence(F.floor(south / size), F.floor(north / size))
    return F.flatten(F.transform(x, lambda i: F.transform(y, lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def locate(points: DataFrame, polygons: DataFrame, lon: str = "lon", lat: str = "lat", size: float = 1.0) -> DataFrame:
    """``points`` with the name of each polygon that holds them; points meet only polygons of their grid cell."""
    tiled = with_box(polygons).withColumn("c", F.explode(_cells(F.col("west"), F.col("east"), F.col("south"), F.col("north"), size))).select("name", "ring", "c.cx", "c.cy")
    placed = points.withColumns({"cx": F.floor(F.col(lon) / size), "cy": F.floor(F.col(lat) / size)})
    met = placed.join(tiled, ["cx", "cy"]).filter(holds(F.col("ring"), F.col(lon), F.col(lat)))
    return met.select(*points.columns, "name").distinct()


def boxes_overlap(first: DataFrame, second: DataFrame, size: float = 1.0) -> DataFrame:
    """(id_1, id_2) of boxes (id, west, east, south, north) that share area.

    Each pair of boxes comes once, from the grid cell where their overlap
    begins, so no task keeps pairs to make them distinct.
    """
    cells = _cells(F.col("west"), F.col("east"), F.col("south"), F.col("north"), size)
    tiled = [df.withColumn("c", F.explode(cells)).select("*", "c.cx", "c.cy").alias(k) for df, k in ((first, "a"), (second, "b"))]
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    area = (F.col("a.west") < F.col("b.east")) & (F.col("b.west") < F.col("a.east")) & (F.col("a.south") < F.col("b.north")) & (F.col("b.south") < F.col("a.north"))
    begins = (F.col("a.cx") == F.floor(F.greatest("a.west", "b.west") / size)) & (F.col("a.cy") == F.floor(F.greatest("a.south", "b.south") / size))
    return tiled[0].join(tiled[1], same & area & begins).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))


def well_known_text(ring: str = "ring") -> Column:
    """The ring as well-known text."""
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", F.transform(ring, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))), F.lit("))"))
