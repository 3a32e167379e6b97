"""Regions of equal value in rasters, and what lies at either end of them along the sun.

Tiles are labelled one by one, each in a task of its own; only labels that meet
across the border of two tiles are then linked, and components of those links
name the regions. A region is named by its least pixel, row before column.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators.tiles import SIDE
from penumbra.store import settle

#: Steps to the neighbours that follow a pixel, by their number.
_FOLLOWING = {4: ((0, 1), (1, 0)), 8: ((0, 1), (1, -1), (1, 0), (1, 1))}
#: A pixel's code is its row times this, and its column.
_ROW = 1 << 32


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of the nodes in ``links``, of any type that has an order; the component is the least node.

    Large stars and small stars in turn: each node's neighbours are linked to the
    least of them, until only stars are left. The rounds grow as the logarithm of
    the components' size, and each one writes a table.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def to_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        return pairs.join(least, "u").select("u", "v", "m")

    edges = settle(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both)
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(large.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = to_least(large)
        edges = settle(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tile_labels(values: np.ndarray, neighbours: int) -> np.ndarray:
    """The least flat index of the region of each cell; cells of 0 have none (-1)."""
    rows, columns = values.shape
    label = np.arange(values.size)
    pairs = []
    for a, b in _FOLLOWING[neighbours]:
        one = (slice(0, rows - a), slice(max(0, -b), columns - max(0, b)))
        two = (slice(a, rows), slice(max(0, b), columns - max(0, -b)))
        same = (values[one] == values[two]) & (values[one] != 0)
        grid = label.reshape(rows, columns)
        pairs.append((grid[one][same], grid[two][same]))
    first, second = (np.concatenate(x) for x in zip(*pairs, strict=True))
    while True:
        a, b = label[first], label[second]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label != label[label]).any():
            label = label[label]
        first, second = first[apart], second[apart]
    return np.where(values.ravel() != 0, label, -1).reshape(rows, columns)


def _label_tile(rows: pd.DataFrame, side: int, neighbours: int) -> pd.DataFrame:
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    top, left = i.min() // side * side, j.min() // side * side
    values = np.zeros((side, side), np.int64)
    values[i - top, j - left] = rows["value"].to_numpy()
    label = tile_labels(values, neighbours)[i - top, j - left]
    keep = label >= 0
    code = (label // side + top) * _ROW + label % side + left
    return pd.DataFrame({"raster_id": rows["raster_id"][keep], "i": i[keep], "j": j[keep], "value": rows["value"][keep], "part": code[keep]})


def regions(pixels: DataFrame, neighbours: int = 8, side: int = SIDE) -> DataFrame:
    """(raster_id, i, j, value, region) of the pixels of a value other than 0 and null.

    Pixels of one value that touch (along sides, or at corners too with 8
    ``neighbours``) share a region: row * 2^32 + column of their first pixel.
    Regions are numbered within their raster.
    """
    kind = dict(pixels.dtypes)["raster_id"]
    marked = pixels.select("raster_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("value").cast("bigint").alias("value")).filter("value <> 0")
    tiled = marked.groupBy("raster_id", F.floor(F.col("i") / side), F.floor(F.col("j") / side))
    labelled = settle(tiled.applyInPandas(lambda rows: _label_tile(rows, side, neighbours), f"raster_id {kind}, i bigint, j bigint, value bigint, part bigint"), "labels")

    at_edge = " OR ".join(f"{k} % {side} IN (0, {side - 1})" for k in "ij")
    edge = labelled.filter(at_edge)
    steps = F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in _FOLLOWING[neighbours])))
    sent = edge.withColumn("to", steps).filter(f"floor(i / {side}) <> floor(to.i / {side}) OR floor(j / {side}) <> floor(to.j / {side})")
    sent = sent.select("raster_id", F.col("to.i").alias("i"), F.col("to.j").alias("j"), "value", F.col("part").alias("other"))
    node = [F.struct("raster_id", F.col(c).alias("part")).alias(n) for c, n in (("part", "u"), ("other", "v"))]
    found = components(edge.join(sent, ["raster_id", "i", "j", "value"]).select(*node))
    named = found.select(F.col("node.raster_id").alias("raster_id"), F.col("node.part").alias("part"), F.col("component.part").alias("whole"))
    joined = labelled.join(named, ["raster_id", "part"], "left")
    return joined.select("raster_id", "i", "j", "value", F.coalesce("whole", "part").alias("region"))


def sun_lines(pixels: DataFrame, azimuth: float, line: str = "line", step: str = "step") -> DataFrame:
    """``pixels`` with ``line`` and ``step`` (or the names given): which line of light a pixel lies on and how far along, away from the sun.

    ``azimuth`` is the sun's, in degrees clockwise from the direction in which
    rows fall. Lines are one pixel wide across the axis that light follows more.
    """
    away_i, away_j = math.cos(math.radians(azimuth)), -math.sin(math.radians(azimuth))
    if abs(away_i) >= abs(away_j):
        along, across, slope, sign = "i", "j", away_j / away_i, 1 if away_i > 0 else -1
    else:
        along, across, slope, sign = "j", "i", away_i / away_j, 1 if away_j > 0 else -1
    number = F.floor(F.col(across) - F.col(along) * slope + 0.5 + 1e-9).cast("bigint")
    return pixels.withColumns({line: number, step: (F.col(along) * sign).cast("bigint")})


def casters_and_casted(labelled: DataFrame, azimuth: float) -> DataFrame:
    """(raster_id, region, caster_i, caster_j, casted_i, casted_j, length) of each run of a region along the light.

    The caster is the run's pixel nearest to the sun, the casted its last;
    ``length`` counts the steps between them. Runs are islands of their line, so
    no task sees a whole region.
    """
    lined = sun_lines(labelled, azimuth)
    order = Window.partitionBy("raster_id", "region", "line").orderBy("step")
    runs = lined.withColumn("run", F.col("step") - F.row_number().over(order))
    place = F.struct("step", "i", "j")
    ends = runs.groupBy("raster_id", "region", "line", "run").agg(F.min(place).alias("caster"), F.max(place).alias("casted"))
    return ends.select(
        "raster_id", "region", F.col("caster.i").alias("caster_i"), F.col("caster.j").alias("caster_j"), F.col("casted.i").alias("casted_i"), F.col("casted.j").alias("casted_j"),
        (F.col("casted.step") - F.col("caster.step")).alias("length"),
    )
