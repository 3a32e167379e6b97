"""Sampling, neighbourhoods and flow on rasters held as pixels (raster_id, i, j, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.functions.geo import map_to_pixel
from penumbra.operators.regions import sun_lines
from penumbra.operators.tiles import inverse_distance_mean, median_and_deviation, on_tiles, stencils
from penumbra.store import settle


def sample_nearest(points: DataFrame, pixels: DataFrame, transform: Sequence[float], x: str, y: str, name: str, outside: float | None = 0.0, raster: str | None = None) -> DataFrame:
    """``points`` with the value of the nearest pixel (halves to even); ``outside`` where there is none.

    ``raster`` names the points' column of rasters; without it ``pixels`` are to
    hold one raster.
    """
    i, j = map_to_pixel(transform, F.col(x), F.col(y))
    at = points.withColumns({"_i": F.bround(i, 0).cast("bigint"), "_j": F.bround(j, 0).cast("bigint")})
    keys = ["_i", "_j"] if raster is None else [raster, "_i", "_j"]
    grid = pixels.select(*([] if raster is None else [F.col("raster_id").alias(raster)]), F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("value").alias(name))
    joined = at.join(grid, keys, "left").drop("_i", "_j")
    return joined if outside is None else joined.withColumn(name, F.coalesce(name, F.lit(outside)))


def _inside(k: Column, size: int, border: str) -> Column:
    """A row or column number inside the raster: clamped, or mirrored about the border pixels."""
    if border == "clamp" or size < 2:
        return F.greatest(F.least(k, F.lit(size - 1)), F.lit(0))
    period = 2 * (size - 1)
    return (size - 1) - F.abs(F.pmod(k, F.lit(period)) - (size - 1))


def sample_bilinear(points: DataFrame, pixels: DataFrame, transform: Sequence[float], shape: tuple[int, int], x: str, y: str, name: str, key: str, border: str = "clamp", raster: str | None = None) -> DataFrame:
    """``points`` with the bilinear value: each point meets its four pixels in one equi-join and sums their weights.

    ``key`` names points apart. A point with a missing pixel gets null.
    ``raster`` names the points' column of rasters; without it ``pixels`` are to
    hold one raster.
    """
    own = [] if raster is None else [raster]
    i, j = map_to_pixel(transform, F.col(x), F.col(y))
    if border == "clamp":
        i, j = F.greatest(F.least(i, F.lit(shape[0] - 1.0)), F.lit(0.0)), F.greatest(F.least(j, F.lit(shape[1] - 1.0)), F.lit(0.0))
    at = points.select(key, *own, i.alias("fi"), j.alias("fj"))
    low_i, low_j = F.floor("fi"), F.floor("fj")
    wi, wj = F.col("fi") - low_i, F.col("fj") - low_j
    corners = F.array(*(F.struct(_inside(low_i + a, shape[0], border).alias("i"), _inside(low_j + b, shape[1], border).alias("j"), ((wi if a else 1 - wi) * (wj if b else 1 - wj)).alias("w")) for a in (0, 1) for b in (0, 1)))
    needed = at.select(key, *own, F.explode(corners).alias("c")).select(key, *own, "c.i", "c.j", "c.w").filter("w > 0")
    grid = pixels.select(*(F.col("raster_id").alias(r) for r in own), "i", "j", "value")
    met = needed.join(grid, [*own, "i", "j"], "left")
    missing = F.max(F.col("value").isNull())
    values = met.groupBy(key).agg(F.when(~missing, F.sum(F.col("w") * F.col("value"))).alias(name))
    return points.join(values, key, "left")


def neighbours(pixels: DataFrame, radius: int) -> DataFrame:
    """(raster_id, i, j, di, dj, near): each pixel's valid neighbours within a square, itself included.

    Each pixel is sent to the pixels around it and joined there on (raster, i, j).
    """
    offsets = F.array(*(F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)))
    sent = pixels.filter(F.col("value").isNotNull()).withColumn("o", F.explode(offsets))
    return sent.select("raster_id", (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"), "o.di", "o.dj", F.col("value").alias("near"))


def stencil(pixels: DataFrame, kernel: dict[tuple[int, int], float], name: str) -> DataFrame:
    """Weighted sum of neighbours (correlation); null where one with a weight is missing."""
    return stencils(pixels, {name: kernel})


#: Minus the Laplacian, and optimal 3 by 3 gradients (down and right).
CURVATURE = {(0, 0): 1.0} | {(a, b): -1 / 8 for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)}
GRADIENT_DOWN = {(a, b): a * w for a in (-1, 1) for b, w in ((-1, 17 / 190), (0, 61 / 190), (1, 17 / 190))}
GRADIENT_RIGHT = {(a, b): w * b for b in (-1, 1) for a, w in ((-1, 17 / 190), (0, 61 / 190), (1, 17 / 190))}


def curvature(pixels: DataFrame) -> DataFrame:
    return stencil(pixels, CURVATURE, "curvature")


def slopes(pixels: DataFrame, spacing: float = 10.0) -> DataFrame:
    """``down`` and ``right``: gradients of elevation; ``slope`` and ``aspect`` in degrees."""
    both = stencils(pixels, {name: {k: w / spacing for k, w in kernel.items()} for name, kernel in (("down", GRADIENT_DOWN), ("right", GRADIENT_RIGHT))})
    return both.withColumns({"slope": F.degrees(F.atan(F.hypot("down", "right"))), "aspect": F.degrees(F.atan2("down", "right"))})


def shading(pixels: DataFrame, azimuth: float, zenith: float, spacing: float = 10.0, minnaert: float | None = None) -> DataFrame:
    """Lambert shading (or Minnaert's with an exponent) under a sun in degrees."""
    a, z = math.radians(azimuth), math.radians(zenith)
    sloped = slopes(pixels, spacing)
    norm = F.sqrt(1 + F.pow("down", F.lit(2)) + F.pow("right", F.lit(2)))
    light = (F.col("down") * (math.cos(a) * math.sin(z)) - F.col("right") * (math.sin(a) * math.sin(z)) + math.cos(z)) / norm
    if minnaert is not None:
        light = F.pow(F.greatest(light, F.lit(0.0)), F.lit(minnaert + 1)) * F.pow(1 / norm, F.lit(1 - minnaert))
    return sloped.withColumn("shade", light)


def shadow_cast(pixels: DataFrame, zenith: float, spacing: float = 10.0, azimuth: float = 0.0) -> DataFrame:
    """``shadow``: under the line of sight of the sun; one running maximum along each line of light.

    ``azimuth`` is the sun's, in degrees clockwise from the direction in which
    rows fall: at 0 it shines down the rows. Lines of light are a pixel wide,
    and a step along one is as long as it is on the ground.
    """
    a = math.radians(azimuth)
    fall = spacing / max(abs(math.cos(a)), abs(math.sin(a))) / math.tan(math.radians(zenith))
    raised = F.col("value") + F.col("_step") * fall
    before = Window.partitionBy("raster_id", "_line").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    return sun_lines(pixels, azimuth, "_line", "_step").withColumn("shadow", F.coalesce(F.max(raised).over(before) > raised, F.lit(False))).drop("_line", "_step")


def shadow_runs(pixels: DataFrame) -> DataFrame:
    """Runs of shadow in each column: (raster_id, j, first, last) rows, by gaps and islands."""
    line = Window.partitionBy("raster_id", "j").orderBy("i")
    island = F.col("i") - F.row_number().over(line)
    return pixels.filter("shadow").withColumn("_run", island).groupBy("raster_id", "j", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("_run")


def mask_boundary(pixels: DataFrame) -> DataFrame:
    """Set pixels (value > 0) with fewer than four set neighbours."""
    cross = F.abs("di") + F.abs("dj") == 1
    around = neighbours(pixels.filter("value > 0"), 1).filter(cross).groupBy("raster_id", "i", "j").agg(F.count("*").alias("_n"))
    return pixels.filter("value > 0").join(around, ["raster_id", "i", "j"], "left").filter(F.coalesce("_n", F.lit(0)) < 4).drop("_n")


def local_median_filter(pixels: DataFrame, radius: int, limit: float = 1.4826) -> DataFrame:
    """``inlier``: within the median plus or minus limited median deviations of the square around."""
    spread = on_tiles(pixels, None, radius, partial(median_and_deviation, radius=radius), names=("_m", "_d"))
    joined = pixels.join(spread, ["raster_id", "i", "j"], "left")
    return joined.withColumn("inlier", F.abs(F.col("value") - F.col("_m")) < F.col("_d") * limit).drop("_m", "_d")


def local_fill(pixels: DataFrame, radius: int) -> DataFrame:
    """Null pixels filled by inverse squared distance from the valid ones in the square around."""
    made = on_tiles(pixels, None, radius, partial(inverse_distance_mean, radius=radius), names=("_fill",))
    joined = pixels.join(made, ["raster_id", "i", "j"], "left")
    return joined.withColumn("value", F.coalesce("value", "_fill")).drop("_fill")


def minmax_scale(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Values from 0 to 1 within each group; a constant group is 0."""
    ranges = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = df.join(ranges, list(keys)) if keys else df.crossJoin(F.broadcast(ranges))
    return joined.withColumn(name, F.coalesce(F.try_divide(F.col(value) - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))).drop("_low", "_high")


def flow_targets(cells: DataFrame) -> DataFrame:
    """(i, j, to_i, to_j) of cells (i, j, d8) that flow: code 0 is the next column, the others follow by eighths of a turn."""
    di = F.element_at(F.array(*(F.lit(v) for v in (0, 1, 1, 1, 0, -1, -1, -1))), F.col("d8") + 1)
    dj = F.element_at(F.array(*(F.lit(v) for v in (1, 1, 0, -1, -1, -1, 0, 1))), F.col("d8") + 1)
    return cells.filter("d8 < 8").select("i", "j", (F.col("i") + di).alias("to_i"), (F.col("j") + dj).alias("to_j"))


def outlets(cells: DataFrame) -> DataFrame:
    """(i, j) of the cells whose flow leaves the raster, and of sinks."""
    flow = flow_targets(cells)
    leaving = flow.join(cells.select(F.col("i").alias("to_i"), F.col("j").alias("to_j")), ["to_i", "to_j"], "left_anti").select("i", "j")
    return leaving.unionByName(cells.filter("d8 >= 8").select("i", "j"))


def downstream(cells: DataFrame, starts: DataFrame, steps: int | None = None) -> DataFrame:
    """The cells met by following flow codes (i, j, d8) from each start (id, i, j), with the step.

    A path ends after ``steps``; without a number, at a sink, outside the raster
    or where it meets itself.
    """
    flow = flow_targets(cells)
    here = starts.select("id", "i", "j", F.lit(0).alias("step"))
    found = here
    step = 0
    while steps is None or step < steps:
        step += 1
        here = here.join(flow, ["i", "j"]).select("id", F.col("to_i").alias("i"), F.col("to_j").alias("j"), F.lit(step).alias("step"))
        if steps is None:
            here = here.join(found, ["id", "i", "j"], "left_anti")
        here = settle(here, "flow")
        if here.isEmpty():
            break
        found = found.unionByName(here)
    return found


def catchment(cells: DataFrame, ends: DataFrame) -> DataFrame:
    """All cells that flow into each of ``ends`` (id, i, j), found upstream step by step until none is new."""
    flow = settle(flow_targets(cells).select(F.col("i").alias("up_i"), F.col("j").alias("up_j"), F.col("to_i").alias("i"), F.col("to_j").alias("j")), "flow")
    found = edge = ends.select("id", "i", "j")
    while True:
        above = edge.join(flow, ["i", "j"]).select("id", F.col("up_i").alias("i"), F.col("up_j").alias("j"))
        edge = settle(above.join(found, ["id", "i", "j"], "left_anti").distinct(), "edge")
        if edge.isEmpty():
            break
        found = settle(found.unionByName(edge), "catchment")
    return found
