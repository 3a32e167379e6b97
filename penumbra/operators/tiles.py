"""Rasters in tiles that carry a margin of their neighbours.

A pixel (raster_id, i, j, value) goes to its own tile and to those whose margin
it lies in: one shuffle, after which a task has all that a filter of that reach
needs. A filter of many steps takes a margin as wide as all its steps, so the
tiles meet once for as many steps as their size allows.

At the raster's own border the image is mirrored, border pixels included. All
rasters of a table have the given shape. Missing and null pixels are NaN inside
a tile, and a filter's NaN is null afterwards.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from functools import partial

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.store import settle

#: Pixels along the side of a tile.
SIDE = 256


def with_tiles(pixels: DataFrame, shape: tuple[int, int] | None, side: int, margin: int) -> DataFrame:
    """A row of (raster_id, ti, tj, i, j, value) for each tile that needs the pixel; without a shape, tiles go on beyond the raster."""
    if not 0 <= margin <= side:
        raise ValueError("a margin reaches no further than the next tile")

    def near(k: str, size: int | None):
        own, inside = F.floor(F.col(k) / side), F.pmod(F.col(k), F.lit(side))
        first, last = (F.lit(False), F.lit(False)) if size is None else (own <= 0, (own + 1) * side >= size)
        before, after = F.when((inside < margin) & ~first, own - 1), F.when((inside >= side - margin) & ~last, own + 1)
        return F.array_compact(F.array(own, before, after))

    inside = pixels if shape is None else pixels.filter(F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1))
    rows, columns = shape or (None, None)
    return inside.withColumn("ti", F.explode(near("i", rows))).withColumn("tj", F.explode(near("j", columns))).select("raster_id", "ti", "tj", "i", "j", "value")


#: From an array to one of its shape, or to several.
Make = Callable[[np.ndarray], np.ndarray | tuple[np.ndarray, ...]]


def _on_tile(rows: pd.DataFrame, shape: tuple[int, int] | None, side: int, margin: int, make: Make, names: Sequence[str]) -> pd.DataFrame:
    at = int(rows["ti"].iloc[0]), int(rows["tj"].iloc[0])
    own = [(t * side, (t + 1) * side) for t in at]
    span = [(a - margin, b + margin) for a, b in own]
    if shape is not None:
        own, span = ([(max(0, a), min(n, b)) for n, (a, b) in zip(shape, limits, strict=True)] for limits in (own, span))
    (top, bottom), (left, right) = span
    image = np.full((bottom - top, right - left), np.nan)
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    image[i - top, j - left] = rows["value"].to_numpy(float)
    held = np.zeros(image.shape, bool)
    held[i - top, j - left] = True
    cut = tuple(slice(a - c, b - c) for (a, b), (c, _) in zip(own, span, strict=True))
    made = make(image)
    i, j = np.nonzero(held[cut])
    out = {"raster_id": rows["raster_id"].iloc[0], "i": i + own[0][0], "j": j + own[1][0]}
    return pd.DataFrame(out | {name: m[cut][i, j] for name, m in zip(names, made if isinstance(made, tuple) else (made,), strict=True)})


def on_tiles(pixels: DataFrame, shape: tuple[int, int] | None, margin: int, make: Make, side: int = SIDE, names: Sequence[str] = ("value",)) -> DataFrame:
    """(raster_id, i, j, names) of the pixels given, after ``make`` of their tile with its margin.

    ``make`` gets an array and returns one of its shape, or one for each name;
    what lies within ``margin`` of an inner edge of the tile is thrown away.
    Without a shape the array is NaN beyond the raster.
    """
    kind = dict(pixels.dtypes)["raster_id"]
    tiled = with_tiles(pixels.select("raster_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("value")), shape, side, margin)
    ddl = ", ".join(f"`{n}` double" for n in names)
    made = tiled.groupBy("raster_id", "ti", "tj").applyInPandas(lambda rows: _on_tile(rows, shape, side, margin, make, names), f"raster_id {kind}, i bigint, j bigint, {ddl}")
    return made.withColumns({n: F.nullif(F.col(f"`{n}`"), F.lit(float("nan"))) for n in names})


def in_steps(pixels: DataFrame, shape: tuple[int, int], reach: int, steps: int, make: Callable[[np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """``steps`` times ``make``, which looks ``reach`` pixels far; tiles meet once for side / reach steps."""
    at_once = max(1, side // reach)
    while steps > 0:
        now = min(steps, at_once)
        pixels = on_tiles(pixels, shape, now * reach, partial(_repeated, make=make, steps=now), side)
        steps -= now
        if steps:
            pixels = settle(pixels, "tiles")
    return pixels


def _repeated(image: np.ndarray, make: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    for _ in range(steps):
        image = make(image)
    return image


def around(image: np.ndarray, radius: int) -> np.ndarray:
    """The square around each pixel (last two axes), mirrored at the border."""
    return sliding_window_view(np.pad(image, radius, mode="symmetric"), (2 * radius + 1, 2 * radius + 1))


def _median(image: np.ndarray, radius: int) -> np.ndarray:
    return np.median(around(image, radius), axis=(2, 3))


def _calmest_quarter(image: np.ndarray, radius: int) -> np.ndarray:
    """The mean of the one of four overlapping corner blocks that varies least; the first of equals."""
    near, r = around(image, radius), radius
    blocks = [near[:, :, a : a + r + 1, b : b + r + 1] for b in (0, r) for a in (0, r)]
    means = np.stack([b.mean((2, 3)) for b in blocks])
    spread = np.stack([b.var((2, 3)) for b in blocks])
    return np.take_along_axis(means, np.where(np.isnan(spread), np.inf, spread).argmin(0)[None], 0)[0]


def _plane_misfit(image: np.ndarray, radius: int) -> np.ndarray:
    """The standard deviation of the square around each pixel from its plane of least squares; NaN with no plane."""
    near = around(image, radius)
    a, b = np.mgrid[-radius : radius + 1, -radius : radius + 1].astype(float)
    terms = np.stack([np.ones_like(a), a, b])
    valid = ~np.isnan(near)
    with np.errstate(invalid="ignore", divide="ignore"):
        n = valid.sum((2, 3))
        level = np.where(valid, near, 0).sum((2, 3)) / n
        known = np.where(valid, near - level[:, :, None, None], 0)
    normal = np.einsum("ijkl,pkl,qkl->ijpq", valid, terms, terms, optimize=True)
    right = np.einsum("ijkl,pkl->ijp", known, terms, optimize=True)
    solvable = np.abs(np.linalg.det(normal)) > 1e-9
    plane = np.zeros_like(right)
    plane[solvable] = np.linalg.solve(normal[solvable], right[solvable][..., None])[..., 0]
    misfit = np.where(valid, known - np.einsum("ijp,pkl->ijkl", plane, terms), 0)
    return np.where(solvable, np.sqrt((misfit**2).sum((2, 3)) / np.maximum(n, 1)), np.nan)


def _diffused(image: np.ndarray, noise: float, pace: float, diagonal: bool) -> np.ndarray:
    """One step of diffusion that edges hold up; the border of the array stays."""
    middle, out = image[1:-1, 1:-1], image.copy()
    rows, columns = image.shape
    change = np.zeros_like(middle)
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            if (a, b) == (0, 0) or a and b and not diagonal:
                continue
            step = (image[1 + a : rows - 1 + a, 1 + b : columns - 1 + b] - middle) / np.hypot(a, b)
            change += step * np.exp(-((step / noise) ** 2))
    out[1:-1, 1:-1] += pace * change
    return out


def median_and_deviation(image: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The median of the valid pixels in the square around each, and the median distance from it."""
    near = sliding_window_view(np.pad(image, radius, constant_values=np.nan), (2 * radius + 1, 2 * radius + 1)).reshape(*image.shape, -1)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # squares without a valid pixel
        middle = np.nanmedian(near, axis=2)
        return middle, np.nanmedian(np.abs(near - middle[:, :, None]), axis=2)


def inverse_distance_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """The mean of the valid pixels in the square around each but itself, by inverse squared distance."""
    near = sliding_window_view(np.pad(image, radius, constant_values=np.nan), (2 * radius + 1, 2 * radius + 1))
    a, b = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    weight = np.where((a == 0) & (b == 0), 0.0, 1 / np.maximum(a * a + b * b, 1))
    valid = ~np.isnan(near)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (np.where(valid, near, 0) * weight).sum((2, 3)) / (valid * weight).sum((2, 3))


def _weighed(image: np.ndarray, kernels: Sequence[Mapping[tuple[int, int], float]], radius: int) -> tuple[np.ndarray, ...]:
    """Weighted sums of the pixels (a, b) away, for each kernel; NaN where one is missing."""
    rows, columns = image.shape
    wide = np.pad(image, radius, constant_values=np.nan)
    return tuple(sum(w * wide[radius + a : radius + a + rows, radius + b : radius + b + columns] for (a, b), w in k.items()) for k in kernels)


def stencils(pixels: DataFrame, kernels: Mapping[str, Mapping[tuple[int, int], float]], side: int = SIDE) -> DataFrame:
    """``pixels`` with the weighted sum of neighbours by each named kernel (correlation), all in one shuffle; null where one with a weight is missing."""
    radius = max(max(abs(a), abs(b)) for k in kernels.values() for a, b in k)
    made = on_tiles(pixels, None, radius, partial(_weighed, kernels=[dict(k) for k in kernels.values()], radius=radius), side, tuple(kernels))
    return pixels.join(made, ["raster_id", "i", "j"], "left")


def median_filter(pixels: DataFrame, shape: tuple[int, int], size: int = 5, steps: int = 1, side: int = SIDE) -> DataFrame:
    """The median of the square of ``size`` pixels around each pixel, ``steps`` times."""
    return in_steps(pixels, shape, size // 2, steps, partial(_median, radius=size // 2), side)


def kuwahara_filter(pixels: DataFrame, shape: tuple[int, int], size: int = 5, side: int = SIDE) -> DataFrame:
    """The mean of the calmest of the four corner blocks around each pixel, which share its row and column."""
    if size < 3 or size % 2 == 0:
        raise ValueError("the square has an odd side of 3 pixels or more")
    return on_tiles(pixels, shape, size // 2, partial(_calmest_quarter, radius=size // 2), side)


def diffusion_filter(pixels: DataFrame, shape: tuple[int, int], steps: int = 10, noise: float = 0.15, pace: float = 0.25, neighbours: int = 4, side: int = SIDE) -> DataFrame:
    """Diffusion of a scalar field: differences well above ``noise`` hold it up.

    ``pace`` is at most one by the number of ``neighbours`` (4 or 8; diagonal
    differences are divided by their distance). Pixels at the raster's border
    stay as they are.
    """
    if neighbours not in (4, 8):
        raise ValueError("a pixel has 4 or 8 neighbours")
    return in_steps(pixels, shape, 1, steps, partial(_diffused, noise=noise, pace=min(pace, 1 / neighbours), diagonal=neighbours == 8), side)


def plane_misfit(pixels: DataFrame, shape: tuple[int, int], size: int = 5, side: int = SIDE) -> DataFrame:
    """How far the pixels of the square around each pixel stray from a plane: the standard deviation of its residuals.

    Null pixels have a misfit of their neighbours but don't count; fewer than
    three pixels out of line have no plane and give null.
    """
    return on_tiles(pixels, shape, size // 2, partial(_plane_misfit, radius=size // 2), side)
