"""Templates of rasters at posts, and displacement of posts between two rasters.

A post (raster_id, id, i, j) has the square of pixels around it as its template,
in row order. Posts go to the tile that they lie in and pixels to every tile
whose margin they lie in, so both meet in one shuffle and a task holds one tile
with its posts. Templates that leave the raster or hold a null pixel are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators import matching, phase_planes
from penumbra.operators.tiles import SIDE, with_tiles
from penumbra.store import settle


def _cut(posts: pd.DataFrame, pixels: pd.DataFrame, radius: int, side: int) -> pd.DataFrame:
    if not len(posts):
        return pd.DataFrame({"id": posts["id"], "template": pd.Series([], dtype=object)})
    ti, tj = int(posts["ti"].iloc[0]), int(posts["tj"].iloc[0])
    top, left = ti * side - radius, tj * side - radius
    image = np.full((side + 2 * radius, side + 2 * radius), np.nan)
    if len(pixels):
        image[pixels["i"].to_numpy() - top, pixels["j"].to_numpy() - left] = pixels["value"].to_numpy(float)
    templates = []
    for i, j in zip(posts["i"] - ti * side, posts["j"] - tj * side, strict=True):
        window = image[i : i + 2 * radius + 1, j : j + 2 * radius + 1]
        templates.append(None if np.isnan(window).any() else window.ravel())
    return pd.DataFrame({"id": posts["id"].to_numpy(), "template": pd.Series(templates, dtype=object)})


def templates_at(posts: DataFrame, pixels: DataFrame, shape: tuple[int, int], radius: int, side: int = SIDE) -> DataFrame:
    """(id, template) of posts (raster_id, id, i, j) in pixels (raster_id, i, j, value): squares of 2 radius + 1."""
    kind = dict(posts.dtypes)["id"]
    tile = {f"t{k}": F.floor(F.col(k) / side) for k in "ij"}
    placed = posts.select("raster_id", "id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).withColumns(tile)
    cells = with_tiles(pixels.select("raster_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.col("value").cast("double").alias("value")), shape, side, radius)
    keys = ["raster_id", "ti", "tj"]
    return placed.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInPandas(lambda some, cells: _cut(some, cells, radius, side), f"id {kind}, template array<double>")


def _pairs(posts: DataFrame, first: DataFrame, second: DataFrame, moved: DataFrame, shape: tuple[int, int], radius: int, side: int) -> DataFrame:
    a = templates_at(posts, first, shape, radius, side).withColumnRenamed("template", "template_1")
    b = templates_at(moved, second, shape, radius, side).withColumnRenamed("template", "template_2")
    return a.join(b, "id").filter("template_1 IS NOT NULL AND template_2 IS NOT NULL")


def match_posts(posts: DataFrame, first: DataFrame, second: DataFrame, shape: tuple[int, int], radius: int, correlator: str = "grad_norm", refine: str | None = "tpss", side: int = SIDE, cuts: int = 2) -> DataFrame:
    """(id, di, dj, peak, agreement): how far the surroundings of each post moved from ``first`` to ``second``.

    Templates at the same place are correlated to a whole pixel; the second
    template is then cut anew at the place found, where the two overlap most,
    and the plane of their phases gives the rest; that is done ``cuts`` times, as
    the first whole pixel may be one off. Posts without both templates are left
    out; without ``refine`` (a method of ``phase_planes``) moves are
    whole pixels and agreement is null.
    """
    coarse = matching.match(_pairs(posts, first, second, posts, shape, radius, side), "id", correlator, None).select("id", "di", "dj", "peak")
    if refine is None:
        return coarse.withColumn("agreement", F.lit(None).cast("double"))
    found = coarse.withColumn("agreement", F.lit(None).cast("double"))
    for _ in range(cuts):
        found = settle(found, "moves")
        whole = found.select("id", F.round("di").alias("whole_i"), F.round("dj").alias("whole_j"), "peak")
        moved = posts.join(whole, "id").select("raster_id", "id", (F.col("i") + F.col("whole_i")).cast("bigint").alias("i"), (F.col("j") + F.col("whole_j")).cast("bigint").alias("j"))
        fine = phase_planes.fit_planes(_pairs(posts, first, second, moved, shape, radius, side), "id", refine)
        found = fine.join(whole, "id").select("id", (F.col("whole_i") + F.col("di")).alias("di"), (F.col("whole_j") + F.col("dj")).alias("dj"), "peak", "agreement")
    return found


def masked_correlation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(correlation, overlap) for every lag of b against a, in rows and columns from -(n - 1) to n - 1.

    NaN pixels count nowhere. Sums over the overlap of each lag come from
    transforms of the images and of their masks. Where less than two pixels
    overlap, or one side doesn't vary, the correlation is 0.
    """
    shape = tuple(p + q - 1 for p, q in zip(a.shape, b.shape, strict=True))
    masks = [(~np.isnan(x)).astype(float) for x in (a, b)]
    # differences from the mean keep the sums small
    filled = [np.where(m > 0, x - np.nanmean(x), 0.0) if m.any() else np.zeros(x.shape) for x, m in zip((a, b), masks, strict=True)]

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of x at a place times y at the place moved by the lag."""
        return np.fft.irfft2(np.conj(np.fft.rfft2(x, shape)) * np.fft.rfft2(y, shape), shape)

    (x, y), (mx, my) = filled, masks
    n = np.round(both(mx, my))
    sx, sy = both(x, my), both(mx, y)
    xx, yy = both(x * x, my), both(mx, y * y)
    safe = np.maximum(n, 1)
    top = both(x, y) - sx * sy / safe
    spread = np.maximum(xx - sx * sx / safe, 0) * np.maximum(yy - sy * sy / safe, 0)
    scale = max(float((x * x).sum() * (y * y).sum()), 1e-300)
    score = np.where((n >= 2) & (spread > 1e-14 * scale), top / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
    back = tuple(q - 1 for q in a.shape)
    return np.roll(score, back, (0, 1)), np.roll(n, back, (0, 1))


def likelihood_surface(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How well template a fits at each place of b that holds it: texture tracking for multiplied noise.

    The logarithm of the ratio of two gamma distributed intensities is least
    spread at the true place; the score is minus the mean of 2 log(1 + r) - log r
    with r the ratio of both, -2 log 2 at best; pixels of no intensity
    are left out.
    """
    from numpy.lib.stride_tricks import sliding_window_view

    near = sliding_window_view(b, a.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = near / a
        ratio = ratio / np.exp(np.nanmean(np.where(ratio > 0, np.log(ratio), np.nan), axis=(2, 3), keepdims=True))
        cost = np.where(ratio > 0, 2 * np.log1p(ratio) - np.log(ratio), np.nan)
        return -np.nanmean(cost, axis=(2, 3))


def _square(values) -> np.ndarray:
    side = int(np.sqrt(len(values)))
    return np.array([np.nan if v is None else v for v in values], float).reshape(side, side)


def _best_masked(batches: Iterator[pd.DataFrame], key: str, share: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, one, two in zip(batch[key], batch["template_1"], batch["template_2"], strict=True):
            a, b = _square(one), _square(two)
            score, overlap = masked_correlation(a, b)
            allowed = np.where(overlap >= max(2, share * min((~np.isnan(a)).sum(), (~np.isnan(b)).sum())), score, -np.inf)
            i, j = np.unravel_index(allowed.argmax(), allowed.shape)
            some = np.isfinite(allowed[i, j])
            rows.append({key: k, "di": i - a.shape[0] + 1 if some else None, "dj": j - a.shape[1] + 1 if some else None, "score": allowed[i, j] if some else None, "overlap": int(overlap[i, j]) if some else 0})
        yield pd.DataFrame(rows, columns=[key, "di", "dj", "score", "overlap"])


def match_masked(pairs: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, di, dj, score, overlap) of ``pairs`` (key, template_1, template_2) whose null elements are masked.

    The lag of the highest correlation among those where at least ``share`` of
    the smaller template's valid pixels overlap; null where there is none.
    """
    return _mapped(pairs, key, partial(_best_masked, key=key, share=share), "di bigint, dj bigint, score double, overlap bigint")


def _best_likelihood(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, one, two in zip(batch[key], batch["template_1"], batch["template_2"], strict=True):
            a, b = _square(one), _square(two)
            surface = likelihood_surface(a, b)
            surface = np.where(np.isnan(surface), -np.inf, surface)
            i, j = np.unravel_index(surface.argmax(), surface.shape)
            middle = [(p - q) / 2 for p, q in zip(b.shape, a.shape, strict=True)]
            rows.append({key: k, "di": i - middle[0], "dj": j - middle[1], "score": surface[i, j]})
        yield pd.DataFrame(rows, columns=[key, "di", "dj", "score"])


def match_likelihood(pairs: DataFrame, key: str) -> DataFrame:
    """(key, di, dj, score): where the small ``template_1`` is likeliest within the larger ``template_2``, from the middle."""
    return _mapped(pairs, key, partial(_best_likelihood, key=key), "di double, dj double, score double")


def _mapped(pairs: DataFrame, key: str, make: Callable, ddl: str) -> DataFrame:
    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, "template_1", "template_2").mapInPandas(make, f"{key} {kind}, {ddl}")
