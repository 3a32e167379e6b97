"""Displacement below a pixel, from the plane that the phases of a cross spectrum lie on.

Where the second template is the first one moved by (di, dj), the phase of
their cross spectrum at frequency (fi, fj) is -2 pi (fi di + fj dj), wrapped
round the circle. ``phase_points`` gives the spectrum as weighted points, which
``least_squares_planes`` fits by sums alone; ``fit_planes`` runs one of the
methods in ``METHODS`` on each pair of templates, of a size that the rasters
don't change.

Phases are taken as they are by ``least_squares``, ``components`` and
``differences``, so these stand for moves of less than a pixel or so; ``subspace``
unwraps along both axes, for moves up to an eighth of the template, and the
others know that phases wrap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = 2 * np.pi
#: Votes that are counted at once.
AT_ONCE = 1 << 16


@lru_cache(maxsize=16)
def frequencies(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies down and to the right of each cell of a spectrum, in cycles a pixel; not to be written to."""
    found = np.fft.fftfreq(shape[0])[:, None] * np.ones(shape[1]), np.ones(shape[0])[:, None] * np.fft.fftfreq(shape[1])
    for f in found:
        f.flags.writeable = False
    return found


def cross_spectrum(a: np.ndarray, b: np.ndarray, tapered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(phases as numbers of length one, weights) of two templates, their borders faded out.

    Weights are the roots of both magnitudes below half the highest frequency
    of the shorter axis, and 0 beyond; the largest is 1.
    """
    if tapered:
        fade = np.hanning(a.shape[0] + 2)[1:-1, None] * np.hanning(a.shape[1] + 2)[1:-1]
        a, b = (a - a.mean()) * fade, (b - b.mean()) * fade
    cross = np.conj(np.fft.fft2(a)) * np.fft.fft2(b)
    size = np.abs(cross)
    fi, fj = frequencies(a.shape)
    weight = np.sqrt(size) * (np.hypot(fi, fj) < 0.25)
    weight[0, 0] = 0
    top = weight.max()
    return cross / np.maximum(size, 1e-300), weight / top if top > 0 else weight


def plane(move: Sequence[float], shape: tuple[int, int]) -> np.ndarray:
    """The cross spectrum of a move."""
    fi, fj = frequencies(shape)
    return np.exp(-1j * TURN * (fi * move[0] + fj * move[1]))


def _solved(fi: np.ndarray, fj: np.ndarray, angle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The plane through the zero point nearest to angles in least squares; nothing to solve gives no move."""
    design = np.stack([fi, fj], 1) * np.sqrt(weight)[:, None]
    return np.linalg.lstsq(design, -angle / TURN * np.sqrt(weight), rcond=1e-12)[0]


def least_squares(q: np.ndarray, w: np.ndarray, seed: int = 0) -> np.ndarray:
    used = w > 0
    fi, fj = (f[used] for f in frequencies(q.shape))
    return _solved(fi, fj, np.angle(q[used]), w[used])


def components(q: np.ndarray, w: np.ndarray, seed: int = 0) -> np.ndarray:
    """The plane across the direction in which weighted points stray least."""
    used = w > 0
    points = np.stack([f[used] for f in frequencies(q.shape)] + [np.angle(q[used]) / TURN], 1)
    _, axes = np.linalg.eigh((points * w[used][:, None]).T @ points)
    normal = axes[:, 0]
    return normal[:2] / normal[2] if abs(normal[2]) > 1e-12 else np.zeros(2)


def differences(q: np.ndarray, w: np.ndarray, seed: int = 0) -> np.ndarray:
    """The weighted median step of the phase from cell to cell along either axis."""
    out = []
    for axis in (0, 1):
        step = np.angle(np.conj(q) * np.roll(q, -1, axis))
        weight = np.minimum(w, np.roll(w, -1, axis)).ravel()
        order = np.argsort(step, axis=None, kind="stable")
        total = np.cumsum(weight[order])
        middle = order[np.searchsorted(total, total[-1] / 2)] if total[-1] > 0 else order[0]
        out.append(-step.ravel()[middle] * q.shape[axis] / TURN if total[-1] > 0 else 0.0)
    return np.array(out)


def _slope(column: np.ndarray, radius: float) -> float:
    """The slope of an unwrapped phase near its middle, a cell."""
    n = len(column)
    at = np.arange(max(0, int(np.ceil((0.5 - radius) * n))), min(n, int(np.ceil((0.5 + radius) * n)) + 1))
    return float(np.polyfit(at, np.unwrap(np.angle(column[at])), 1)[0]) if len(at) > 1 else 0.0


def subspace(q: np.ndarray, w: np.ndarray, seed: int = 0, radius: float = 0.2) -> np.ndarray:
    """The slopes of the first left and right singular vectors, of which a plane is the product."""
    u, _, v = np.linalg.svd(np.fft.fftshift(w * q))
    return -np.array([_slope(u[:, 0], radius) * q.shape[0], _slope(v[0], radius) * q.shape[1]]) / TURN


def _peak(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The move in whole pixels at which all phases agree best."""
    surface = np.real(np.fft.ifft2(w * q))
    at = np.array(np.unravel_index(surface.argmax(), surface.shape))
    return np.where(2 * at > q.shape, at - q.shape, at).astype(float)


def two_point_steps(q: np.ndarray, w: np.ndarray, seed: int = 0, refinements: int = 4, steps: int = 50, power: int = 3) -> np.ndarray:
    """Gradient steps on the squared difference from a plane, as long as two points tell; after each descent misfits lose weight."""
    fi, fj = frequencies(q.shape)
    move = _peak(q, w)

    def slope(d: np.ndarray) -> np.ndarray:
        misfit = w * np.imag(q * np.exp(1j * TURN * (fi * d[0] + fj * d[1])))
        return np.array([(fi * misfit).sum(), (fj * misfit).sum()])

    for _ in range(refinements):
        before, now = move - 0.1, move
        slope_before = slope(before)
        for _ in range(steps):
            slope_now = slope(now)
            change, bend = now - before, slope_now - slope_before
            if np.abs(change).max() < 1e-10 or abs(change @ bend) < 1e-300:
                break
            # no step leads further than a pixel
            step = np.clip(change @ change / (change @ bend) * slope_now, -1, 1)
            before, slope_before, now = now, slope_now, now - step
        move = now
        w = w * (1 - np.abs(q - plane(move, q.shape)) ** 2 / 4) ** power
    return move


def consensus(q: np.ndarray, w: np.ndarray, seed: int = 0, trials: int = 300, limit: float = 0.05, most: float | None = None) -> np.ndarray:
    """Random pairs of points give moves; the one with the most weight within ``limit`` turns is fitted to those points.

    Points of a pair may have wrapped, so each is tried with as many whole turns
    as a move of ``most`` pixels can make; half the template unless given.
    """
    most = most or min(q.shape) / 2
    used = np.flatnonzero(w > 0)
    if len(used) < 2:
        return np.zeros(2)
    f = np.stack([x.ravel()[used] for x in frequencies(q.shape)], 1)
    turns, weight = -np.angle(q).ravel()[used] / TURN, w.ravel()[used]
    pairs = np.random.default_rng(seed).integers(0, len(used), (trials, 2))
    # of pairs drawn again, in either order, only the first can win
    low, high = pairs.min(1), pairs.max(1)
    a, b = pairs[np.sort(np.unique(low * len(used) + high, return_index=True)[1])].T
    det = f[a, 0] * f[b, 1] - f[a, 1] * f[b, 0]
    a, b, det = (x[np.abs(det) >= 1e-6] for x in (a, b, det))
    reach = np.ceil(np.abs(f).sum(1) * most).astype(int)
    # turns of each pair, those of its second point outside
    wide = 2 * reach + 1
    count = wide[a] * wide[b]
    pair = np.repeat(np.arange(len(a)), count)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
    x = turns[a][pair] + at % wide[a][pair] - reach[a][pair]
    y = turns[b][pair] + at // wide[a][pair] - reach[b][pair]
    found = np.stack([f[b, 1][pair] * x - f[a, 1][pair] * y, f[a, 0][pair] * y - f[b, 0][pair] * x], 1) / det[pair, None]
    best, moves = -1.0, np.concatenate([np.zeros((1, 2)), found[np.abs(found).max(1) <= most]])
    out = np.zeros(2)
    for first in range(0, len(moves), 512):
        some = moves[first : first + 512]
        off = some @ f.T - turns
        held = ((np.abs(off - np.round(off)) <= limit) * weight).sum(1)
        if held.max() > best:
            best, out = held.max(), some[held.argmax()]
    for _ in range(3):
        off = f @ out - turns
        whole = np.round(off)
        near = np.abs(off - whole) <= limit
        if near.sum() < 2:
            break
        out = _solved(f[near, 0], f[near, 1], -(turns[near] + whole[near]) * TURN, weight[near])
    return out


def _polished(q: np.ndarray, w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Plane fits to what is left after a move, while phases no longer wrap."""
    fi, fj = frequencies(q.shape)
    used = w > 0
    for _ in range(5):
        left = np.angle(q * np.conj(plane(move, q.shape)))
        move = move + _solved(fi[used], fj[used], left[used], (w * np.cos(left / 2) ** 2)[used])
    return move


def votes(q: np.ndarray, w: np.ndarray, seed: int = 0, spacing: float = 0.5, width: float = 0.1, most: float | None = None) -> np.ndarray:
    """Every point votes for the moves of a grid, more for those nearer to its phase; the winner is polished."""
    most = most or min(q.shape) / 2
    axis = np.arange(-most, most + spacing / 2, spacing)
    used = w > 0
    fi, fj = (f[used] for f in frequencies(q.shape))
    turns, weight = -np.angle(q[used]) / TURN, w[used]
    best, out = -1.0, np.zeros(2)
    rows = max(1, AT_ONCE // max(1, len(axis) * len(turns)))
    for first in range(0, len(axis), rows):
        some = axis[first : first + rows]
        off = fi * some[:, None, None] + fj * axis[:, None] - turns
        held = (weight / (1 + ((off - np.round(off)) / width) ** 2)).sum(2)
        if held.max() > best:
            i, j = np.unravel_index(held.argmax(), held.shape)
            best, out = held.max(), np.array([some[i], axis[j]])
    return _polished(q, w, out)


def sinogram(q: np.ndarray, w: np.ndarray, seed: int = 0, angles: int = 90, spacing: float = 0.25, most: float | None = None) -> np.ndarray:
    """Points are summed along lines across each direction; the direction and length at which the sums agree best are polished."""
    most = most or min(q.shape) / 2
    lengths = np.arange(-most, most + spacing / 2, spacing)
    used = w > 0
    fi, fj = (f[used] for f in frequencies(q.shape))
    points = (w * q)[used]
    cells = 2 * max(q.shape)
    angle = np.arange(angles) * np.pi / angles
    across = fi * np.sin(angle)[:, None] + fj * np.cos(angle)[:, None]
    line = np.clip(((across + 1) / 2 * cells).astype(int), 0, cells - 1) + np.arange(angles)[:, None] * cells
    real, imaginary = (np.bincount(line.ravel(), np.tile(x, angles), angles * cells).reshape(angles, cells) for x in (points.real, points.imag))
    middle = (np.arange(cells) + 0.5) / cells * 2 - 1
    turned = TURN * middle[:, None] * lengths
    agreed = real @ np.cos(turned) - imaginary @ np.sin(turned)
    # directions that sum points alike agree alike but for rounding: the first counts
    k, at = np.unravel_index(np.argmax(agreed >= agreed.max() - 1e-12 * np.abs(agreed).max()), agreed.shape)
    out = lengths[at] * np.array([np.sin(angle[k]), np.cos(angle[k])])
    return _polished(q, w, out)


def zoomed(q: np.ndarray, w: np.ndarray, seed: int = 0, finer: int = 50) -> np.ndarray:
    """The highest place of the correlation surface, computed again around its peak on a grid ``finer`` times as fine."""
    peak = _peak(q, w)
    fi, fj = np.fft.fftfreq(q.shape[0]), np.fft.fftfreq(q.shape[1])
    span, step = 1.0, 0.25
    while step > 0.5 / finer:
        axis = np.arange(-span, span + step / 2, step)
        rows = np.exp(1j * TURN * (peak[0] + axis)[:, None] * fi)
        columns = np.exp(1j * TURN * fj[:, None] * (peak[1] + axis))
        surface = np.real(rows @ (w * q) @ columns)
        at = np.unravel_index(surface.argmax(), surface.shape)
        peak = peak + np.array([axis[at[0]], axis[at[1]]])
        span, step = step, step / 4
    return peak


#: Methods by code, each from (phases, weights, seed) to a move (di, dj).
METHODS: dict[str, Callable[..., np.ndarray]] = {
    "lsq": least_squares, "pca": components, "diff": differences, "svd": subspace, "tpss": two_point_steps, "ransac": consensus, "hough": votes, "radon": sinogram, "zoom": zoomed,
}


def _squares(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in zip(batch["template_1"], batch["template_2"], strict=True):
        side = int(np.sqrt(len(a)))
        yield np.asarray(a, float).reshape(side, side), np.asarray(b, float).reshape(side, side)


def _fit(batches: Iterator[pd.DataFrame], key: str, methods: Sequence[str], seed: int, tapered: bool, columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, (a, b) in zip(batch[key], _squares(batch), strict=True):
            q, w = cross_spectrum(a, b, tapered)
            for method in methods:
                move = METHODS[method](q, w, seed)
                agreed = float((w * np.cos(np.angle(q * np.conj(plane(move, q.shape))))).sum() / w.sum()) if w.sum() > 0 else 0.0
                rows.append((k, method, float(move[0]), float(move[1]), agreed))
        yield pd.DataFrame(rows, columns=[key, "method", "di", "dj", "agreement"])[list(columns)]


def fit_planes(pairs: DataFrame, key: str, method: str = "tpss", seed: int = 1, tapered: bool = True) -> DataFrame:
    """(key, di, dj, agreement) of ``pairs`` (key, template_1, template_2: arrays of equal squares).

    ``agreement`` is the weighted mean cosine of the phases' distance from the
    plane: 1 where all lie on it. ``seed`` makes random draws repeatable.
    """
    return _fitted(pairs, key, [method], seed, tapered, [key, "di", "dj", "agreement"])


def fit_all_planes(pairs: DataFrame, key: str, methods: Sequence[str] = tuple(METHODS), seed: int = 1, tapered: bool = True) -> DataFrame:
    """(key, method, di, dj, agreement): as ``fit_planes``, by each of the methods; a pair is read, and its spectrum made, once for all."""
    return _fitted(pairs, key, methods, seed, tapered, [key, "method", "di", "dj", "agreement"])


def _fitted(pairs: DataFrame, key: str, methods: Sequence[str], seed: int, tapered: bool, columns: Sequence[str]) -> DataFrame:
    for method in methods:
        if method not in METHODS:
            raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")
    kinds = {key: dict(pairs.dtypes)[key], "method": "string"}
    fit = partial(_fit, key=key, methods=list(methods), seed=seed, tapered=tapered, columns=columns)
    return pairs.select(key, "template_1", "template_2").mapInPandas(fit, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))


def _points(batches: Iterator[pd.DataFrame], key: str, tapered: bool) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k, (a, b) in zip(batch[key], _squares(batch), strict=True):
            q, w = cross_spectrum(a, b, tapered)
            fi, fj = frequencies(q.shape)
            yield pd.DataFrame({key: k, "fi": fi.ravel(), "fj": fj.ravel(), "phase": np.angle(q).ravel(), "weight": w.ravel()})


def phase_points(pairs: DataFrame, key: str, tapered: bool = True) -> DataFrame:
    """(key, fi, fj, phase, weight): a row for each frequency of each pair."""
    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, "template_1", "template_2").mapInPandas(partial(_points, key=key, tapered=tapered), f"{key} {kind}, fi double, fj double, phase double, weight double")


def least_squares_planes(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, di, dj: the plane of weighted least squares, from sums by key; null where points lie on a line."""
    w, p = F.col("weight"), -F.col("phase") / TURN
    sums = points.groupBy(*keys).agg(
        F.sum(w * F.col("fi") * F.col("fi")).alias("ii"), F.sum(w * F.col("fi") * F.col("fj")).alias("ij"), F.sum(w * F.col("fj") * F.col("fj")).alias("jj"),
        F.sum(w * F.col("fi") * p).alias("ip"), F.sum(w * F.col("fj") * p).alias("jp"),
    )
    det = F.expr("ii * jj - ij * ij")
    some = det > 1e-12 * F.col("ii") * F.col("jj")
    return sums.select(*keys, F.when(some, F.expr("ip * jj - jp * ij") / det).alias("di"), F.when(some, F.expr("jp * ii - ip * ij") / det).alias("dj"))


def robust_planes(points: DataFrame, keys: Sequence[str], rounds: int = 3) -> DataFrame:
    """``keys``, di, dj: plane fits in rounds; points lose weight by their wrapped distance from the last plane.

    A point a quarter turn away counts nothing. The table of points is read once
    for each round, and only sums are shuffled.
    """
    planes = least_squares_planes(points, keys)
    for _ in range(rounds):
        known = planes.withColumnsRenamed({"di": "known_i", "dj": "known_j"})
        off = F.col("phase") + TURN * (F.col("fi") * F.col("known_i") + F.col("fj") * F.col("known_j"))
        left = off - TURN * F.round(off / TURN)
        met = points.join(known, list(keys)).withColumn("weight", F.col("weight") * F.pow(F.greatest(F.cos(left), F.lit(0.0)), F.lit(2))).withColumn("phase", left)
        change = least_squares_planes(met, keys)
        planes = change.join(known, list(keys)).select(*keys, (F.col("known_i") + F.col("di")).alias("di"), (F.col("known_j") + F.col("dj")).alias("dj"))
    return planes
