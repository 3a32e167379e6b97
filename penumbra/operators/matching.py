"""Template matching: correlation kernels per pair of templates.

``match`` runs a numpy kernel on each row's two square templates (arrays in row
order), so Spark deals out the pairs and a task holds one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _spectra(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.fft.fft2(a - a.mean()), np.fft.fft2(b - b.mean())


def _surface(cross: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.real(np.fft.ifft2(cross)))


def phase_only(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Phase correlation: the cross spectrum with all magnitudes one."""
    s, t = _spectra(a, b)
    cross = np.conj(s) * t
    return _surface(cross / np.maximum(np.abs(cross), 1e-12))


def symmetric_phase(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each spectrum is whitened by the root of its magnitude."""
    s, t = _spectra(a, b)
    return _surface(np.conj(s) * t / np.maximum(np.sqrt(np.abs(s)) * np.sqrt(np.abs(t)), 1e-12))


def amplitude_compensated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Only the first spectrum is whitened, up to its largest magnitude."""
    s, t = _spectra(a, b)
    return _surface(np.conj(s) * t * np.minimum(1 / np.maximum(np.abs(s), 1e-12), np.abs(s).max()))


def cross_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s, t = _spectra(a, b)
    return _surface(np.conj(s) * t)


def robust_correlation(a: np.ndarray, b: np.ndarray, steps: int = 9) -> np.ndarray:
    """Mean phase correlation of many clipped versions of the images."""
    total = np.zeros(a.shape)
    for level in np.linspace(0.1, 0.9, steps):
        x, y = (np.clip(im, *np.quantile(im, sorted((1 - level, level)) if level != 0.5 else (0.4, 0.6))) for im in (a, b))
        total += phase_only(x, y)
    return total / steps


def orientation_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of unit gradients as complex numbers."""

    def unit(im):
        g = np.gradient(im, axis=1) + 1j * np.gradient(im, axis=0)
        return np.where(np.abs(g) > 0, g / np.maximum(np.abs(g), 1e-12), 0)

    return _surface(np.conj(np.fft.fft2(unit(a))) * np.fft.fft2(unit(b)))


def gaussian_phase(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Phase correlation with a Gaussian low-pass."""
    s, t = _spectra(a, b)
    cross = np.conj(s) * t
    f = np.fft.fftfreq(a.shape[0])[:, None] ** 2 + np.fft.fftfreq(a.shape[1])[None] ** 2
    return _surface(cross / np.maximum(np.abs(cross), 1e-12) * np.exp(-f / (2 * 0.25**2)))


def binary_phase(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The second spectrum is reduced to the signs of its real part."""
    s, t = _spectra(a, b)
    return _surface(np.conj(s) / np.maximum(np.abs(s), 1e-12) * np.where(np.real(t) >= 0, 1.0, -1.0))


def _gradients(image: np.ndarray) -> np.ndarray:
    """Slopes to the right and down as complex numbers, by the optimal 3 by 3 filter, mirrored at the border."""
    wide = np.pad(image, 1, mode="symmetric")
    rows, columns = image.shape
    out = np.zeros(image.shape, complex)
    for a, b, w in ((-1, -1, 17), (-1, 1, 17), (0, -1, 61), (0, 1, 61), (1, -1, 17), (1, 1, 17)):
        out += w / 190 * b * wide[1 + a : 1 + a + rows, 1 + b : 1 + b + columns]
        out += 1j * w / 190 * b * wide[1 + b : 1 + b + rows, 1 + a : 1 + a + columns]
    return out


def gradient_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of gradients as complex numbers, long ones counting more."""
    return _surface(np.conj(np.fft.fft2(_gradients(a))) * np.fft.fft2(_gradients(b)))


def normalized_gradient_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of gradients less their mean, the longest of length one."""

    def scaled(image):
        g = _gradients(image)
        g = g - g.mean()
        return g / max(np.abs(g).max(), 1e-300)

    return _surface(np.conj(np.fft.fft2(scaled(a))) * np.fft.fft2(scaled(b)))


def windrose_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both spectra are reduced to the signs of their real and imaginary parts, so to eight directions."""

    def rose(s):
        return np.sign(np.real(s)) + 1j * np.sign(np.imag(s))

    s, t = _spectra(a, b)
    return _surface(np.conj(rose(s)) * rose(t))


#: Correlators by code.
CORRELATORS: dict[str, Kernel] = {
    "phas_only": phase_only,
    "symm_phas": symmetric_phase,
    "ampl_comp": amplitude_compensated,
    "cros_corr": cross_correlation,
    "robu_corr": robust_correlation,
    "orie_corr": orientation_correlation,
    "gaus_phas": gaussian_phase,
    "bina_phas": binary_phase,
    "grad_corr": gradient_correlation,
    "grad_norm": normalized_gradient_correlation,
    "wind_corr": windrose_correlation,
}


def _around(surface: np.ndarray, peak: tuple[int, int]) -> np.ndarray:
    i, j = peak
    return surface[np.ix_([(i + k) % surface.shape[0] for k in (-1, 0, 1)], [(j + k) % surface.shape[1] for k in (-1, 0, 1)])]


def _three_point(f: Callable[[float, float, float], float]):
    def both(surface, peak):
        near = _around(surface, peak)
        return f(near[0, 1], near[1, 1], near[2, 1]), f(near[1, 0], near[1, 1], near[1, 2])

    return both


def _parabola(a, b, c):
    return 0.0 if a + c == 2 * b else (a - c) / (2 * (a + c - 2 * b))


def _gauss(a, b, c):
    return _parabola(*np.log(np.maximum([a, b, c], 1e-12))) if b > 0 else 0.0


def _triangle(a, b, c):
    low, high = min(a, c), max(a, c)
    return 0.0 if b == low else (1 if c > a else -1) * (1 - (high - low)) / (b - low)


def _equiangular(a, b, c):
    return 0.0 if b == min(a, c) else (c - a) / (2 * (b - min(a, c)))


def _moment(surface, peak):
    near = np.maximum(_around(surface, peak), 0)
    total = near.sum()
    return (0.0, 0.0) if total == 0 else (float((near[2] - near[0]).sum() / total), float((near[:, 2] - near[:, 0]).sum() / total))


#: Sub-pixel estimators by code: (rows, columns) from the highest pixel.
SUBPIXEL = {"parab_1": _three_point(_parabola), "gauss_1": _three_point(_gauss), "trian_1": _three_point(_triangle), "equia_1": _three_point(_equiangular), "moment": _moment}


def peak_measures(surface: np.ndarray, peak: tuple[int, int]) -> dict[str, float]:
    """How much the peak stands out of its surface."""
    top = surface[peak]
    rest = surface.copy()
    rest[np.ix_([(peak[0] + k) % surface.shape[0] for k in (-1, 0, 1)], [(peak[1] + k) % surface.shape[1] for k in (-1, 0, 1)])] = -np.inf
    second, rms = rest.max(), np.sqrt((surface**2).mean())
    return {"peak": float(top), "ratio": float(top / second) if second not in (0, -np.inf) else 0.0, "margin": float(top - second) if second != -np.inf else 0.0, "rms": float(top / rms) if rms else 0.0}


def locate(a: np.ndarray, b: np.ndarray, correlator: str = "phas_only", subpixel: str | None = "moment") -> dict[str, float]:
    """Displacement (di, dj) of ``b`` against ``a`` with the measures of the peak."""
    surface = CORRELATORS[correlator](a, b)
    peak = np.unravel_index(np.argmax(surface), surface.shape)
    di, dj = SUBPIXEL[subpixel](surface, peak) if subpixel else (0.0, 0.0)
    return {"di": float(peak[0] - surface.shape[0] // 2 + np.clip(di, -1, 1)), "dj": float(peak[1] - surface.shape[1] // 2 + np.clip(dj, -1, 1))} | peak_measures(surface, peak)


def _match(batches: Iterator[pd.DataFrame], key: str, correlator: str, subpixel: str | None) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for k, a, b in zip(batch[key], batch["template_1"], batch["template_2"], strict=True):
            side = int(np.sqrt(len(a)))
            rows.append({key: k} | locate(np.asarray(a, float).reshape(side, side), np.asarray(b, float).reshape(side, side), correlator, subpixel))
        yield pd.DataFrame(rows, columns=[key, "di", "dj", "peak", "ratio", "margin", "rms"])


def match(pairs: DataFrame, key: str, correlator: str = "phas_only", subpixel: str | None = "moment") -> DataFrame:
    """``pairs`` (key, template_1, template_2: arrays of equal squares) with displacement and peak measures."""
    if correlator not in CORRELATORS:
        raise ValueError(f"no correlator {correlator}; there are {', '.join(CORRELATORS)}")
    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, "template_1", "template_2").mapInPandas(partial(_match, key=key, correlator=correlator, subpixel=subpixel), f"{key} {kind}, di double, dj double, peak double, ratio double, margin double, rms double")
