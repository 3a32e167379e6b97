"""Colour spaces as column expressions. Each function gives a tuple of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The matrices of the colour spaces.
YIQ = ((0.299, 0.587, 0.114), (0.596, -0.275, -0.321), (0.212, -0.523, 0.311))
YCBCR = ((0.257, 0.504, 0.098), (-0.148, -0.291, 0.439), (0.439, -0.368, -0.071))
YCBCR_OFFSET = (16 / 256, 128 / 256, 128 / 256)
XYZ_FORD = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_REINHARD = ((0.5141, 0.3239, 0.1604), (0.2651, 0.6702, 0.0641), (0.0241, 0.1228, 0.8444))
RGB_TO_LMS = ((0.3811, 0.5783, 0.0402), (0.1967, 0.7244, 0.0782), (0.0241, 0.1228, 0.8444))
XYZ_TO_LMS = ((0.3897, 0.6890, -0.0787), (-0.2298, 1.1834, 0.0464), (0.0, 0.0, 0.0))
WHITE_D65 = (95.047, 100.0, 108.883)
LAB_LIMIT = 0.008856


def apply_matrix(matrix: Sequence[Sequence[float]], *columns: Column) -> tuple[Column, ...]:
    """Matrix times the vector of columns."""
    out = []
    for row in matrix:
        terms = [c * w for w, c in zip(row, columns, strict=True)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        out.append(total)
    return tuple(out)


def inverse(m: Sequence[Sequence[float]]) -> tuple[tuple[float, ...], ...]:
    """Inverse of a 3 by 3 matrix by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cofactors = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in cofactors)


def yiq(red, green, blue):
    return apply_matrix(YIQ, red, green, blue)


def yiq_to_rgb(y, i, q):
    return apply_matrix(inverse(YIQ), y, i, q)


def ycbcr(red, green, blue):
    return tuple(c + o for c, o in zip(apply_matrix(YCBCR, red, green, blue), YCBCR_OFFSET, strict=True))


def xyz(red, green, blue, method: str = "reinhard"):
    return apply_matrix(XYZ_FORD if method == "ford" else XYZ_REINHARD, red, green, blue)


def rgb_to_lms(red, green, blue):
    return apply_matrix(RGB_TO_LMS, red, green, blue)


def xyz_to_lms(x, y, z):
    return apply_matrix(XYZ_TO_LMS, x, y, z)


def lms_to_lab(l, m, s):  # noqa: E741
    """The decorrelated axes of logarithmic cone responses."""
    return (l + m + s) * (1 / math.sqrt(3)), (l + m - 2 * s) * (1 / math.sqrt(6)), (l - m) * (1 / math.sqrt(2))


def _lab_part(share: Column) -> Column:
    return F.when(share > LAB_LIMIT, F.pow(share, F.lit(1 / 3))).otherwise(share * 7.787 + 16 / 116)


def xyz_to_lab(x, y, z):
    """CIE L*a*b* against the daylight white."""
    xn, yn, zn = (c / w for c, w in zip((x, y, z), WHITE_D65, strict=True))
    lightness = F.when(yn <= LAB_LIMIT, yn * 903.3).otherwise(F.pow(yn, F.lit(1 / 3)) * 116)
    return lightness, (_lab_part(xn) - _lab_part(zn)) * 500, (_lab_part(yn) - _lab_part(zn)) * 200


def lab_to_lch(l, a, b):  # noqa: E741
    """Chroma, and hue in radians from 0 to 2 pi."""
    return F.hypot(a, b), F.pmod(F.atan2(b, a) + 2 * math.pi, F.lit(2 * math.pi))


def hsi(red, green, blue):
    """Hue (0 to 1), saturation and intensity of scaled bands."""
    first = (red + green) * (-math.sqrt(6) / 6) + blue * (-math.sqrt(6) / 3)
    second = red * (1 / math.sqrt(6)) - green * (2 / math.sqrt(6))
    return F.pmod(F.atan2(first, second) / math.pi, F.lit(1.0)), F.hypot(first, second), (red + green + blue) / 3


def erdas_hsi(blue, green, red):
    """Hue, saturation and intensity by the extremes of the bands; of equal bands red goes before green before blue."""
    low, high = F.least(blue, green, red), F.greatest(blue, green, red)
    intensity = (high + low) / 2
    saturation = F.when(intensity == 0, 0.0).when(intensity <= 0.5, F.try_divide(high - low, high + low)).otherwise(F.try_divide(high - low, 2 - high + low))
    hue = F.when(red == high, (blue - green + 2) / 6).when(green == high, (red - blue + 4) / 6).otherwise((green - red + 6) / 6)
    return hue, saturation, intensity


def hcv(blue, green, red):
    """Hue, chroma and value of scaled bands; chroma by the sine where the cosine is small."""
    value = (red + green + blue) * 0.3
    hue = F.atan2(red - blue, (value - green) * math.sqrt(3))
    by_cosine = F.try_divide(value - green, F.cos(hue))
    by_sine = F.try_divide(red - blue, F.sin(hue) * math.sqrt(3))
    return hue, F.when(F.abs(F.cos(hue)) <= 0.2, by_sine).otherwise(by_cosine), value


def hcv_to_rgb(hue, chroma, value):
    third = 2 * math.pi / 3
    return value - chroma * F.cos(hue - third), value - chroma * F.cos(hue), value - chroma * F.cos(hue + third)
