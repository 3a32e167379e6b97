"""Band indices as column expressions.

Every function takes columns of reflectance and gives a column; a division by
zero gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from penumbra.functions.colour import erdas_hsi, hcv, hsi, ycbcr, yiq


def ratio(over: Column, under: Column) -> Column:
    """Division that gives null where the divisor is zero."""
    return F.try_divide(over, under)


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


# vegetation and water colour

def floating_algae(red, nir, swir, red_um: float, nir_um: float, swir_um: float) -> Column:
    """Near infrared above the line between red and short-wave infrared."""
    return nir - (red + (swir - red) * ((nir_um - red_um) / (swir_um - red_um)))


def alternative_floating_algae(red, rededge, nir) -> Column:
    return ratio(nir - red, rededge - red)


def ndvi(red, nir) -> Column:
    return normalized_difference(nir, red)


def infrared_percentage(red, nir) -> Column:
    return ratio(nir, nir + red)


def renormalized_difference(red, nir) -> Column:
    return ratio(nir - red, F.sqrt(nir + red))


def simple_ratio(red, nir) -> Column:
    return ratio(red, nir)


def modified_simple_ratio(red, nir) -> Column:
    return ratio(ratio(red, nir) - 1, F.sqrt(ratio(red, nir) + 1))


def visible_resistant(blue, green, red) -> Column:
    return ratio(green - red, green + red - blue)


def soil_adjusted(red, nir, soil: float = 0.5) -> Column:
    return ratio((nir - red) * (1 + soil), nir + red + soil)


def modified_soil_adjusted(red, nir) -> Column:
    doubled = 2 * nir + 1
    return (doubled - F.sqrt(doubled * doubled - 8 * (nir - red))) * 0.5


def atmospherically_resistant(blue, red, nir, gamma: float = 1.0, soil: float = 0.5) -> Column:
    corrected = red - (blue - red) * gamma
    return ratio((nir - corrected) * (1 + soil), nir + corrected + soil)


def chlorophyll_absorption(green, red, rededge) -> Column:
    return (rededge - red - (rededge - green) * 0.2) * ratio(red, green)


def triangular(green, red, rededge) -> Column:
    return ((rededge - green) * 120 - (red - green) * 200) * 0.5


def enhanced_vegetation(blue, red, nir, gain: float = 2.5, offset: float = 1.0, c1: float = 6.0, c2: float = 7.5) -> Column:
    return ratio(nir - red, nir + red * c1 - blue * c2 + offset) * gain


# snow

def snow_cover_fraction(nir, swir) -> Column:
    return ratio(nir, swir)


def snow_fraction(red, swir) -> Column:
    return ratio(red, swir)


def snow_index(green, swir) -> Column:
    return normalized_difference(green, swir)


def snow_ice_index(red, swir) -> Column:
    return normalized_difference(red, swir)


def s3(red, nir, swir) -> Column:
    return ratio(nir * (red - swir), (red + nir) * (red + swir))


def snow_water(green, nir, swir) -> Column:
    return ratio(green * (nir - swir), (green + nir) * (nir + swir))


def glacier_extraction(red, nir, swir, alpha: float = 0.5) -> Column:
    return ratio(red * alpha + nir * (1 - alpha), swir)


# water

def water_index(green, nir) -> Column:
    """Zero, not null, where both bands are zero."""
    return F.coalesce(normalized_difference(green, nir), F.lit(0.0))


def modified_water(green, swir) -> Column:
    return normalized_difference(green, swir)


def moisture(nir, swir) -> Column:
    return normalized_difference(nir, swir)


def blue_water(blue, nir) -> Column:
    return normalized_difference(blue, nir)


# shadow

def chroma_blue(blue, green, red) -> Column:
    """Blue difference against luma."""
    y, cb, _ = ycbcr(red, green, blue)
    return normalized_difference(cb, y)


def hsv_fraction(blue, green, red) -> Column:
    h, _, i = hsi(red, green, blue)
    return ratio(h + 1, i + 1)


def hcv_fraction(blue, green, red) -> Column:
    h, _, v = hcv(blue, green, red)
    return ratio(h + 1, v + 1)


def ycbcr_fraction(blue, green, red) -> Column:
    y, _, cr = ycbcr(red, green, blue)
    return ratio(cr + 1, y + 1)


def yiq_fraction(blue, green, red) -> Column:
    y, _, q = yiq(red, green, blue)
    return ratio(q + 1, y + 1)


def saturation_intensity(blue, green, red) -> Column:
    _, s, i = hsi(red, green, blue)
    return normalized_difference(s, i)


def improved_shadow(blue, green, red, nir) -> Column:
    base = saturation_intensity(blue, green, red) + 1
    return normalized_difference(base, nir)


def shadow_enhancement(blue, green, red, nir) -> Column:
    return normalized_difference(blue + nir, green + red)


def false_colour_shadow(green, red, nir) -> Column:
    return saturation_intensity(green, red, nir)


def combinational_shadow(blue, green, red, nir) -> Column:
    enhancement, water = shadow_enhancement(blue, green, red, nir), water_index(green, nir)
    return enhancement - F.when(nir >= water, nir).otherwise(water)


def shadow_identification(blue, green, red) -> Column:
    _, s, i = hsi(red, green, blue)
    return s - i


def saturation_double_intensity(blue, rededge, nir) -> Column:
    _, s, i = erdas_hsi(blue, rededge, nir)
    return s - 2 * i


def mixed_property(blue, green, red) -> Column:
    h, _, i = hsi(red, green, blue)
    return (h - i) * (green - blue)


def colour_invariant(blue, green, red) -> Column:
    return F.atan2(blue, F.greatest(red, green))


def modified_colour_invariant(blue, green, red, nir) -> Column:
    return colour_invariant(blue, green, red) * water_index(green, nir)


def shade_index(*bands) -> Column:
    out = F.lit(1.0)
    for band in bands:
        out *= 1 - band
    return out


def range_shadow(*bands) -> Column:
    return normalized_difference(F.greatest(*bands), F.least(*bands))


def fractional_range_shadow(*bands) -> Column:
    return ratio(F.least(*bands), F.greatest(*bands))


#: Short codes of shadow transforms with the bands each needs.
SHADOW_TRANSFORMS: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {
    "siz": (chroma_blue, ("blue", "green", "red")),
    "shsv": (hsv_fraction, ("blue", "green", "red")),
    "shcv": (hcv_fraction, ("blue", "green", "red")),
    "sycbcr": (ycbcr_fraction, ("blue", "green", "red")),
    "syiq": (yiq_fraction, ("blue", "green", "red")),
    "isi": (improved_shadow, ("blue", "green", "red", "nir")),
    "sei": (shadow_enhancement, ("blue", "green", "red", "nir")),
    "fcsdi": (false_colour_shadow, ("green", "red", "nir")),
    "csi": (combinational_shadow, ("blue", "green", "red", "nir")),
    "nsvdi": (saturation_intensity, ("blue", "green", "red")),
    "sil": (shadow_identification, ("blue", "green", "red")),
    "mpsi": (mixed_property, ("blue", "green", "red")),
    "c3": (colour_invariant, ("blue", "green", "red")),
    "gevers": (modified_colour_invariant, ("blue", "green", "red", "nir")),
    "shi": (shade_index, ("blue", "green", "red", "nir")),
    "nri": (range_shadow, ("blue", "green", "red", "nir")),
    "fri": (fractional_range_shadow, ("blue", "green", "red", "nir")),
}


def shadow_transform(code: str, **bands: Column) -> Column:
    """A shadow transform by its code."""
    if code not in SHADOW_TRANSFORMS:
        raise ValueError(f"no shadow transform {code}; there are {', '.join(SHADOW_TRANSFORMS)}")
    function, names = SHADOW_TRANSFORMS[code]
    return function(*(bands[n] for n in names))
