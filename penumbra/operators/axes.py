"""First principal components of bands, affine fits and extents, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions.colour import hsi


def _largest(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """The largest eigenvalue of a symmetric matrix of three rows, by its angle."""
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    spread = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / 2
    cosine = F.greatest(F.least(F.try_divide(half, spread * spread * spread), F.lit(1.0)), F.lit(-1.0))
    return mean + 2 * spread * F.cos(F.acos(cosine) / 3)


def first_axis(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """(keys, largest, e1, e2, e3): the largest variance of three bands and its unit axis, whose sum is not negative.

    Covariances are one aggregation; the axis is the null space of the
    covariance less its largest eigenvalue. Rows with a null band take no part;
    an axis that is not determined is null.
    """
    x, y, z = (F.col(f"`{b}`") for b in bands)
    whole = df.filter(x.isNotNull() & y.isNotNull() & z.isNotNull())
    pairs = {"xx": (x, x), "yy": (y, y), "zz": (z, z), "xy": (x, y), "xz": (x, z), "yz": (y, z)}
    sums = whole.groupBy(*keys).agg(*(F.covar_samp(a, b).alias(n) for n, (a, b) in pairs.items()))
    sums = sums.withColumn("largest", _largest(*(F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz"))))
    a, b, c = (F.col(n) - F.col("largest") for n in ("xx", "yy", "zz"))
    xy, xz, yz = (F.col(n) for n in ("xy", "xz", "yz"))
    # the three products of two rows are all along the axis; the longest is the sharpest
    products = ((xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy), (xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz), (b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz))
    longest = F.greatest(*(F.struct((u * u + v * v + w * w).alias("n"), u.alias("u"), v.alias("v"), w.alias("w")) for u, v, w in products))
    out = sums.select(*keys, "largest", longest.alias("p"))
    size = F.sqrt("p.n") * F.when(F.col("p.u") + F.col("p.v") + F.col("p.w") < 0, -1.0).otherwise(1.0)
    return out.select(*keys, "largest", *(F.try_divide(F.col(f"p.{n}"), size).alias(f"e{k}") for k, n in enumerate("uvw", 1)))


def first_component(red: Column, green: Column, blue: Column) -> Column:
    """The value along an axis e1, e2, e3 that rows carry."""
    return F.col("e1") * red + F.col("e2") * green + F.col("e3") * blue


def component_shadow(blue: Column, green: Column, red: Column) -> Column:
    """Shadow index of the first component against intensity and saturation; null where its denominator is 0."""
    _, saturation, intensity = hsi(red, green, blue)
    first = first_component(red, green, blue)
    return F.try_divide((first - intensity) * (saturation + 1), first + intensity + saturation)


def shadow_detector(blue: Column, green: Column, red: Column) -> Column:
    """Shadow index of the first component against the spread of the bands; null where its denominator is 0."""
    return F.try_divide(2 - first_component(red, green, blue), (green - blue) * red + 1)


def fitted_transform(df: DataFrame, keys: Sequence[str], i: str = "i", j: str = "j", x: str = "x", y: str = "y") -> DataFrame:
    """The geotransform of each group in least squares, from pixels with map coordinates; null if the pixels lie on a line."""
    rows = df.select(*keys, *(F.col(f"`{c}`").cast("double").alias(n) for c, n in ((i, "i"), (j, "j"), (x, "x"), (y, "y")))).dropna(subset=["i", "j", "x", "y"])
    pairs = ("ii", "jj", "ij", "ix", "jx", "iy", "jy")
    sums = rows.groupBy(*keys).agg(*(F.covar_pop(p[0], p[1]).alias(p) for p in pairs), *(F.avg(c).alias(f"m_{c}") for c in "ijxy"))
    det = F.col("ii") * F.col("jj") - F.col("ij") * F.col("ij")
    steps = []
    for axis in "xy":
        by_j = F.try_divide(F.col(f"j{axis}") * F.col("ii") - F.col(f"i{axis}") * F.col("ij"), det)
        by_i = F.try_divide(F.col(f"i{axis}") * F.col("jj") - F.col(f"j{axis}") * F.col("ij"), det)
        steps += [(F.col(f"m_{axis}") - by_j * F.col("m_j") - by_i * F.col("m_i")).alias(f"{axis}0"), by_j.alias(f"d{axis}j"), by_i.alias(f"d{axis}i")]
    return sums.select(*keys, *steps)


def mask_extent(df: DataFrame, keys: Sequence[str], mask: Column) -> DataFrame:
    """(keys, i_min, i_max, j_min, j_max) of the pixels where ``mask`` holds; groups without one are left out."""
    return df.filter(mask).groupBy(*keys).agg(*(of(c).alias(f"{c}_{name}") for c in ("i", "j") for name, of in (("min", F.min), ("max", F.max))))

