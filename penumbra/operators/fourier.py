"""Two-dimensional Fourier transforms of rasters, and what is done with them.

The rows of a stripe are transformed in one task, a shuffle then deals columns
out, and the columns of a stripe are transformed in another: a task holds a
stripe and never a raster. Stripes travel as bytes, so a shuffle carries few
rows; a stripe holds at most ``CELLS`` cells, and one row or column at least.

Spectra are rows (raster_id, u, v, re, im) with the zero frequency at (0, 0), as
``numpy.fft`` leaves them, so that the weights of ``functions.tapers`` apply.
Missing and null pixels count as zero.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a stripe.
CELLS = 1 << 21


def _stripes(size: int, other: int) -> int:
    """Lines of a stripe, of ``size`` lines that are ``other`` cells long."""
    return max(1, min(size, CELLS // max(1, other)))


def _rows_done(cells: pd.DataFrame, shape: tuple[int, int], tall: int, wide: int, bands: int, inverse: bool, real: bool) -> pd.DataFrame:
    """Transform the rows of a stripe; its columns leave in stripes of their own."""
    first = int(cells["a"].iloc[0]) // tall * tall
    lines = min(tall, shape[0] - first)
    block = np.zeros((bands, lines, shape[1]), complex)
    a, b = cells["a"].to_numpy() - first, cells["b"].to_numpy()
    for k in range(bands):
        re = np.nan_to_num(cells[f"re_{k}"].to_numpy(float))
        block[k, a, b] = re if real else re + 1j * np.nan_to_num(cells[f"im_{k}"].to_numpy(float))
    block = (np.fft.ifft if inverse else np.fft.fft)(block, axis=2)
    left = range(0, shape[1], wide)
    return pd.DataFrame({"raster_id": cells["raster_id"].iloc[0], "stripe": [c // wide for c in left], "first": first, "lines": lines, "data": [np.ascontiguousarray(block[:, :, c : c + wide]).tobytes() for c in left]})


def _columns_done(parts: pd.DataFrame, shape: tuple[int, int], wide: int, bands: int, inverse: bool) -> pd.DataFrame:
    """Put a stripe of columns together, transform it, and give its cells."""
    left = int(parts["stripe"].iloc[0]) * wide
    columns = min(wide, shape[1] - left)
    block = np.zeros((bands, shape[0], columns), complex)
    for first, lines, data in zip(parts["first"], parts["lines"], parts["data"], strict=True):
        block[:, first : first + lines] = np.frombuffer(data, complex).reshape(bands, lines, columns)
    block = (np.fft.ifft if inverse else np.fft.fft)(block, axis=1)
    a, b = np.indices((shape[0], columns)).reshape(2, -1)
    out = {"raster_id": parts["raster_id"].iloc[0], "a": a, "b": b + left}
    for k in range(bands):
        out |= {f"re_{k}": block[k].real.ravel(), f"im_{k}": block[k].imag.ravel()}
    return pd.DataFrame(out)


def _transformed(cells: DataFrame, shape: tuple[int, int], bands: int, inverse: bool, real: bool) -> DataFrame:
    """Cells (raster_id, a, b, re_0, im_0, re_1, ...) of the transform."""
    kind = dict(cells.dtypes)["raster_id"]
    inside = cells.filter(F.col("a").between(0, shape[0] - 1) & F.col("b").between(0, shape[1] - 1))
    tall, wide = _stripes(shape[0], shape[1]), _stripes(shape[1], shape[0])
    rows = inside.groupBy("raster_id", F.floor(F.col("a") / tall)).applyInPandas(
        lambda cells: _rows_done(cells, shape, tall, wide, bands, inverse, real), f"raster_id {kind}, stripe bigint, first bigint, lines bigint, data binary"
    )
    ddl = ", ".join(f"re_{k} double, im_{k} double" for k in range(bands))
    return rows.groupBy("raster_id", "stripe").applyInPandas(lambda parts: _columns_done(parts, shape, wide, bands, inverse), f"raster_id {kind}, a bigint, b bigint, {ddl}")


def spectra(pixels: DataFrame, shape: tuple[int, int], values: Sequence[str] = ("value",)) -> DataFrame:
    """(raster_id, u, v, re_0, im_0, ...) of the columns ``values`` of pixels (raster_id, i, j, ...), all in one pass."""
    cells = pixels.select("raster_id", F.col("i").cast("bigint").alias("a"), F.col("j").cast("bigint").alias("b"), *(F.col(v).cast("double").alias(f"re_{k}") for k, v in enumerate(values)))
    return _transformed(cells, shape, len(values), False, True).withColumnsRenamed({"a": "u", "b": "v"})


def spectrum(pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(raster_id, u, v, re, im) of pixels (raster_id, i, j, value)."""
    return spectra(pixels, shape).withColumnsRenamed({"re_0": "re", "im_0": "im"})


def images(cells: DataFrame, shape: tuple[int, int], names: Sequence[str]) -> DataFrame:
    """(raster_id, i, j, names) of spectra (raster_id, u, v, re_0, im_0, ...): the real parts of their inverse."""
    back = _transformed(cells.withColumnsRenamed({"u": "a", "v": "b"}), shape, len(names), True, False)
    return back.select("raster_id", F.col("a").alias("i"), F.col("b").alias("j"), *(F.col(f"re_{k}").alias(n) for k, n in enumerate(names)))


def image(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(raster_id, i, j, value) of a spectrum (raster_id, u, v, re, im)."""
    return images(cells.withColumnsRenamed({"re": "re_0", "im": "im_0"}), shape, ["value"])


def frequency(k: Column, size: int) -> Column:
    """Signed cycles over the whole axis; the middle one of an even axis counts as 0, as it has no direction."""
    signed = F.when(2 * k < size, k).when(2 * k > size, k - size).otherwise(F.lit(0))
    return signed.cast("double")


def low_pass(pixels: DataFrame, shape: tuple[int, int], weight: Column) -> DataFrame:
    """Pixels after their spectrum is weighed by an expression of the cell (u, v)."""
    cells = spectrum(pixels, shape)
    return image(cells.withColumns({"re": F.col("re") * weight, "im": F.col("im") * weight}), shape)


def flow_parts(field: DataFrame, shape: tuple[int, int], x: str = "dx", y: str = "dy") -> DataFrame:
    """(raster_id, i, j, turning_x, turning_y, spreading_x, spreading_y): a field without sources and one without turn, which add up to the field.

    The Helmholtz-Hodge decomposition on a raster whose borders meet: the
    spreading part is the projection of each frequency on its own direction.
    x is along rows, y along columns downwards. The mean belongs to the turning
    part. Where x or y is null, the parts are null and the field counts as zero.
    """
    rows, columns = shape
    known = field.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("raster_id", "i", "j", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = spectra(known, shape, ["x", "y"])
    # frequencies by length, so that directions are those of the plane
    wx, wy = frequency(F.col("v"), columns) / columns, frequency(F.col("u"), rows) / rows
    power = wx * wx + wy * wy

    def along(part: str) -> Column:
        return F.coalesce(F.try_divide(wx * F.col(f"{part}_0") + wy * F.col(f"{part}_1"), power), F.lit(0.0))

    directed = cells.withColumns({"re": along("re"), "im": along("im")})
    spread = directed.select("raster_id", "u", "v", (wx * F.col("re")).alias("re_0"), (wx * F.col("im")).alias("im_0"), (wy * F.col("re")).alias("re_1"), (wy * F.col("im")).alias("im_1"))
    met = known.join(images(spread, shape, ["sx", "sy"]), ["raster_id", "i", "j"])
    parts = met.select("raster_id", "i", "j", (F.col("x") - F.col("sx")).alias("turning_x"), (F.col("y") - F.col("sy")).alias("turning_y"), F.col("sx").alias("spreading_x"), F.col("sy").alias("spreading_y"))
    empty = field.filter(F.col(x).isNull() | F.col(y).isNull()).select("raster_id", "i", "j")
    return parts.unionByName(empty, allowMissingColumns=True)


def periodic_parts(pixels: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(raster_id, i, j, periodic, smooth): an image whose borders meet, and the smooth rest.

    The smooth part solves Poisson's equation for the jumps between opposite
    borders. Null pixels count as zero.
    """
    rows, columns = shape
    filled = pixels.select("raster_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))

    def jumps(k: str, last: int) -> DataFrame:
        """The value of the opposite border less the own, at both borders of an axis."""
        border = filled.filter(F.col(k).isin(0, last))
        opposite = border.select("raster_id", (last - F.col(k)).alias(k), F.col("j" if k == "i" else "i"), F.col("value").alias("other"))
        return border.join(opposite, ["raster_id", "i", "j"]).select("raster_id", "i", "j", (F.col("other") - F.col("value")).alias("value"))

    border = jumps("i", rows - 1).unionByName(jumps("j", columns - 1)).groupBy("raster_id", "i", "j").agg(F.sum("value").alias("value"))
    bend = 2 * F.cos(F.col("u") * (2 * math.pi / rows)) + 2 * F.cos(F.col("v") * (2 * math.pi / columns)) - 4
    solved = F.when((F.col("u") == 0) & (F.col("v") == 0), F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), bend))
    smooth = low_pass(border, shape, solved).withColumnRenamed("value", "smooth")
    joined = filled.join(smooth, ["raster_id", "i", "j"], "left").withColumn("smooth", F.coalesce("smooth", F.lit(0.0)))
    return joined.select("raster_id", "i", "j", (F.col("value") - F.col("smooth")).alias("periodic"), "smooth")


def surface_of_shading(pixels: DataFrame, shape: tuple[int, int], tilt: float, slant: float, spacing: float = 1.0) -> DataFrame:
    """(raster_id, i, j, value): relative heights whose linear shading the image is.

    Heights under a sun of azimuth ``tilt`` and zenith ``slant`` (degrees) shine
    as their slope towards it, so each frequency is divided by what that slope
    does to it. Frequencies at right angles to the sun leave no trace and get 0.
    """
    rows, columns = shape
    a, z = math.radians(tilt), math.radians(slant)
    wx, wy = frequency(F.col("v"), columns) * (2 * math.pi / (columns * spacing)), frequency(F.col("u"), rows) * (2 * math.pi / (rows * spacing))
    slope = wx * (math.cos(a) * math.sin(z)) + wy * (math.sin(a) * math.sin(z))
    some = F.abs(slope) > 1e-12
    # (re + i im) / (i slope)
    cells = spectrum(pixels, shape).withColumns({"re": F.when(some, F.col("im") / slope).otherwise(F.lit(0.0)), "im": F.when(some, -F.col("re") / slope).otherwise(F.lit(0.0))})
    return image(cells, shape)
