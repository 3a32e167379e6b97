"""Intensities of whole rasters: adjustments by their extremes, and histogram matching.

``keys`` name the columns that tell rasters apart; null values stay null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators.ranks import below


def _with_extreme(df: DataFrame, keys: Sequence[str], extreme: Column) -> DataFrame:
    """``df`` as ``row`` with one aggregate of its raster as ``extreme``."""
    found = df.groupBy(*(F.col(k).alias(f"key{n}") for n, k in enumerate(keys))).agg(extreme.alias("extreme"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    if not keys:
        return rows.crossJoin(F.broadcast(found))  # one row
    met = F.lit(True)
    for n, k in enumerate(keys):
        met &= F.col(f"row.{k}").eqNullSafe(F.col(f"key{n}"))
    return rows.join(found, met)


def log_adjusted(df: DataFrame, keys: Sequence[str], value: str, name: str, top: float = 65_535.0) -> DataFrame:
    """Low intensities enhanced: logarithms, cut to whole numbers, whose largest is ``top``."""
    rows = _with_extreme(df, keys, F.max(value))
    scaled = F.try_divide(F.lit(top), F.log1p(F.col("extreme").cast("double"))) * F.log1p(F.col(f"row.{value}").cast("double"))
    return rows.select("row.*", F.floor(scaled).alias(name))


def hyperbolic(df: DataFrame, keys: Sequence[str], value: str, name: str, intercept: float) -> DataFrame:
    """An inverse hyperbolic sine around ``intercept``, scaled by the raster's least value and at most 1."""
    rows = _with_extreme(df, keys, F.min(value))
    scaled = F.asinh((F.col(f"row.{value}") - intercept) * F.try_divide(F.lit(10.0), F.abs(F.col("extreme") - intercept))) / 3
    return rows.select("row.*", F.least(scaled, F.lit(1.0)).alias(name))


#: The range of shares is cut into so many slices, which are ordered one by one.
SLICES = 4096


def _quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with the share of pixels up to each; rasters of fewer than four values are left out."""
    counted = below(df, keys, value).filter("n >= 4")
    return counted.select(*keys, F.col(f"`{value}`").alias("of"), ((F.col("before") + F.col("m")).cast("double") / F.col("n")).alias("q"))


def _nearest_known(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the last ``known`` at or below their share q and the first at or above it.

    Each slice of shares is ordered by itself; what it doesn't know comes from
    the slices (``SLICES`` a raster) before and after it.
    """
    sliced = both.withColumn("slice", F.floor(F.col("q") * SLICES))
    ends = sliced.groupBy(*keys, "slice").agg(F.min("known").alias("first"), F.max("known").alias("last"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"from_below": F.last("last", ignorenulls=True).over(before), "from_above": F.last("first", ignorenulls=True).over(after)})
    met = sliced.join(ends.drop("first", "last"), [*keys, "slice"])
    up, down = (Window.partitionBy(*keys, "slice").orderBy(order, F.col("known").isNull()).rowsBetween(Window.unboundedPreceding, 0) for order in (F.asc("q"), F.desc("q")))
    return met.withColumns({"below": F.coalesce(F.last("known", ignorenulls=True).over(up), "from_below"), "above": F.coalesce(F.last("known", ignorenulls=True).over(down), "from_above")})


def match_histogram(image: DataFrame, reference: DataFrame, keys: Sequence[str], value: str, reference_value: str, name: str) -> DataFrame:
    """``image`` with its values mapped so that their distribution is the reference's.

    The quantile of a value is looked up among the reference's quantiles,
    linearly between two. Rasters where either side has fewer than four values
    keep theirs. ``keys`` are not null. Distinct values are ordered in ranges, so no
    task sees all those of a raster.
    """
    here, there = _quantiles(image, keys, value), _quantiles(reference, keys, reference_value)
    both = here.select(*keys, "q", "of", F.lit(None).cast("struct<q: double, v: double>").alias("known")).unionByName(
        there.select(*keys, "q", F.lit(None).cast("double").alias("of"), F.struct("q", F.col("of").cast("double").alias("v")).alias("known"))
    )
    near = _nearest_known(both, keys)
    near = near.filter("of IS NOT NULL AND (below IS NOT NULL OR above IS NOT NULL)")
    share = (F.col("q") - F.col("below.q")) / (F.col("above.q") - F.col("below.q"))
    mapped = F.when(F.col("below").isNull(), F.col("above.v")).when(F.col("above").isNull() | (F.col("above.q") == F.col("below.q")), F.col("below.v"))
    mapped = mapped.otherwise(F.col("below.v") + share * (F.col("above.v") - F.col("below.v")))
    table = near.select(*(F.col(k).alias(f"key{n}") for n, k in enumerate(keys)), F.col("of"), mapped.alias("mapped"))
    rows = image.select(F.struct(*(F.col(f"`{c}`") for c in image.columns)).alias("row"))
    met = F.col(f"row.{value}") == F.col("of")
    for n, k in enumerate(keys):
        met &= F.col(f"row.{k}") == F.col(f"key{n}")
    return rows.join(table, met, "left").select("row.*", F.coalesce("mapped", F.col(f"row.{value}").cast("double")).alias(name))
