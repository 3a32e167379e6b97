"""Statistics of values by label, and hypsometry. All are one aggregation with map-side combining, but medians, which Spark computes exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.operators.pairing import numbered


def valid(column: str) -> Column:
    """Neither null nor not-a-number."""
    return F.col(column).isNotNull() & ~F.isnan(column)


def zonal(df: DataFrame, labels: str | Sequence[str], value: str, statistics: Mapping[str, Column]) -> DataFrame:
    """Each label with the statistics (named aggregates) of its valid values, and their number."""
    keys = [labels] if isinstance(labels, str) else list(labels)
    return df.filter(valid(value)).groupBy(*keys).agg(*(c.alias(n) for n, c in statistics.items()), F.count("*").alias("n"))


def zonal_matrix(df: DataFrame, rows: str, cols: str, value: str, columns: Sequence, statistic=F.median) -> DataFrame:
    """One row for each label of ``rows`` and one column for each given label of ``cols``; 0 where there is nothing."""
    wide = df.filter(valid(value)).groupBy(rows).pivot(cols, list(columns)).agg(statistic(value))
    return wide.fillna(0.0)


def general_hypsometry(df: DataFrame, elevation: str, change: str, interval: float = 100.0) -> DataFrame:
    """Median change and count by elevation bin; the bin is its lower bound."""
    binned = df.filter(valid(change) & valid(elevation)).withColumn("bin", F.floor(F.col(elevation) / interval) * interval)
    return binned.groupBy("bin").agg(F.median(change).alias("median"), F.count("*").alias("n"))


def midpoint_altitude(df: DataFrame, label: str, elevation: str) -> DataFrame:
    return zonal(df, label, elevation, {"midpoint": F.percentile(elevation, 0.5)})


def kurowsky_altitude(df: DataFrame, label: str, elevation: str) -> DataFrame:
    return zonal(df, label, elevation, {"kurowsky": (F.max(elevation) + F.min(elevation)) / 2})


def hypsometric_index(df: DataFrame, label: str, elevation: str) -> DataFrame:
    """(max - median) / (median - min), null for a flat label."""
    middle = F.median(elevation)
    return zonal(df, label, elevation, {"index": F.try_divide(F.max(elevation) - middle, middle - F.min(elevation))})


def normalized_hypsometry(df: DataFrame, label: str, elevation: str, change: str, bins: int = 20) -> DataFrame:
    """Mean over labels of the median change in bins of each label's own elevation range.

    The ranges come from an aggregation that is joined back, so that a label of
    many rows isn't sorted in one task.
    """
    rows = df.filter(valid(elevation) & valid(change))
    ranges = rows.groupBy(label).agg(F.min(elevation).alias("_low"), F.max(elevation).alias("_high"))
    share = F.try_divide(F.col(elevation) - F.col("_low"), F.col("_high") - F.col("_low"))
    binned = rows.join(ranges, label).withColumn("bin", F.floor(share * (bins - 1)))
    medians = binned.filter("bin IS NOT NULL").groupBy(label, "bin").agg(F.median(change).alias("_median"))
    return medians.groupBy("bin").agg(F.avg("_median").alias("mean"), F.count("*").alias("labels"))


def ice_mass(df: DataFrame, lines: DataFrame, label: str, volume: str, elevation: str, above: float = 300.0, below: float = 900.0) -> DataFrame:
    """Volume times a density chosen by the label's equilibrium line (column ``ela`` of ``lines``); null without a line."""
    joined = df.join(lines, label, "left")
    density = F.when(F.col(elevation) > F.col("ela"), above).when(F.col("ela").isNotNull(), below)
    return joined.withColumn("mass", F.col(volume) * density)


def specific_hypsometries(df: DataFrame, label: str, elevation: str, change: str, interval: float, start: float, stop: float) -> DataFrame:
    """Median change by label and clamped elevation bin, with each label's count and rank by it."""
    clamped = F.least(F.greatest(F.col(elevation), F.lit(start)), F.lit(stop))
    binned = df.filter(valid(change)).withColumn("bin", F.floor(clamped / interval))
    cells = binned.groupBy(label, "bin").agg(F.median(change).alias("median"), F.count("*").alias("n"))
    totals = cells.groupBy(label).agg(F.sum("n").alias("total"))
    placed = numbered(totals.withColumn("fewer", -F.col("total")), ["fewer", label], "place").drop("fewer")
    return cells.join(placed, label)


def polynomial_fill(df: DataFrame, z: str, dz: str, degree: int = 3) -> list[float]:
    """Least-squares coefficients (constant first) of change against elevation, from power sums; at most 2 degree + 1 of them reach the driver."""
    import numpy as np

    rows = df.filter(valid(z) & valid(dz))
    centre = rows.agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s")).first()
    if centre["m"] is None:
        return []
    scale = centre["s"] or 1.0
    x = (F.col(z) - centre["m"]) / scale
    powers = [F.sum(F.pow(x, F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow(x, F.lit(k)) * F.col(dz)).alias(f"q{k}") for k in range(degree + 1)]
    sums = rows.agg(*powers).first()
    normal = np.array([[sums[f"p{a + b}"] for b in range(degree + 1)] for a in range(degree + 1)])
    scaled = np.linalg.lstsq(normal, np.array([sums[f"q{a}"] for a in range(degree + 1)]), rcond=None)[0]
    line = np.polynomial.Polynomial([-centre["m"] / scale, 1 / scale])
    total = sum((c * line**k for k, c in enumerate(scaled)), np.polynomial.Polynomial([0.0]))
    return [float(c) for c in total.coef]
