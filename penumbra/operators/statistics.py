"""Robust filters, running tests and directional statistics.

Filters mark the inliers of each group by two aggregations joined back, so a
group of any size is neither sorted nor gathered in one task beyond what an
exact median needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.store import settle


def _joined(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    keys = list(keys)
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))  # a single row
    return df.join(df.groupBy(*keys).agg(*aggregates), keys)


def sigma_filter(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """``inlier``: nearer to the mean than so many population standard deviations."""
    joined = _joined(df, keys, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return joined.withColumn("inlier", F.abs(F.col(value) - F.col("_m")) < F.col("_s") * limit).drop("_m", "_s")


def weighted_sigma_filter(df: DataFrame, keys: Sequence[str], value: str, weight: str, limit: float = 3.0) -> DataFrame:
    """The same with weighted mean and deviation."""
    w, v = F.col(weight), F.col(value)
    first = _joined(df, keys, (F.sum(w * v) / F.sum(w)).alias("_m"))
    keys = list(keys)
    spread = F.sqrt(F.sum(w * F.pow(v - F.col("_m"), F.lit(2))) / F.sum(w)).alias("_s")
    return _joined(first, keys, spread).withColumn("inlier", F.abs(v - F.col("_m")) < F.col("_s") * limit).drop("_m", "_s")


def mad_filter(df: DataFrame, keys: Sequence[str], value: str, limit: float = 1.4826) -> DataFrame:
    """``inlier``: strictly within the median plus or minus ``limit`` median absolute deviations."""
    with_median = _joined(df, keys, F.median(value).alias("_m"))
    with_mad = _joined(with_median, keys, F.median(F.abs(F.col(value) - F.col("_m"))).alias("_d"))
    low, high = F.col("_m") - F.col("_d") * limit, F.col("_m") + F.col("_d") * limit
    return with_mad.withColumn("inlier", (F.col(value) > low) & (F.col(value) < high)).drop("_m", "_d")


def standardize(df: DataFrame, keys: Sequence[str], value: str, robust: bool = False) -> DataFrame:
    """``score``: distance from the mean in deviations, or from the median in median absolute deviations."""
    if not robust:
        joined = _joined(df, keys, F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
        return joined.withColumn("score", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    with_median = _joined(df, keys, F.median(value).alias("_m"))
    with_mad = _joined(with_median, keys, F.median(F.abs(F.col(value) - F.col("_m"))).alias("_s"))
    return with_mad.withColumn("score", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def huber_weight(residual: Column, limit: float = 1.345) -> Column:
    return F.lit(1.0) / F.greatest(F.lit(1.0), F.abs(residual) / limit)


def cauchy_weight(residual: Column, limit: float = 2.385) -> Column:
    return F.lit(1.0) / (1 + F.pow(residual / limit, F.lit(2)))


def prefix_tests(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """For each row the statistics of the rows before it and with it: ``t`` of the means and ``f`` of the variances."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    t = F.try_divide(F.avg(v).over(upto) - F.avg(v).over(before), F.sqrt(F.var_pop(v).over(upto) / F.count(v).over(upto)))
    f = F.try_divide(F.var_pop(v).over(before), F.var_pop(v).over(upto))
    return df.withColumns({"t": t, "f": f})


def steady_state(values: Column, lambda_1: float = 0.2, lambda_2: float = 0.1, lambda_3: float = 0.1) -> Column:
    """The steady-state ratio after an array of values in order of time.

    Exponential averages of the value, of its squared distance from the average
    and of squared steps; near 1 the series is steady.
    """
    start = F.struct(values[0].cast("double").alias("x"), F.lit(0.0).alias("v"), F.lit(0.0).alias("d"), values[0].cast("double").alias("last"))

    def step(state: Column, y: Column) -> Column:
        v = F.pow(y - state["x"], F.lit(2)) * lambda_2 + state["v"] * (1 - lambda_2)
        d = F.pow(y - state["last"], F.lit(2)) * lambda_3 + state["d"] * (1 - lambda_3)
        return F.struct((y * lambda_1 + state["x"] * (1 - lambda_1)).alias("x"), v.alias("v"), d.alias("d"), y.alias("last"))

    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda s: F.try_divide(s["v"] * (2 - lambda_1), s["d"]))


#: Values of a series that are put together in one row.
CHUNK = 4096


def steady_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lambda_1: float = 0.2, lambda_2: float = 0.1, lambda_3: float = 0.1) -> DataFrame:
    """(keys, n, ratio): the steady-state ratio of each series, however long.

    Series are dealt out by ranges of their order and cut into chunks. What a
    chunk does to the averages depends on the average x and the last value
    before it alone: x goes to g x + h, its variance to k v + a x^2 + b x + c, and
    the squared step to k d + the first step + e. Chunks are reduced to these
    numbers, which are then applied in order. Null values are left out.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter(F.col(value).isNotNull()).select(*keys, *(F.col(o).alias(f"order_{at}") for at, o in enumerate(order)), F.col(value).cast("double").alias("y"))
    line = [f"order_{at}" for at in range(len(order))]
    ranged = settle(rows.repartitionByRange(parts, *keys, *line).withColumn("part", F.spark_partition_id()), "ranged")
    place = F.row_number().over(Window.partitionBy("part", *keys).orderBy(*line))
    chunks = ranged.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy(*keys, "part", "chunk").agg(F.sort_array(F.collect_list(F.struct(*line, "y"))).alias("values"))
    values = F.transform("values", lambda v: v["y"])
    fade_1, fade_2, fade_3 = 1 - lambda_1, 1 - lambda_2, 1 - lambda_3

    def step(s: Column, y: Column) -> Column:
        # the average before y is g x + h
        off = y - s["h"]
        return F.struct(
            (s["g"] * fade_1).alias("g"), (y * lambda_1 + s["h"] * fade_1).alias("h"),
            (s["a"] * fade_2 + s["g"] * s["g"] * lambda_2).alias("a"), (s["b"] * fade_2 - s["g"] * off * (2 * lambda_2)).alias("b"), (s["c"] * fade_2 + off * off * lambda_2).alias("c"),
            F.when(s["seen"], s["e"] * fade_3 + F.pow(y - s["last"], F.lit(2)) * lambda_3).otherwise(F.lit(0.0)).alias("e"), y.alias("last"), F.lit(True).alias("seen"),
        )

    start = F.struct(F.lit(1.0).alias("g"), F.lit(0.0).alias("h"), *(F.lit(0.0).alias(c) for c in "abce"), F.lit(0.0).alias("last"), F.lit(False).alias("seen"))
    reduced = chunks.select(*keys, "part", "chunk", values[0].alias("first"), F.size("values").cast("double").alias("m"), F.aggregate(values, start, step).alias("s"))

    def apply(s: Column, c: Column) -> Column:
        t, m = c["s"], c["m"]
        jump = F.pow(c["first"] - s["last"], F.lit(2)) * lambda_3 * F.pow(F.lit(fade_3), m - 1)
        later = F.struct(
            (t["g"] * s["x"] + t["h"]).alias("x"), (s["v"] * F.pow(F.lit(fade_2), m) + t["a"] * s["x"] * s["x"] + t["b"] * s["x"] + t["c"]).alias("v"),
            (s["d"] * F.pow(F.lit(fade_3), m) + jump + t["e"]).alias("d"), t["last"].alias("last"), (s["n"] + m).alias("n"),
        )
        return later

    gathered = reduced.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("part", "chunk", "first", "m", "s"))).alias("chunks"))  # a few numbers a chunk
    # a series begins at its first value, as if that had come before
    begin = F.struct(F.get("chunks.first", F.lit(0)).alias("x"), F.lit(0.0).alias("v"), F.lit(0.0).alias("d"), F.get("chunks.first", F.lit(0)).alias("last"), F.lit(0.0).alias("n"))
    end = F.aggregate("chunks", begin, apply)
    return gathered.select(*keys, end.alias("s")).select(*keys, F.col("s.n").cast("long").alias("n"), F.try_divide(F.col("s.v") * (2 - lambda_1), F.col("s.d")).alias("ratio"))


def directional_statistics(df: DataFrame, keys: Sequence[str], angle: str, expected: float = 0.0) -> DataFrame:
    """Rayleigh's z and the V statistic of angles in degrees, with the mean direction."""
    a = F.radians(angle)
    sums = df.filter(F.col(angle).isNotNull()).groupBy(*keys).agg(F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"), F.count("*").alias("n"))
    length = F.hypot("c", "s") / F.col("n")
    mean = F.atan2("s", "c")
    v = length * F.cos(mean - math.radians(expected)) * F.sqrt(F.col("n") * 2)
    return sums.select(*keys, "n", length.alias("resultant"), F.degrees(mean).alias("direction"), (F.col("n") * length * length).alias("rayleigh"), v.alias("v_test"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Counts by bin of a width, with each bin's share and the cumulative share."""
    counts = df.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    return counts.withColumns({"share": F.col("n") / total, "cumulative": F.sum("n").over(upto) / total})


def entropy(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """Shannon's entropy (natural) of the histogram of each group."""
    return histogram(df, keys, value, width).groupBy(*keys).agg(F.sum(-F.col("share") * F.log("share")).alias("entropy"))


def normal_sums(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line of each group."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("corr"), F.count("*").alias("n"))


def fit_sinus(df: DataFrame, angle: str, value: str) -> tuple[float, float, float]:
    """Phase (degrees), amplitude and bias of the sine through the values; the nine normal sums reach the driver."""
    import numpy as np

    a = F.radians(angle)
    basis = {"s": F.sin(a), "c": F.cos(a), "o": F.lit(1.0)}
    sums = df.agg(*(F.sum(p * q).alias(m + n) for m, p in basis.items() for n, q in basis.items()), *(F.sum(p * F.col(value)).alias(f"{m}_y") for m, p in basis.items())).first()
    matrix = np.array([[sums[m + n] for n in basis] for m in basis])
    s, c, o = np.linalg.solve(matrix, np.array([sums[f"{m}_y"] for m in basis]))
    return float(np.degrees(np.arctan2(c, s))), float(np.hypot(s, c)), float(o)
