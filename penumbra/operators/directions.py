"""Tests of directions and of displacement errors by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The circle is cut into so many slices, which are ordered one by one.
SLICES = 3600


def spacing_tests(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """``keys``, n, Rao's spacing statistic ``rao`` (degrees) and Kuiper's statistic ``kuiper`` of angles in degrees.

    Equal angles are counted first, then each slice of a group's circle is
    ordered by itself, and the slices of a group (``SLICES`` at most) are put
    together; no task orders a whole group. Null and non-finite angles are left
    out; one angle has spacing 180.
    """
    named = {f"k{at}": F.col(f"`{k}`") for at, k in enumerate(keys)}
    groups = list(named)
    value = F.col(f"`{angle}`").cast("double")
    rows = df.select(*(c.alias(k) for k, c in named.items()), F.pmod(value, F.lit(360.0)).alias("a")).filter("a IS NOT NULL AND NOT isnan(a)")
    counts = rows.groupBy(*groups, F.floor(F.col("a") * (SLICES / 360)).alias("slice"), "a").agg(F.count("*").alias("m"))
    cut = counts.groupBy(*groups, "slice").agg(F.sum("m").alias("held"))
    group = Window.partitionBy(*groups)
    upto = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select(*(F.col(k).alias(f"of_{k}") for k in groups), F.col("slice").alias("of_slice"), F.sum("held").over(group).alias("n"), F.coalesce(F.sum("held").over(upto), F.lit(0)).alias("before"))
    same = F.col("slice") == F.col("of_slice")
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    met = counts.join(placed, same)

    inside = Window.partitionBy(*groups, "slice").orderBy("a")
    last = F.col("before") + F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    share, mean = F.col("a") / 360, F.lit(360.0) / F.col("n")
    gaps = met.select(
        *groups, "slice", "a", "n",
        (last / F.col("n") - share).alias("over"), (share - (last - F.col("m")) / F.col("n")).alias("under"),
        ((F.col("m") - 1) * mean + F.coalesce(F.abs(F.col("a") - F.lag("a").over(inside) - mean), F.lit(0.0))).alias("off"),
    )
    parts = gaps.groupBy(*groups, "slice").agg(
        F.first("n").alias("n"), F.min("a").alias("first"), F.max("a").alias("last"), F.max("over").alias("over"), F.max("under").alias("under"), F.sum("off").alias("off"),
    )
    between = F.abs(F.col("first") - F.lag("last").over(group.orderBy("slice")) - F.lit(360.0) / F.col("n"))
    whole = parts.withColumn("between", F.coalesce(between, F.lit(0.0))).groupBy(*groups).agg(
        F.first("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("over").alias("over"), F.max("under").alias("under"), F.sum(F.col("off") + F.col("between")).alias("off"),
    )
    around = F.abs(360 - (F.col("last") - F.col("first")) - F.lit(360.0) / F.col("n"))
    rao = F.when(F.col("n") == 1, F.lit(180.0)).otherwise(0.5 * (F.col("off") + around))
    return whole.select(*(F.col(k).alias(name) for k, name in zip(groups, keys, strict=True)), "n", rao.alias("rao"), (F.sqrt("n") * (F.col("over") + F.col("under"))).alias("kuiper"))


def share_in_ellipse(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float = 1.0) -> DataFrame:
    """``keys``, n and the share ``inside`` of displacements (x, y) within the error ellipse of their group's covariance times ``scale``.

    Rows with a null displacement are left out; a group whose covariance has no
    inverse has a null share. Moments merged from several tasks leave a trace of
    rounding where a displacement doesn't vary; there they are 0.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(*(F.col(k).alias(f"k{at}") for at, k in enumerate(keys)), F.col(x).alias("x"), F.col(y).alias("y"))
    groups = [f"k{at}" for at in range(len(keys))]
    fixed = {c: F.min(c) == F.max(c) for c in "xy"}
    moments = {"xx": (F.var_samp("x"), fixed["x"]), "yy": (F.var_samp("y"), fixed["y"]), "xy": (F.covar_samp("x", "y"), fixed["x"] | fixed["y"])}
    sums = rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in groups)).agg(*(F.when(still & m.isNotNull(), F.lit(0.0)).otherwise(m).alias(n) for n, (m, still) in moments.items()))
    same = F.lit(True)
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    distance = F.expr("try_divide(x * x * yy - 2 * x * y * xy + y * y * xx, xx * yy - xy * xy)") / scale
    measured = rows.join(sums, same).select(*(F.col(k).alias(name) for k, name in zip(groups, keys, strict=True)), distance.alias("d"))
    return measured.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("d") < 1).cast("double")).alias("inside"))
