"""The direction in which two bands hold least information, which takes illumination out of them.

Log ratios of bands move along one direction as light changes. Seen along that
direction the histogram is narrowest, so its entropy is least. All directions
are counted in one aggregation: pixels of equal values are counted first, go to
their bin of each direction together, and counts are added up before they are
shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_ratios(first: Column, second: Column, common: Column) -> tuple[Column, Column]:
    """Logarithms of two bands over the root of a third; bands of 0 count as 1e-6, and no light in the third gives 0."""

    def ratio(band: Column) -> Column:
        lit = F.when(band == 0, F.lit(1e-6)).otherwise(band)
        return F.when(common > 0, F.log(lit / F.sqrt(common))).otherwise(F.lit(0.0))

    return ratio(first), ratio(second)


def direction_entropies(df: DataFrame, keys: Sequence[str], x: str, y: str, directions: int = 180) -> DataFrame:
    """(keys, direction, n, entropy): entropy in bits of the histogram of x cos + y sin, for each whole step of half a turn.

    Bins are 3.5 standard deviations over the cube root of the pixels wide, by
    direction, and begin at 0. Rows without both values are left out. A
    direction without spread has one bin and entropy 0.
    """
    named = {f"k{at}": F.col(f"`{k}`") for at, k in enumerate(keys)}
    groups = list(named)
    rows = df.select(*(c.alias(k) for k, c in named.items()), F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    rows = rows.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    moments = rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in groups)).agg(F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    angles = F.array(*(F.struct(F.lit(a * 180.0 / directions).alias("direction"), F.lit(math.cos(math.pi * a / directions)).alias("c"), F.lit(math.sin(math.pi * a / directions)).alias("s")) for a in range(directions)))
    same = F.lit(True)
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    # pixels of equal values fall into equal bins
    places = rows.groupBy(*groups, "x", "y").agg(F.count("*").alias("one"))
    met = (places.join(moments, same) if groups else places.crossJoin(F.broadcast(moments))).withColumn("d", F.explode(angles))  # one row without keys
    spread = F.sqrt(F.greatest(F.expr("xx * d.c * d.c + 2 * xy * d.c * d.s + yy * d.s * d.s"), F.lit(0.0)))
    width = 3.5 * spread * F.pow("n", F.lit(-1 / 3))
    bins = F.when(width > 1e-12, F.floor(F.expr("x * d.c + y * d.s") / width)).otherwise(F.lit(0).cast("long"))
    counts = met.groupBy(*groups, "d.direction", "n", bins.alias("bin")).agg(F.sum("one").alias("m"))
    share = F.col("m") / F.col("n")
    found = counts.groupBy(*groups, "direction", "n").agg(F.sum(-share * F.log2(share)).alias("entropy"))
    return found.select(*(F.col(k).alias(name) for k, name in zip(groups, keys, strict=True)), "direction", "n", "entropy")


def least_entropy(df: DataFrame, keys: Sequence[str], x: str, y: str, directions: int = 180) -> DataFrame:
    """(keys, direction, entropy): the direction of least entropy of each group; the smallest of equals."""
    found = direction_entropies(df, keys, x, y, directions)
    best = F.min(F.struct("entropy", "direction")).alias("best")
    return found.groupBy(*keys).agg(best).select(*keys, "best.direction", "best.entropy")


def shade_free(df: DataFrame, keys: Sequence[str], x: str, y: str, directions: int = 180) -> DataFrame:
    """``df`` with ``shadow`` (along the direction of least entropy) and ``reflectance`` (a quarter turn before it)."""
    found = least_entropy(df, keys, x, y, directions).select(*(F.col(k).alias(f"of_{at}") for at, k in enumerate(keys)), F.radians("direction").alias("of_angle"))
    same = F.lit(True)
    for at, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"of_{at}"))
    met = df.join(found, same, "left") if keys else df.crossJoin(F.broadcast(found))  # one row
    a, b = F.col("of_angle"), F.col("of_angle") - math.pi / 2
    turned = [(F.cos(t) * F.col(f"`{x}`") + F.sin(t) * F.col(f"`{y}`")) for t in (a, b)]
    return met.select(*(F.col(f"`{c}`") for c in df.columns), turned[0].alias("shadow"), turned[1].alias("reflectance"))
