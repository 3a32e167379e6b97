"""Counts below each value of a group, without a task that sees a whole group.

Equal values are counted first. The counts are then dealt out by ranges of
group and value; each range is summed in order by itself, and the totals of the
ranges before it (one row a range) are added. Ranks, medians, quantiles and
whatever else needs the order of a group follow by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penumbra.store import settle


def below(df: DataFrame, keys: Sequence[str], value: str, count: Column | None = None) -> DataFrame:
    """(keys, value, m, before, n): each value of a group with its rows, the rows below it and those of the group.

    ``count`` counts a row (one each unless given). Null and NaN values are left
    out; null keys are a group.
    """
    named = {f"k{at}": F.col(f"`{k}`") for at, k in enumerate(keys)}
    groups = list(named)
    rows = df.select(*(c.alias(k) for k, c in named.items()), F.col(f"`{value}`").cast("double").alias("value"), (F.lit(1) if count is None else count).cast("long").alias("one"))
    counts = rows.filter("value IS NOT NULL AND NOT isnan(value)").groupBy(*groups, "value").agg(F.sum("one").alias("m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(counts.repartitionByRange(parts, *groups, "value").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = ranged.groupBy("part").agg(F.sum("m").alias("held")).select(F.col("part").alias("of"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*groups, "value").rowsBetween(Window.unboundedPreceding, -1)
    upto = ranged.withColumn("inside", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(starts, F.col("part") == F.col("of"))
    upto = upto.withColumn("before", F.col("start") + F.col("inside"))
    sums = upto.groupBy(*(F.col(k).alias(f"of_{k}") for k in groups)).agg(F.min("before").alias("first"), F.sum("m").alias("n"))
    same = F.lit(True)
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    joined = upto.join(sums, same) if groups else upto.crossJoin(F.broadcast(sums))  # one row
    return joined.select(*(F.col(k).alias(name) for k, name in zip(groups, keys, strict=True)), F.col("value").alias(value), "m", (F.col("before") - F.col("first")).alias("before"), "n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(keys, n, quantiles): the exact quantiles of each group, between values by straight lines."""
    counted = below(df, keys, value)
    v = F.col(f"`{value}`")
    place = {at: (F.col("n") - 1) * float(q) for at, q in enumerate(shares)}
    taken = []
    for at, p in place.items():
        for name, whole in (("low", F.floor(p)), ("high", F.ceil(p))):
            taken.append(F.max(F.when((F.col("before") <= whole) & (whole < F.col("before") + F.col("m")), v)).alias(f"{name}_{at}"))
    found = counted.groupBy(*keys).agg(F.first("n").alias("n"), *taken)
    between = [F.col(f"low_{at}") + (F.col(f"high_{at}") - F.col(f"low_{at}")) * (p - F.floor(p)) for at, p in place.items()]
    return found.select(*keys, "n", F.array(*between).alias("quantiles"))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """(keys, n, name): the exact median of each group, however many rows it has."""
    return quantiles(df, keys, value, [0.5]).select(*keys, "n", F.get("quantiles", F.lit(0)).alias(name))


def ranked(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the mean rank (from 1) of each row's value in its group; null where the value is null or NaN."""
    counted = below(df, keys, value)
    table = counted.select(*(F.col(k).alias(f"of_{at}") for at, k in enumerate(keys)), F.col(f"`{value}`").alias("of_value"), (F.col("before") + (F.col("m") + 1) / 2).alias("of_rank"))
    same = F.col(f"`{value}`").cast("double") == F.col("of_value")
    for at, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"of_{at}"))
    return df.join(table, same, "left").select(*(F.col(f"`{c}`") for c in df.columns), F.col("of_rank").alias(name))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): Spearman's correlation of two columns of each group, over rows that have both; null if one doesn't vary."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    placed = ranked(ranked(rows, keys, "x", "rank_x"), keys, "y", "rank_y").filter("rank_x IS NOT NULL AND rank_y IS NOT NULL")
    varies = (F.min("rank_x") < F.max("rank_x")) & (F.min("rank_y") < F.max("rank_y"))  # merged deviations of equal ranks may be a trace above 0
    rho = F.try_divide(F.covar_pop("rank_x", "rank_y"), F.stddev_pop("rank_x") * F.stddev_pop("rank_y"))
    return placed.groupBy(*keys).agg(F.count("*").alias("n"), F.when(varies, rho).alias("rho"))


def moore(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, n, moore): Moore's statistic of displacements (x, y): the resultant of directions weighed by the rank of their length, over n^1.5."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    placed = ranked(rows.withColumn("length", F.hypot("x", "y")), keys, "length", "rank").filter("rank IS NOT NULL")
    angle = F.atan2("y", "x")
    sums = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("rank") * F.cos(angle)).alias("c"), F.sum(F.col("rank") * F.sin(angle)).alias("s"))
    return sums.select(*keys, "n", (F.hypot("c", "s") / F.pow("n", F.lit(1.5))).alias("moore"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0, by Stirling's series at x + 8."""
    far = x + 8
    series = 1 / (12 * far) - 1 / (360 * F.pow(far, F.lit(3))) + 1 / (1260 * F.pow(far, F.lit(5))) - 1 / (1680 * F.pow(far, F.lit(7)))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (far - 0.5) * F.log(far) - far + 0.9189385332046727 + series - F.log(product)  # half the logarithm of 2 pi


def half_circles(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """(keys, n, fewest, p): Hodges' and Ajne's test of angles in degrees.

    ``fewest`` is the least number of angles in any half of the circle that
    begins at an angle, or beyond such a half. ``p`` is the chance of so few
    under no direction: Ajne's approximation under 50 angles, Hodges' formula
    from 50 on, at most 1. Counts come from ordered ranges, so no task sees a
    whole group.
    """
    named = {f"k{at}": F.col(f"`{k}`") for at, k in enumerate(keys)}
    groups = list(named)
    turned = F.pmod(F.col(f"`{angle}`").cast("double"), F.lit(360.0))
    points = df.select(*(c.alias(k) for k, c in named.items()), turned.alias("a")).filter("a IS NOT NULL AND NOT isnan(a)").groupBy(*groups, "a").agg(F.count("*").alias("one"))
    # every angle asks for the count below it and below the angle across the circle
    across = points.select(*groups, F.pmod(F.col("a") + 180, F.lit(360.0)).alias("a"), F.lit(0).cast("long").alias("one"), F.col("a").alias("asked"))
    counted = below(points.select(*groups, "a", "one").unionByName(across.select(*groups, "a", "one")), groups, "a", F.col("one"))
    same = F.lit(True)
    for k in groups:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    table = counted.select(*(F.col(k).alias(f"of_{k}") for k in groups), F.col("a").alias("of_a"), "before", "n")
    ahead = across.join(table, same & (F.col("a") == F.col("of_a"))).select(*groups, F.col("asked").alias("a"), F.col("a").alias("b"), F.col("before").alias("upto_b"), "n")
    here = table.select(*(F.col(f"of_{k}") for k in groups), "of_a", F.col("before").alias("upto_a"))
    met = ahead.join(here, same & (F.col("a") == F.col("of_a")))
    held = F.when(F.col("b") > F.col("a"), F.col("upto_b") - F.col("upto_a")).otherwise(F.col("n") - F.col("upto_a") + F.col("upto_b"))
    found = met.groupBy(*groups).agg(F.first("n").alias("n"), F.min(F.least(held, F.col("n") - held)).alias("fewest"))
    n, m = F.col("n").cast("double"), F.col("fewest").cast("double")
    wide = F.try_divide(F.sqrt(n) * 3.141592653589793 / 2, n - 2 * m)
    ajne = 2.5066282746310002 / wide * F.exp(-1.2337005501361697 / (wide * wide))  # the root of 2 pi, and an eighth of pi squared
    hodges = F.exp((1 - n) * 0.6931471805599453 + F.log(n - 2 * m) + log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1))
    p = F.when(n == 2 * m, F.lit(1.0)).otherwise(F.least(F.when(n < 50, ajne).otherwise(hodges), F.lit(1.0)))
    return found.select(*(F.col(k).alias(name) for k, name in zip(groups, keys, strict=True)), "n", "fewest", p.alias("p"))
