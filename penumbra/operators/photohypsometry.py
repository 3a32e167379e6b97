"""From shadow connections to elevation change and mass balance.

``connections`` have caster_id, timestamp, x, y (where the shadow falls), zenith
(of the sun, degrees) and, if wanted, glacier_id. Every operator is a step for
``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions import atmosphere
from penumbra.operators.pairing import ordered_pairs
from penumbra.operators.rasters import sample_nearest


def with_caster(connections: DataFrame, caster: str = "caster_id") -> DataFrame:
    """Rows whose caster is known (0 and null are not)."""
    return connections.filter(F.col(caster) != 0)


def refined(connections: DataFrame, raw: str = "casted_X", fine: str = "casted_X_refine") -> DataFrame:
    """Rows whose place was moved by refinement; rows without a refined place stay."""
    return connections.filter(~F.col(fine).eqNullSafe(F.col(raw)) | F.col(fine).isNull())


def elevation_difference(x_1, y_1, zenith_1, x_2, y_2, zenith_2, x_t, y_t) -> Column:
    """Elevation of the second shadow's end over the first's, from their distances to the caster and the sun's zenith."""
    d_1, d_2 = F.hypot(x_1 - x_t, y_1 - y_t), F.hypot(x_2 - x_t, y_2 - y_t)
    return d_1 / F.tan(F.radians(zenith_1)) - d_2 / F.tan(F.radians(zenith_2))


def casted_differences(connections: DataFrame, order: Sequence[str] = ("timestamp",), carried: Sequence[str] = ("x", "y", "timestamp", "glacier_id")) -> DataFrame:
    """All pairs of a caster's shadows in time order with ``dh``; the caster stands at columns caster_x and caster_y."""
    columns = list(dict.fromkeys([*carried, "x", "y", "zenith", "caster_x", "caster_y"]))
    pairs = ordered_pairs(connections, "caster_id", order, columns)
    dh = elevation_difference(*(F.col(c) for c in ("x_1", "y_1", "zenith_1", "x_2", "y_2", "zenith_2", "caster_x_1", "caster_y_1")))
    return pairs.withColumn("dh", dh)


def with_mean_caster(connections: DataFrame) -> DataFrame:
    """Caster places as the mean of their shadows' places, where none are known."""
    means = connections.groupBy("caster_id").agg(F.avg("x").alias("caster_x"), F.avg("y").alias("caster_y"))
    return connections.join(means, "caster_id")


def same_glacier(pairs: DataFrame, column: str = "glacier_id") -> DataFrame:
    """Pairs within one glacier."""
    return pairs.filter(F.col(f"{column}_1") == F.col(f"{column}_2"))


def hypsometric_change(pairs: DataFrame, z_1: Column, z_2: Column) -> DataFrame:
    """Mean elevation ``z_12`` and change ``dz_12`` of each pair."""
    return pairs.withColumns({"z_12": (z_1 + z_2) / 2, "dz_12": F.col("dh") - (z_1 - z_2)})


def hydrological_steps(first_year: int, last_year: int) -> list[tuple[int, str, str]]:
    """(year, begin, end) of years that end with September."""
    return [(y, f"{y - 1}-10-01", f"{y}-09-30") for y in range(first_year, last_year + 1)]


def temporal_incidence(observations: DataFrame, steps: DataFrame, open_network: bool = True) -> DataFrame:
    """(obs_id, step, share) of the days of each step that an observation covers; closed keeps whole steps only.

    ``observations`` have obs_id, t_1, t_2; ``steps`` have step, s_1, s_2, and
    are few (a row a year).
    """
    overlap = F.datediff(F.least("t_2", "s_2"), F.greatest("t_1", "s_1"))
    joined = observations.join(F.broadcast(steps), (F.col("t_1") < F.col("s_2")) & (F.col("t_2") > F.col("s_1")))
    share = joined.select("obs_id", "step", F.try_divide(overlap, F.datediff("s_2", "s_1")).alias("share"))
    return share if open_network else share.filter("share >= 1")


def temporal_weights(observations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weights from 0.1 to 1 that grow with the days an observation spans."""
    days = F.datediff("t_2", "t_1")
    spanned = observations.withColumn("_days", days)
    ranges = spanned.groupBy(*keys).agg(F.min("_days").alias("_low"), F.max("_days").alias("_high"))
    joined = spanned.join(ranges, list(keys)) if keys else spanned.crossJoin(F.broadcast(ranges))
    scaled = F.coalesce(F.try_divide(F.col("_days") - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(1.0))
    return joined.withColumn("weight", F.greatest(scaled, F.lit(0.1))).drop("_days", "_low", "_high")


def temporal_covariance(observations: DataFrame, keys: Sequence[str] = (), coefficient: float = 0.5) -> DataFrame:
    """(obs_1, obs_2, covariance) of observations of one key that share an epoch.

    Each observation carries its earlier epochs, and a pair is taken from the
    first epoch that both have, so pairs need no shuffle to be made distinct.
    """
    named = {f"k{at}": F.col(f"`{k}`") for at, k in enumerate(keys)}
    rows = observations.select(F.col("obs_id"), *(c.alias(k) for k, c in named.items()), F.explode(F.array("t_1", "t_2")).alias("t")).dropna()
    epochs = rows.groupBy("obs_id").agg(F.sort_array(F.collect_set(F.struct("t", *named))).alias("epochs"))  # two a row of an observation
    ends = epochs.select("obs_id", "epochs", F.posexplode("epochs").alias("at", "epoch"))
    ends = ends.select("obs_id", "epoch.*", F.slice("epochs", F.lit(1), F.col("at")).alias("earlier"))
    a, b = ends.alias("a"), ends.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.obs_id") < F.col("b.obs_id")) & ~F.arrays_overlap("a.earlier", "b.earlier")
    for k in named:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, same).select(F.col("a.obs_id").alias("obs_1"), F.col("b.obs_id").alias("obs_2"), F.lit(coefficient).alias("covariance"))


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    """Least squares from the normal sums of one bin; a singular system gives zeros."""
    years = sorted(set(group["year_a"]))
    place = {y: k for k, y in enumerate(years)}
    normal, right = np.zeros((len(years), len(years))), np.zeros(len(years))
    for a, b, n, r in zip(group["year_a"], group["year_b"], group["normal"], group["rhs"], strict=True):
        normal[place[a], place[b]] = n
        if a == b:
            right[place[a]] = r
    try:
        rates = np.linalg.solve(normal, right) if np.linalg.matrix_rank(normal) == len(years) else np.zeros(len(years))
    except np.linalg.LinAlgError:
        rates = np.zeros(len(years))
    return pd.DataFrame({"elevation": group["elevation"].iloc[0], "year": years, "rate": rates})


def mass_balance(changes: DataFrame, first_year: int, last_year: int, spacing: float = 100.0) -> DataFrame:
    """Yearly rates of change for each elevation bin: (elevation, year, rate).

    ``changes`` have t_1, t_2, z_12 and dz_12. Spark sums the weighted normal
    equations, years by years for each bin, so only those few sums of a bin, not
    its observations, reach the task that solves it.
    """
    spark = changes.sparkSession
    steps = spark.createDataFrame(hydrological_steps(first_year, last_year), "step int, s_1 string, s_2 string")
    steps = steps.select("step", F.to_date("s_1").alias("s_1"), F.to_date("s_2").alias("s_2"))
    rows = changes.withColumn("elevation", F.floor(F.col("z_12") / spacing) * spacing).withColumn("obs_id", F.monotonically_increasing_id())
    rows = temporal_weights(rows, ["elevation"])
    overlap = F.datediff(F.least("t_2", "s_2"), F.greatest("t_1", "s_1")) / F.datediff("s_2", "s_1")
    part = F.when((F.col("t_1") < F.col("s_2")) & (F.col("t_2") > F.col("s_1")), overlap).otherwise(0.0)
    covered = rows.crossJoin(F.broadcast(steps)).withColumn("a", part).filter("a > 0")  # a row a year
    vectors = covered.groupBy("obs_id", "elevation", "weight", "dz_12").agg(F.collect_list(F.struct("step", "a")).alias("v"))
    terms = vectors.select("elevation", "weight", "dz_12", F.explode("v").alias("p"), "v").select("elevation", "weight", "dz_12", "p", F.explode("v").alias("q"))
    sums = terms.groupBy("elevation", F.col("p.step").alias("year_a"), F.col("q.step").alias("year_b")).agg(
        F.sum(F.col("weight") * F.col("p.a") * F.col("q.a")).alias("normal"), F.sum(F.col("weight") * F.col("p.a") * F.col("dz_12")).alias("rhs")
    )
    return sums.groupBy("elevation").applyInPandas(_solve, "elevation double, year int, rate double")


def relative_network(pairs: DataFrame) -> DataFrame:
    """Coordinate rows (pair_id, x, y, value) of the network matrix: -1 at the first end, 1 at the second."""
    ends = F.array(F.struct(F.col("x_1").alias("x"), F.col("y_1").alias("y"), F.lit(-1).alias("value")), F.struct(F.col("x_2").alias("x"), F.col("y_2").alias("y"), F.lit(1).alias("value")))
    return pairs.select("pair_id", F.explode(ends).alias("e")).select("pair_id", "e.x", "e.y", "e.value")


def with_view_angles(connections: DataFrame, zenith: DataFrame, azimuth: DataFrame, transform: Sequence[float]) -> DataFrame:
    """Whole degrees ``caster_zn`` and ``caster_az`` of the nearest pixels at caster_X and caster_Y; 0 outside the rasters."""
    rows = connections.drop("caster_zn", "caster_az")
    for name, angles in (("caster_zn", zenith), ("caster_az", azimuth)):
        rows = sample_nearest(rows, angles, transform, "caster_X", "caster_Y", name).withColumn(name, F.col(name).cast("int"))
    return rows


def _at_height(levels: Column, z: Column, field: str) -> Column:
    """A field of sorted levels at a height, on the line between the levels around it; the ends are held."""
    below, above = F.filter(levels, lambda l: l["z"] <= z), F.filter(levels, lambda l: l["z"] > z)
    low, high = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    share = F.coalesce(F.try_divide(z - low["z"], high["z"] - low["z"]), F.lit(0.0))
    return F.coalesce(low[field] + share * F.coalesce(high[field] - low[field], F.lit(0.0)), high[field])


def with_refracted_zenith(connections: DataFrame, profiles: DataFrame, wavelength: float, humid: bool = False, co2: float = 450.0) -> DataFrame:
    """Sun angles ``zenith_refrac`` below the atmosphere, by the air at each caster's height.

    ``profiles`` have timestamp, z, temperature (Kelvin), pressure (Pascal) and,
    for ``humid``, humidity; the few levels of one time are one row. Temperatures
    reach the refractive index in degrees Celsius, as it is defined. Connections
    of a time without a profile, or without a height, get null.
    """
    fields = ["temperature", "pressure"] + ["humidity"] * humid
    level = F.struct("z", *fields)
    times = profiles.dropna(subset=["timestamp", "z"]).groupBy("timestamp").agg(F.sort_array(F.collect_list(level)).alias("levels"))
    met = connections.drop("zenith_refrac").join(times, "timestamp", "left")
    celsius, pressure, *humidity = (_at_height(F.col("levels"), F.col("caster_Z"), f) for f in fields)
    celsius = celsius - 273.15
    if humid:
        index = atmosphere.refractive_index_broadband(F.lit(wavelength), celsius, pressure, humidity[0], co2)
    else:
        index = atmosphere.refractive_index_visible(F.lit(wavelength), celsius, pressure)
    angle = F.when(F.col("caster_Z").isNotNull(), atmosphere.refraction_angle(F.col("zenith"), index))
    return met.withColumn("zenith_refrac", angle).drop("levels")
