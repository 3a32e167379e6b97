"""Circular orbits fitted to directions of sight, many at once.

A row is the unit vector from a place on the ground to the satellite. Every
orbit has four unknowns, the latitude and longitude that it passes at time 0,
its radius and its inclination; every row has one of its own, its time. A row's
time is eliminated from its normal equations, so a group sums a system of four;
the step of the orbit then gives the step of each row's time. Rounds write one
table of rows and one of orbits.

Along the track, time and place can be exchanged for each other: of all equally
good solutions the step of least length is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions.orbits import node, sight_residual, slope
from penumbra.store import settle

#: Unknowns of an orbit with the step that slopes are taken over: radians, but for the radius in metres.
UNKNOWNS = {"lat": 1e-5, "lon": 1e-5, "radius": 10.0, "inclination": 1e-5}
_SIGHT, _GROUND = ("sight_x", "sight_y", "sight_z"), ("ground_x", "ground_y", "ground_z")
#: Seconds that slopes by time are taken over, and lengths that make unknowns alike (metres).
_TICK, _LENGTH = 0.01, 6_378_137.0


def _residual(values: dict[str, Column]) -> tuple[Column, ...]:
    argument, longitude = node(values["lat"], values["lon"], values["inclination"])
    sight, ground = (tuple(F.col(c) for c in names) for names in (_SIGHT, _GROUND))
    return sight_residual(values["time"], sight, ground, values["radius"], values["inclination"], F.col("period"), argument, longitude)


def _terms(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their residual v, the slopes p by unknown and q by time, three numbers each."""
    names = [*UNKNOWNS, "time"]
    now = {n: F.col(n) for n in names}
    made = {"v": F.array(*_residual(now))}
    for n in names:
        step = UNKNOWNS.get(n, _TICK)
        made[f"d_{n}"] = F.array(*slope(lambda at, n=n: _residual({**now, n: at}), now[n], step))
    return rows.select(*keys, "row_id", *_SIGHT, *_GROUND, "time", *(c.alias(n) for n, c in made.items()))


def _dot(a: str, b: str) -> Column:
    return sum((F.get(a, F.lit(k)) * F.get(b, F.lit(k)) for k in range(1, 3)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The step of each orbit, from its reduced normal equations; lengths are put on one scale first."""
    scale = np.array([_LENGTH, _LENGTH, 1.0, _LENGTH])
    for batch in batches:
        steps = []
        for normal, right in zip(batch["normal"], batch["right"], strict=True):
            a = np.asarray(normal, float).reshape(4, 4) / np.outer(scale, scale)
            steps.append(np.linalg.lstsq(a, -np.asarray(right, float) / scale, rcond=1e-10)[0] / scale)
        out = batch.drop(columns=["normal", "right"])
        yield out.assign(**{f"step_{n}": [float(s[k]) for s in steps] for k, n in enumerate(UNKNOWNS)})


def fit_orbits(rows: DataFrame, keys: Sequence[str], start: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(orbits, times) of rows (keys, row_id, sight_x..z, ground_x..z) from ``start`` (keys, lat, lon, radius, inclination, period).

    Orbits have their unknowns, the rows n and ``rms`` of the residual's length
    before the last step; times are (keys, row_id, time). Angles are in radians,
    and ``row_id`` is one of a row within its group. Orbits without rows, and
    rows without an orbit or that it cannot see, are left out.
    """
    keys = list(keys)
    types = dict(start.dtypes)
    orbits = settle(start.select(*keys, *UNKNOWNS, "period"), "orbits")
    # a row has few bytes and much work, so files of rows are too large for a task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = settle(rows.select(*keys, "row_id", *_SIGHT, *_GROUND, F.lit(0.0).alias("time")).repartition(parts, "row_id"), "sights")
    for _ in range(rounds):
        terms = _terms(seen.join(orbits, keys), keys).filter("v[0] IS NOT NULL AND d_time[0] IS NOT NULL")
        weight = 1 / _dot("d_time", "d_time")
        reduced = [(_dot(f"d_{a}", f"d_{b}") - weight * _dot(f"d_{a}", "d_time") * _dot(f"d_{b}", "d_time")) for a in UNKNOWNS for b in UNKNOWNS]
        right = [(_dot(f"d_{a}", "v") - weight * _dot(f"d_{a}", "d_time") * _dot("d_time", "v")) for a in UNKNOWNS]
        terms = settle(terms, "terms")
        sums = terms.groupBy(*keys).agg(F.count("*").alias("n"), F.sqrt(F.avg(_dot("v", "v"))).alias("rms"), F.array(*(F.sum(c) for c in reduced)).alias("normal"), F.array(*(F.sum(c) for c in right)).alias("right"))
        ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long, rms double", *(f"step_{n} double" for n in UNKNOWNS)])
        steps = settle(sums.mapInPandas(_solve, ddl), "steps")
        moved = terms.join(steps, keys)
        by_orbit = sum((_dot(f"d_{n}", "d_time") * F.col(f"step_{n}") for n in list(UNKNOWNS)[1:]), _dot("d_lat", "d_time") * F.col("step_lat"))
        seen = settle(moved.select(*keys, "row_id", *_SIGHT, *_GROUND, (F.col("time") - weight * (_dot("d_time", "v") + by_orbit)).alias("time")), "sights")
        orbits = settle(orbits.select(*keys, *UNKNOWNS, "period").join(steps, keys).select(*keys, *((F.col(n) + F.col(f"step_{n}")).alias(n) for n in UNKNOWNS), "period", "n", "rms"), "orbits")
    return orbits, seen.select(*keys, "row_id", "time")
