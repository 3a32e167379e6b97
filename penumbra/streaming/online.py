"""Online statistics of streams: state is a few numbers for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, ts timestamp, value double, ratio double, t double, f double"


def _moments(n: int, mean: float, square: float, y: float) -> tuple[int, float, float]:
    """Welford's step: number, mean and sum of squared distances with one more value."""
    n += 1
    step = y - mean
    mean += step / n
    return n, mean, square + step * (y - mean)


def _steady(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Steady-state ratio and the prefix tests of each new value of a key, in order of time."""
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    held = state.get if state.exists else None
    x, v, d, last, n, mean, square = held if held else (0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0)
    out = []
    for ts, y in zip(rows["ts"], rows["value"], strict=True):
        before_n, before_mean, before_square = n, mean, square
        if n == 0:
            x, last = y, y
        else:
            v, d, x, last = 0.1 * (y - x) ** 2 + 0.9 * v, 0.1 * (y - last) ** 2 + 0.9 * d, 0.2 * y + 0.8 * x, y
        n, mean, square = _moments(n, mean, square, y)
        ratio = v * 1.8 / d if d else None
        t = (mean - before_mean) / ((square / n / n) ** 0.5) if before_n and square else None
        f = (before_square / before_n) / (square / n) if before_n and square else None
        out.append((key[0], ts, y, ratio, t, f))
    state.update((x, v, d, last, n, mean, square))
    yield pd.DataFrame(out, columns=["key", "ts", "value", "ratio", "t", "f"])


def steady_state(stream: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """A stream of (key, ts, value) with the steady-state ratio, and the t and F statistics against the values before."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value"))
    state = "x double, v double, d double, last double, n long, mean double, square double"
    return rows.groupBy("key").applyInPandasWithState(_steady, OUTPUT, state, "append", GroupStateTimeout.NoTimeout)


def windowed_zonal(stream: DataFrame, label: str, ts: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean, least and greatest value of each label and window; values later than ``late`` are dropped."""
    rows = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return rows.groupBy(F.window("_ts", window).alias("window"), label).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
