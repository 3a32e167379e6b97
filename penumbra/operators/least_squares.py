"""Non-linear least squares for many groups at once.

Each round sums the normal equations of every group over its rows, which Spark
adds up in part before it shuffles them, and solves them row by row: a group's
equations have a size that its rows don't change. Steps are damped after
Levenberg and Marquardt: a step that fits worse is taken back and damped more.
Groups that have come to rest leave the rounds, and every round's state is a
written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.store import settle

#: From the parameters' columns to the residual of a row (observed less modelled) and the model's slope by each parameter.
Model = Callable[[Sequence[Column]], tuple[Column, Sequence[Column]]]
_STATE = "best array<double>, trial array<double>, cost double, damping double, normal array<double>, slope array<double>, rounds int, rested boolean, n long"


def _stepped(batches: Iterator[pd.DataFrame], keys: list[str], k: int, tolerance: float) -> Iterator[pd.DataFrame]:
    """Judge each group's trial and choose the next one."""
    for batch in batches:
        rows = []
        for r in batch.to_dict("records"):
            cost = r["new_cost"]
            normal, slope, damping, best = r["normal"], r["slope"], r["damping"], np.asarray(r["best"], float)
            trial, rested = np.asarray(r["trial"], float), False
            better = cost is not None and np.isfinite(cost) and (r["cost"] is None or np.isnan(r["cost"]) or cost <= r["cost"])
            if better:
                gain = np.inf if r["cost"] is None or np.isnan(r["cost"]) else r["cost"] - cost
                rested = gain <= tolerance * max(cost, 1e-300) and bool(np.abs(trial - best).max() <= np.sqrt(tolerance) * (np.abs(trial).max() + 1e-12))
                best, normal, slope, damping = trial, r["new_normal"], r["new_slope"], max(damping / 10, 1e-12)
            else:
                cost, damping = r["cost"], damping * 10
                rested = damping > 1e12
            if normal is None or cost is None:
                rested = True
            else:
                square = np.asarray(normal, float).reshape(k, k)
                step = np.linalg.lstsq(square + damping * np.diag(np.maximum(np.diag(square), 1e-300)), np.asarray(slope, float), rcond=None)[0]
                trial = best + step
                rested = rested or not np.isfinite(trial).all()
            rows.append({**{c: r[c] for c in keys}, "best": best.tolist(), "trial": trial.tolist(), "cost": cost, "damping": damping, "normal": normal, "slope": slope, "rounds": r["rounds"] + 1, "rested": bool(rested), "n": r["n_rows"]})
        yield pd.DataFrame(rows, columns=[*keys, "best", "trial", "cost", "damping", "normal", "slope", "rounds", "rested", "n"])


def fit(rows: DataFrame, keys: Sequence[str], model: Model, start: DataFrame, most_rounds: int = 30, tolerance: float = 1e-12) -> DataFrame:
    """(keys, parameters: array, cost, n, rounds, rested) of each group of ``start`` (keys, parameters: array).

    ``cost`` is the sum of squared residuals, ``n`` the rows that have one;
    ``rested`` says whether the group came to rest within ``most_rounds``.
    Groups of null key or without rows keep their start. Keys are to be distinct
    in ``start``.
    """
    keys = list(keys)
    first = start.select(F.size("parameters")).first()
    k = first[0] if first else 0
    types = {c: t for c, t in start.dtypes if c in keys}
    ddl = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", " + _STATE
    state = start.select(*keys, F.col("parameters").cast("array<double>").alias("best"))
    state = settle(state.select(*keys, "best", F.col("best").alias("trial"), F.lit(None).cast("double").alias("cost"), F.lit(1e-3).alias("damping"), F.lit(None).cast("array<double>").alias("normal"), F.lit(None).cast("array<double>").alias("slope"), F.lit(0).alias("rounds"), F.lit(False).alias("rested"), F.lit(0).cast("long").alias("n")), "fits")
    done = []
    for _ in range(most_rounds):
        parameters = [F.get("trial", F.lit(a)) for a in range(k)]
        residual, slopes = model(parameters)
        met = rows.join(state.select(*keys, "trial"), keys)
        made = met.select(*keys, residual.alias("res_"), *(s.alias(f"slope_{a}") for a, s in enumerate(slopes))).filter("res_ IS NOT NULL")
        sums = made.groupBy(*keys).agg(
            F.count("*").alias("n_rows"), F.sum(F.col("res_") * F.col("res_")).alias("new_cost"),
            F.array(*(F.sum(F.col(f"slope_{a}") * F.col(f"slope_{b}")) for a in range(k) for b in range(k))).alias("new_normal"),
            F.array(*(F.sum(F.col(f"slope_{a}") * F.col("res_")) for a in range(k))).alias("new_slope"),
        )
        judged = state.join(sums, keys, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return _stepped(batches, keys, k, tolerance)

        after = settle(judged.mapInPandas(make, ddl), "fits")
        done.append(after.filter("rested"))
        state = after.filter("NOT rested")
        if state.isEmpty():
            break
    else:
        done.append(state)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*keys, F.col("best").alias("parameters"), "cost", "n", "rounds", "rested")


def power_law(x: str, y: str) -> Model:
    """y = a x^b."""

    def model(p: Sequence[Column]) -> tuple[Column, Sequence[Column]]:
        raised = F.pow(F.col(x), p[1])
        return F.col(y) - p[0] * raised, [raised, p[0] * raised * F.log(F.col(x))]

    return model


def bell(i: str, j: str, score: str) -> Model:
    """score = a exp(-((i - i0)^2 + (j - j0)^2) / (2 w^2)), with parameters a, i0, j0, w."""

    def model(p: Sequence[Column]) -> tuple[Column, Sequence[Column]]:
        di, dj = F.col(i) - p[1], F.col(j) - p[2]
        far = di * di + dj * dj
        shape = F.exp(-far / (2 * p[3] * p[3]))
        return F.col(score) - p[0] * shape, [shape, p[0] * shape * di / (p[3] * p[3]), p[0] * shape * dj / (p[3] * p[3]), p[0] * shape * far / (p[3] * p[3] * p[3])]

    return model


def sine(t: str, y: str) -> Model:
    """y = m + a sin(w t + f), with parameters m, a, w, f."""

    def model(p: Sequence[Column]) -> tuple[Column, Sequence[Column]]:
        phase = p[2] * F.col(t) + p[3]
        return F.col(y) - p[0] - p[1] * F.sin(phase), [F.lit(1.0), F.sin(phase), p[1] * F.cos(phase) * F.col(t), p[1] * F.cos(phase)]

    return model
