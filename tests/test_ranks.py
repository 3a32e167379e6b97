"""Order statistics by ranges, circle tests, least squares by group, chunked series and polygon joins, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.operators import least_squares, polygons, ranks, statistics


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    rows = [(None if g == 3 else f"g{g}", float(v)) for g, n in enumerate((1, 2, 700, 50)) for v in rng.integers(0, 40, n)]
    rows += [("g1", None), ("g1", float("nan")), ("g0", -5.5)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(5)


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None and v == v:
            out.setdefault(g, []).append(v)
    return {g: np.array(v) for g, v in out.items()}


def test_counts_below(values):
    rows, df = values
    groups = by_group(rows)
    found = ranks.below(df, ["g"], "v").collect()
    assert {(r["g"], r["v"]): (r["m"], r["before"], r["n"]) for r in found} == {(g, v): (int((x == v).sum()), int((x < v).sum()), len(x)) for g, x in groups.items() for v in set(x.tolist())}
    whole = np.concatenate(list(groups.values()))
    assert {r["v"]: r["before"] for r in ranks.below(df, [], "v").collect()} == {v: int((whole < v).sum()) for v in set(whole.tolist())}
    assert ranks.below(df.limit(0), ["g"], "v").count() == 0


def test_quantiles_and_ranks(values):
    rows, df = values
    groups = by_group(rows)
    for r in ranks.quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect():
        assert np.allclose(r["quantiles"], np.quantile(groups[r["g"]], [0.0, 0.25, 0.5, 0.9, 1.0])) and r["n"] == len(groups[r["g"]])
    assert {r["g"]: r["median"] for r in ranks.medians(df, ["g"], "v").collect()} == {g: float(np.median(x)) for g, x in groups.items()}
    out = ranks.ranked(df, ["g"], "v", "rank").collect()
    assert len(out) == len(rows)
    for r in out:
        x = groups[r["g"]]
        assert r["rank"] == (None if r["v"] is None or r["v"] != r["v"] else (x < r["v"]).sum() + ((x == r["v"]).sum() + 1) / 2)


def test_rank_correlation_and_moore(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, 80).astype(float)
    y = x + rng.integers(-6, 7, 80)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("b", 1.0, 2.0), ("b", 1.0, 3.0), ("b", None, 3.0)], "g string, x double, y double")

    def rank(v):
        return np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])

    found = {r["g"]: r for r in ranks.rank_correlation(df, ["g"], "x", "y").collect()}
    assert abs(found["a"]["rho"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12 and found["b"]["n"] == 2 and found["b"]["rho"] is None
    got = {r["g"]: r["moore"] for r in ranks.moore(df, ["g"], "x", "y").collect()}
    angle, t = np.arctan2(y, x), rank(np.hypot(x, y))
    assert abs(got["a"] - np.hypot((t * np.cos(angle)).sum(), (t * np.sin(angle)).sum()) / 80**1.5) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 7, 49, 50, 300])
def test_half_circles(spark, n):
    rng = np.random.default_rng(n)
    angles = rng.integers(0, 90 if n % 2 else 720, n)
    df = spark.createDataFrame([("a", float(a)) for a in angles] + [("b", 10.0), ("b", None)], "g string, angle double").repartition(3)
    r = next(r for r in ranks.half_circles(df, ["g"], "angle").collect() if r["g"] == "a")
    a = angles % 360
    held = [int((((a - t) % 360) < 180).sum()) for t in a]
    m = min(min(h, n - h) for h in held)
    assert (r["n"], r["fewest"]) == (n, m)
    if n == 2 * m:
        want = 1.0
    elif n < 50:
        wide = math.pi * math.sqrt(n) / 2 / (n - 2 * m)
        want = math.sqrt(2 * math.pi) / wide * math.exp(-(math.pi**2) / 8 / wide**2)
    else:
        want = 2.0 ** (1 - n) * (n - 2 * m) * math.comb(n, m)
    assert abs(r["p"] - min(want, 1.0)) <= 1e-9 * max(want, 1e-3)


def test_log_gamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 300.0, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ranks.log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-11)


def test_bells_and_sines_by_group(spark):
    rng = np.random.default_rng(3)
    truth = {g: (2.0 + g, 3.2 + 0.1 * g, 4.1 - 0.2 * g, 1.3 + 0.1 * g) for g in range(5)}
    rows = [(g, float(i), float(j), float(a * np.exp(-((i - i0) ** 2 + (j - j0) ** 2) / (2 * w * w)) + rng.normal(0, 1e-4))) for g, (a, i0, j0, w) in truth.items() for i in range(8) for j in range(8)]
    df = spark.createDataFrame(rows, "g long, i double, j double, score double")
    peak = df.groupBy("g").agg(F.max_by(F.struct("score", "i", "j"), "score").alias("p")).select("g", F.array("p.score", "p.i", "p.j", F.lit(1.0)).alias("parameters"))
    found = least_squares.fit(df, ["g"], least_squares.bell("i", "j", "score"), peak).collect()
    assert len(found) == 5
    for r in found:
        assert r["rested"] and r["n"] == 64 and np.allclose(np.abs(r["parameters"]), truth[r["g"]], atol=1e-3)
    t = np.arange(60) / 7
    waves = spark.createDataFrame([(g, float(x), float(g + 2 * np.sin((1 + 0.1 * g) * x + 0.3))) for g in range(3) for x in t], "g long, t double, y double")
    start = spark.createDataFrame([(g, [0.0, 1.0, 1.05, 0.0]) for g in range(3)] + [(9, [1.0, 1.0, 1.0, 1.0])], "g long, parameters array<double>")
    out = {r["g"]: r for r in least_squares.fit(waves, ["g"], least_squares.sine("t", "y"), start).collect()}
    for g in range(3):
        assert np.allclose(out[g]["parameters"], (g, 2, 1 + 0.1 * g, 0.3), atol=1e-5) and out[g]["cost"] < 1e-9
    assert out[9]["n"] == 0 and out[9]["parameters"] == [1.0] * 4


def test_long_series_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, k, float(v)) for g, n in (("a", 200), ("b", 1), ("c", 37)) for k, v in enumerate(rng.normal(0, 1, n))] + [("d", 0, None), ("e", 0, 2.0), ("e", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(6)
    want = {}
    for g in "abce":
        x = v = d = last = None
        for _, _, y in sorted(r for r in rows if r[0] == g):
            if x is None:
                x, v, d, last = y, 0.0, 0.0, y
                continue
            v, d, x, last = 0.1 * (y - x) ** 2 + 0.9 * v, 0.1 * (y - last) ** 2 + 0.9 * d, 0.2 * y + 0.8 * x, y
        want[g] = v * 1.8 / d if d else None
    for chunk in (1, 7, 4096):
        monkeypatch.setattr(statistics, "CHUNK", chunk)
        got = {r["g"]: (r["n"], r["ratio"]) for r in statistics.steady_states(df, ["g"], ["k"], "v").collect()}
        assert set(got) == set(want) and got["a"][0] == 200
        for g, ratio in want.items():
            assert got[g][1] == ratio if ratio is None else abs(got[g][1] - ratio) < 1e-9


def test_polygons_that_meet(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    first = {1: square(0.0, 0.0, 10.0), 2: square(20.0, 20.0, 2.0), 3: [(0.0, 0.0), (1.0, 1.0)], 4: square(-5.0, -5.0, 100.0)}
    second = {7: square(9.0, 9.0, 3.0), 8: square(2.0, 2.0, 1.0), 9: square(10.5, 0.0, 5.0), 10: [(-1.0, 4.0), (12.0, 5.0), (-1.0, 6.0)]}
    ddl = "id long, ring array<struct<x: double, y: double>>"
    a, b = (spark.createDataFrame(list(p.items()), ddl) for p in (first, second))
    for size in (0.7, 4.0, 500.0):
        got = {(r["id_1"], r["id_2"]): r["relation"] for r in polygons.meeting(a, b, size).collect()}
        assert got == {(1, 7): "crosses", (1, 8): "holds", (1, 10): "crosses", (4, 7): "holds", (4, 8): "holds", (4, 9): "holds", (4, 10): "holds"}, size
        assert polygons.meeting(b, a, size).filter("id_1 = 8 AND id_2 = 1").first()["relation"] == "within"


def test_rings_over_the_antimeridian(spark):
    ring = [(179.0, 10.0), (-179.0, 10.0), (-179.0, 12.0), (179.0, 12.0)]
    df = spark.createDataFrame([(1, ring), (2, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "id long, ring array<struct<x: double, y: double>>")
    parts = df.select("id", F.explode(polygons.unwrapped(F.col("ring"))).alias("ring"))
    assert {r["id"]: r["count"] for r in parts.groupBy("id").count().collect()} == {1: 2, 2: 1}
    places = spark.createDataFrame([(k, [(x, 11.0), (x + 0.1, 11.0), (x, 11.1)]) for k, x in enumerate((179.5, -179.6, 0.2, 178.0))], "id long, ring array<struct<x: double, y: double>>")
    assert {(r["id_1"], r["id_2"]) for r in polygons.meeting(parts, places, 1.0).collect()} == {(1, 0), (1, 1)}


def test_crowded_polygons_meet_slice_by_slice(spark, monkeypatch):
    """Copies of a few rings in one cell, in slices of two rings: each ring is compared once for all its ids."""
    from penumbra.operators import polygons

    monkeypatch.setattr(polygons, "RINGS", 2)
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    kinds = [square(5.0, 5.0, 4.0), square(5.1, 5.2, 1.0), square(8.0, 8.5, 3.0), square(40.0, 5.0, 1.0), [(4.0, 4.5), (5.5, 4.0), (5.0, 6.0)]]
    ddl = "id long, ring array<struct<x: double, y: double>>"
    a, b = (spark.createDataFrame(list(enumerate(kinds)), ddl).select(F.col("id").alias(i), F.col("ring").alias(r)) for i, r in (("i", "p"), ("j", "q")))
    p, q = F.col("p"), F.col("q")
    relation = F.when(polygons.rings_cross(p, q), "crosses").when(polygons.ring_holds(p, q[0]), "holds").when(polygons.ring_holds(q, p[0]), "within")
    want = {(r["i"], r["j"]): r["relation"] for r in a.crossJoin(b).select("i", "j", relation.alias("relation")).collect()}
    assert want[0, 1] == "holds" and want[1, 0] == "within" and want[0, 2] == "crosses" and want[0, 3] is None
    df = spark.createDataFrame([(k, kinds[k % 5]) for k in range(60)], ddl)
    got = {(r["id_1"], r["id_2"]): r["relation"] for r in polygons.meeting(df, df, 16.0).collect()}
    assert got == {(a, b): r for a in range(60) for b in range(60) if (r := want[a % 5, b % 5])}
