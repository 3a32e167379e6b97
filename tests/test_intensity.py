"""Histogram matching and adjustments against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_histograms_match_by_raster(spark):
    from penumbra.operators.intensity import match_histogram

    rng = np.random.default_rng(2)
    rows = [(k % 2, int(a), float(b), "clash") for k, (a, b) in enumerate(zip(rng.integers(0, 30, 400), rng.normal(5, 2, 400).round(1), strict=True))]
    rows += [(2, 7, 1.0, "few"), (0, None, 3.0, "null")]
    df = spark.createDataFrame(rows, "raster int, a int, b double, known string")
    got = match_histogram(df, df, ["raster"], "a", "b", "m").collect()
    assert len(got) == len(rows)
    for raster in (0, 1):
        img = np.array([r[1] for r in rows if r[0] == raster and r[1] is not None], float)
        ref = np.array([r[2] for r in rows if r[0] == raster])
        v, n = np.unique(img, return_counts=True)
        w, m = np.unique(ref, return_counts=True)
        want = dict(zip(v, np.interp(np.cumsum(n) / n.sum(), np.cumsum(m) / m.sum(), w), strict=True))
        for r in got:
            if r["raster"] == raster and r["a"] is not None:
                assert r["m"] == pytest.approx(want[r["a"]]) and r["known"] == "clash"
    assert [r["m"] for r in got if r["raster"] == 2] == [7.0] and [r["m"] for r in got if r["known"] == "null"] == [None]


def test_adjustments_use_the_rasters_extremes(spark):
    from penumbra.operators.intensity import hyperbolic, log_adjusted

    z = np.array([0.0, 3, 10, 200])
    df = spark.createDataFrame([(float(x),) for x in z], "z double")
    got = [r["l"] for r in log_adjusted(df, [], "z", "l").orderBy("z").collect()]
    assert got == [int(x) for x in 65535 / np.log(1 + z.max()) * np.log(1 + z)]
    got = [r["h"] for r in hyperbolic(df, [], "z", "h", 5.0).orderBy("z").collect()]
    assert got == pytest.approx(list(np.minimum(np.arcsinh((z - 5) * (10 / 5)) / 3, 1)))
    assert log_adjusted(df.filter(F.lit(False)), [], "z", "l").count() == 0
