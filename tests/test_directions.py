"""Directional tests against plain loops."""

import numpy as np
import pytest


def test_spacing_tests_match_sorted_angles(spark):
    from penumbra.operators.directions import spacing_tests

    rng = np.random.default_rng(4)
    angles = {0: list(rng.uniform(-400, 800, 300)), 1: [10.0] * 50 + [200.0, 359.95, 0.0], 2: [33.0], None: [1.0, 91.0, 181.0, 271.0]}
    rows = [(k, float(a), "clash") for k, values in angles.items() for a in values] + [(0, None, "null"), (0, float("nan"), "nan")]
    got = {r["g"]: r for r in spacing_tests(spark.createDataFrame(rows, "g int, n double, slice string"), ["g"], "n").collect()}
    assert set(got) == set(angles)
    for k, values in angles.items():
        a = np.sort(np.mod(values, 360))
        n = len(a)
        gaps = np.append(np.diff(a), 360 - (a[-1] - a[0]))
        rank = np.arange(1, n + 1)
        assert got[k]["n"] == n
        assert got[k]["rao"] == pytest.approx(np.abs(gaps - 360 / n).sum() / 2 if n > 1 else 180.0)
        assert got[k]["kuiper"] == pytest.approx(np.sqrt(n) * ((rank / n - a / 360).max() + (a / 360 - (rank - 1) / n).max()))
    assert spacing_tests(spark.createDataFrame([], "g int, n double"), ["g"], "n").count() == 0


def test_share_in_ellipse(spark):
    from penumbra.operators.directions import share_in_ellipse

    rng = np.random.default_rng(6)
    xy = rng.normal(0, [1.0, 3.0], (200, 2))
    rows = [(1, float(a), float(b)) for a, b in xy] + [(1, None, 2.0), (2, 1.0, 1.0), (2, 2.0, 2.0)]
    got = {r["g"]: r for r in share_in_ellipse(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}
    inverse = np.linalg.inv(np.cov(xy, rowvar=False))
    assert got[1]["n"] == 200 and got[1]["inside"] == pytest.approx((np.einsum("ij,jk,ik->i", xy, inverse, xy) < 1).mean())
    assert got[2]["n"] == 2 and got[2]["inside"] is None


def test_a_displacement_that_does_not_vary_has_no_ellipse(spark):
    from penumbra.operators import directions

    # 0.5 / 103 * 103 is below 0.5, so means merged from several tasks differ by rounding
    sizes = (103, 107)
    rows = spark.sparkContext.parallelize(range(2), 2).flatMap(lambda k: [(1, 0.5, at % 13 / 10.0) for at in range(sizes[k])])
    df = spark.createDataFrame(rows, "g int, x double, y double")
    for x, y in ("xy", "yx"):
        assert [tuple(r) for r in directions.share_in_ellipse(df, ["g"], x, y).collect()] == [(1, 210, None)]
