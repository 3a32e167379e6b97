"""Templates at posts, masked correlation and phase planes, on rasters with known moves."""

import numpy as np
import pytest

from penumbra.operators import phase_planes, templates


def moved_pair(size, move, seed, smooth=0.1):
    """Two cuts of a random field, the second moved by ``move``."""
    rng = np.random.default_rng(seed)
    n = 4 * size
    field = np.fft.fft2(rng.standard_normal((n, n)))
    fi, fj = phase_planes.frequencies((n, n))
    field *= np.exp(-(fi**2 + fj**2) / (2 * smooth**2))
    a, b = np.real(np.fft.ifft2(field)), np.real(np.fft.ifft2(field * phase_planes.plane(move, (n, n))))
    return a[size : 2 * size, size : 2 * size], b[size : 2 * size, size : 2 * size]


@pytest.mark.parametrize("method", sorted(phase_planes.METHODS))
def test_planes_of_moves_below_a_pixel(method):
    rng = np.random.default_rng(4)
    for seed in range(6):
        move = rng.uniform(-1, 1, 2)
        exact = phase_planes.METHODS[method](phase_planes.plane(move, (32, 32)), phase_planes.cross_spectrum(*moved_pair(32, move, seed))[1], 1)
        assert np.abs(exact - move).max() < (0.01 if method == "zoom" else 1e-6)
        found = phase_planes.METHODS[method](*phase_planes.cross_spectrum(*moved_pair(32, move, seed)), 1)
        assert np.abs(found - move).max() < (0.4 if method == "diff" else 0.1), (method, move, found)


@pytest.mark.parametrize("code", ["grad_corr", "grad_norm", "wind_corr", "phas_only", "symm_phas", "robu_corr", "orie_corr"])
def test_correlators_find_whole_moves(code):
    from penumbra.operators import matching

    for seed, move in enumerate([(3, -2), (0, 0), (-5, 1)]):
        a, b = moved_pair(32, move, seed, smooth=0.2)
        found = matching.locate(a, b, code, None)
        assert (found["di"], found["dj"]) == move, code


@pytest.mark.parametrize("method", ["svd", "tpss", "ransac", "hough", "radon", "zoom"])
def test_planes_that_wrap(method):
    # unwrapping along singular vectors holds for an eighth of the template
    for seed, move in enumerate([(2.3, -2.6), (-3.1, 3.3)] if method == "svd" else [(4.3, -2.6), (-5.1, 3.3), (0.4, 6.2)]):
        exact = phase_planes.METHODS[method](phase_planes.plane(move, (32, 32)), phase_planes.cross_spectrum(*moved_pair(32, move, seed))[1], 1)
        assert np.abs(exact - move).max() < (0.01 if method == "zoom" else 1e-6)
        found = phase_planes.METHODS[method](*phase_planes.cross_spectrum(*moved_pair(32, move, seed)), 1)
        assert np.abs(found - np.array(move)).max() < 0.2 * np.abs(move).max()


def test_flat_templates_do_not_move():
    for method in phase_planes.METHODS.values():
        move = method(*phase_planes.cross_spectrum(np.ones((8, 8)), np.ones((8, 8))), 1)
        assert np.isfinite(move).all()


def test_fits_as_a_table(spark):
    rows = [(k, a.ravel().tolist(), b.ravel().tolist()) for k in range(5) for a, b in [moved_pair(24, (0.1 * k, -0.15 * k), k)]]
    pairs = spark.createDataFrame(rows, "id long, template_1 array<double>, template_2 array<double>")
    for found in (phase_planes.fit_planes(pairs, "id", "ransac"), phase_planes.robust_planes(phase_planes.phase_points(pairs, "id"), ["id"])):
        for r in found.collect():
            assert abs(r["di"] - 0.1 * r["id"]) < 0.15 and abs(r["dj"] + 0.15 * r["id"]) < 0.15
    with pytest.raises(ValueError):
        phase_planes.fit_planes(pairs, "id", "other")


def test_all_methods_in_one_pass(spark):
    """As each method by itself, on a pair that is read once."""
    rows = [(k, a.ravel().tolist(), b.ravel().tolist()) for k in range(4) for a, b in [moved_pair(12, (0.1 * k, -0.15 * k), k)]] + [(9, [1.0] * 64, [1.0] * 64)]
    pairs = spark.createDataFrame(rows, "id long, template_1 array<double>, template_2 array<double>")
    together = {(r["id"], r["method"]): (r["di"], r["dj"], r["agreement"]) for r in phase_planes.fit_all_planes(pairs, "id").collect()}
    for method in ("ransac", "hough", "radon", "tpss"):
        alone = {(r["id"], method): (r["di"], r["dj"], r["agreement"]) for r in phase_planes.fit_planes(pairs, "id", method).collect()}
        assert alone == {k: v for k, v in together.items() if k[1] == method}
    assert len(together) == len(rows) * len(phase_planes.METHODS)
    with pytest.raises(ValueError):
        phase_planes.fit_all_planes(pairs, "id", ["lsq", "other"])


def test_methods_count_each_row_once(spark, tmp_path):
    """Rows that share an id are not paired with each other; a table without rows names all methods."""
    from penumbra.plans.templates import phase_plane_methods

    rng = np.random.default_rng(2)
    for name, rows in (("some", [(k // 2, rng.standard_normal(64).tolist()) for k in range(6)]), ("none", [])):
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = {r["method"]: r["n"] for r in phase_plane_methods(spark, f"{tmp_path}/{name}").collect()}
        assert found == dict.fromkeys(phase_planes.METHODS, len(rows))


def test_masked_correlation_against_every_lag():
    rng = np.random.default_rng(6)
    a, b = rng.normal(5, 1, (6, 7)), rng.normal(3, 2, (6, 7))
    a[rng.random(a.shape) < 0.2] = np.nan
    b[rng.random(b.shape) < 0.3] = np.nan
    score, overlap = templates.masked_correlation(a, b)
    for di in range(-5, 6):
        for dj in range(-6, 7):
            x = [(a[i, j], b[i + di, j + dj]) for i in range(6) for j in range(7) if 0 <= i + di < 6 and 0 <= j + dj < 7 and not np.isnan(a[i, j] + b[i + di, j + dj])]
            assert overlap[di + 5, dj + 6] == len(x)
            if len(x) > 2:
                assert abs(score[di + 5, dj + 6] - np.corrcoef(np.array(x).T)[0, 1]) < 1e-8
    nothing, none = templates.masked_correlation(np.full((3, 3), np.nan), np.ones((3, 3)))
    assert not nothing.any() and not none.any()


def test_likeliest_place_of_speckle(spark):
    rng = np.random.default_rng(7)
    texture = rng.gamma(2.0, 1.0, (20, 20))
    rows = []
    for k, (di, dj) in enumerate([(0, 0), (2, -3), (-4, 1)]):
        image = texture * rng.gamma(50, 1 / 50, texture.shape)
        part = texture[6 + di : 13 + di, 6 + dj : 13 + dj] * rng.gamma(50, 1 / 50, (7, 7)) * 3
        rows.append((k, part.ravel().tolist(), image[:19, :19].ravel().tolist()))
    pairs = spark.createDataFrame(rows, "id long, template_1 array<double>, template_2 array<double>")
    got = {r["id"]: (r["di"], r["dj"]) for r in templates.match_likelihood(pairs, "id").collect()}
    assert got == {0: (0, 0), 1: (2, -3), 2: (-4, 1)}


def frame(spark, image):
    rows = [("a", int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "raster_id string, i long, j long, value double")


def test_templates_across_tiles(spark):
    image = np.arange(20 * 26, dtype=float).reshape(20, 26)
    posts = [(k, int(i), int(j)) for k, (i, j) in enumerate(np.random.default_rng(8).integers(0, (20, 26), (60, 2)))] + [(60, 0, 0), (61, 19, 25), (62, 40, 3)]
    df = spark.createDataFrame([("a", *p) for p in posts], "raster_id string, id long, i long, j long")
    for side in (4, 9, 64):
        got = {r["id"]: r["template"] for r in templates.templates_at(df, frame(spark, image), image.shape, 3, side).collect()}
        assert len(got) == len(posts)
        for k, i, j in posts:
            whole = 3 <= i < 17 and 3 <= j < 23
            assert got[k] == (image[i - 3 : i + 4, j - 3 : j + 4].ravel().tolist() if whole else None)


def test_posts_are_followed_below_a_pixel(spark):
    rng = np.random.default_rng(9)
    n, move = 96, (2.35, -1.6)
    field = np.fft.fft2(rng.standard_normal((n, n)))
    fi, fj = phase_planes.frequencies((n, n))
    field *= np.exp(-(fi**2 + fj**2) / (2 * 0.1**2))
    first, second = np.real(np.fft.ifft2(field)), np.real(np.fft.ifft2(field * phase_planes.plane(move, (n, n))))
    posts = spark.createDataFrame([("a", k, 24 + 8 * (k // 6), 24 + 8 * (k % 6)) for k in range(36)], "raster_id string, id long, i long, j long")
    rows = templates.match_posts(posts, frame(spark, first), frame(spark, second), (n, n), 15, side=32).collect()
    errors = [max(abs(r["di"] - move[0]), abs(r["dj"] - move[1])) for r in rows]
    assert len(rows) == 36 and np.median(errors) < 0.05 and max(errors) < 0.3
    whole = templates.match_posts(posts, frame(spark, first), frame(spark, second), (n, n), 15, refine=None, side=32).collect()
    assert {(r["di"], r["dj"], r["agreement"]) for r in whole} <= {(float(a), float(b), None) for a in (1, 2, 3) for b in (-3, -2, -1)}
