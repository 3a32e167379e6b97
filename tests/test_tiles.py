"""Rasterised polygons, regions, filters on tiles and Fourier transforms against brute force on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.operators import fourier, polygons, regions, tiles

SHAPE = (23, 31)


def frame(spark, image, name="a"):
    rows = [(name, int(i), int(j), None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "raster_id string, i long, j long, value double")


def array(rows, name="value", shape=SHAPE):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r["i"], r["j"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).normal(0, 1, SHAPE)


def mirrored(image, radius):
    wide = np.pad(image, radius, mode="symmetric")
    return {(i, j): wide[i : i + 2 * radius + 1, j : j + 2 * radius + 1] for i, j in np.ndindex(image.shape)}


def test_medians_in_steps_on_tiles_of_any_size(spark, image):
    want = image
    for _ in range(4):
        want = np.array([np.median(w) for w in mirrored(want, 1).values()]).reshape(SHAPE)
    for side in (4, 8, 64):
        got = array(tiles.median_filter(frame(spark, image), SHAPE, 3, 4, side=side).collect())
        assert np.array_equal(got, want), side


def test_kuwahara_and_planes(spark, image):
    want, misfit = np.zeros(SHAPE), np.zeros(SHAPE)
    a, b = np.mgrid[-2:3, -2:3]
    design = np.stack([a.ravel(), b.ravel(), np.ones(25)], 1)
    for at, w in mirrored(image, 2).items():
        blocks = [w[:3, :3], w[2:, :3], w[:3, 2:], w[2:, 2:]]
        want[at] = min(blocks, key=np.var).mean()
        misfit[at] = np.std(w.ravel() - design @ np.linalg.lstsq(design, w.ravel(), rcond=None)[0])
    df = frame(spark, image)
    assert np.allclose(array(tiles.kuwahara_filter(df, SHAPE, 5, side=8).collect()), want, atol=1e-12)
    assert np.allclose(array(tiles.plane_misfit(df, SHAPE, 5, side=8).collect()), misfit, atol=1e-9)


@pytest.mark.parametrize("neighbours", [4, 8])
def test_diffusion(spark, image, neighbours):
    want = image.copy()
    for _ in range(5):
        new = want.copy()
        for i in range(1, SHAPE[0] - 1):
            for j in range(1, SHAPE[1] - 1):
                for di in (-1, 0, 1):
                    for dj in (-1, 0, 1):
                        if (di, dj) != (0, 0) and (neighbours == 8 or 0 in (di, dj)):
                            d = (want[i + di, j + dj] - want[i, j]) / np.hypot(di, dj)
                            new[i, j] += d * np.exp(-((d / 0.8) ** 2)) / neighbours
        want = new
    got = array(tiles.diffusion_filter(frame(spark, image), SHAPE, 5, noise=0.8, neighbours=neighbours, side=3).collect())
    assert np.allclose(got, want, atol=1e-12)


def test_null_and_missing_pixels(spark, image):
    holed = image.copy()
    holed[5, 5] = np.nan
    df = frame(spark, holed).filter("i <> 9 OR j <> 9")
    got = tiles.median_filter(df, SHAPE, 3, side=8)
    rows = got.collect()
    assert len(rows) == SHAPE[0] * SHAPE[1] - 1 and sum(r["value"] is None for r in rows) == 9 + 8
    filled = array(tiles.plane_misfit(df, SHAPE, 3, side=8).collect())
    assert not np.isnan(filled[5, 5])
    two = df.unionByName(frame(spark, -image, "b"))
    assert tiles.median_filter(two, SHAPE, 3, side=8).filter("raster_id = 'b' AND value IS NOT NULL").count() == SHAPE[0] * SHAPE[1]
    assert tiles.median_filter(df.limit(0), SHAPE, 3).count() == 0


@pytest.mark.parametrize("shape", [SHAPE, (16, 24), (1, 7), (5, 1)])
def test_transform_and_back(spark, monkeypatch, shape):
    image = np.random.default_rng(2).normal(0, 1, shape)
    for cells in (1, 60, 1 << 21):
        monkeypatch.setattr(fourier, "CELLS", cells)
        df = frame(spark, image)
        spectrum = fourier.spectrum(df, shape)
        want = np.fft.fft2(image)
        for r in spectrum.collect():
            assert abs(complex(r["re"], r["im"]) - want[r["u"], r["v"]]) < 1e-9
        assert np.allclose(array(fourier.image(spectrum, shape).collect(), shape=shape), image, atol=1e-9)


def test_parts_of_a_field_add_up_and_are_free_of_turn_and_of_sources(spark, image):
    rng = np.random.default_rng(3)
    dx, dy = image, rng.normal(0, 1, SHAPE)
    df = frame(spark, dx).withColumnRenamed("value", "dx").join(frame(spark, dy).withColumnRenamed("value", "dy"), ["raster_id", "i", "j"])
    rows = fourier.flow_parts(df, SHAPE).collect()
    part = {n: array(rows, n) for n in ("turning_x", "turning_y", "spreading_x", "spreading_y")}
    assert np.allclose(part["turning_x"] + part["spreading_x"], dx, atol=1e-9) and np.allclose(part["turning_y"] + part["spreading_y"], dy, atol=1e-9)
    wy, wx = np.meshgrid(np.fft.fftfreq(SHAPE[0]), np.fft.fftfreq(SHAPE[1]), indexing="ij")
    hat = {n: np.fft.fft2(v) for n, v in part.items()}
    assert np.abs(wx * hat["turning_x"] + wy * hat["turning_y"]).max() < 1e-9
    assert np.abs(wy * hat["spreading_x"] - wx * hat["spreading_y"]).max() < 1e-9
    holed = df.withColumn("dx", F.when((F.col("i") == 3) & (F.col("j") == 4), None).otherwise(F.col("dx")))
    assert fourier.flow_parts(holed, SHAPE).filter("turning_x IS NULL").count() == 1


def test_periodic_part_has_borders_that_meet(spark):
    i, j = np.indices(SHAPE)
    image = 0.7 * i - 0.4 * j + np.sin(i / 3)
    rows = fourier.periodic_parts(frame(spark, image), SHAPE).collect()
    periodic, smooth = array(rows, "periodic"), array(rows, "smooth")
    assert np.allclose(periodic + smooth, image, atol=1e-9)
    assert np.abs(periodic[0] - periodic[-1]).mean() < 0.25 * np.abs(image[0] - image[-1]).mean()
    # away from the borders the smooth part solves Laplace's equation
    bend = smooth[:-2, 1:-1] + smooth[2:, 1:-1] + smooth[1:-1, :-2] + smooth[1:-1, 2:] - 4 * smooth[1:-1, 1:-1]
    assert np.abs(bend).max() < 1e-9


def test_heights_come_back_from_their_shading(spark):
    shape = (24, 32)
    i, j = np.indices(shape)
    height = np.sin(2 * np.pi * (2 * j / 32 + i / 24)) + 0.5 * np.cos(2 * np.pi * 3 * j / 32)
    shade = 2 * np.pi * np.cos(2 * np.pi * (2 * j / 32 + i / 24)) * (2 / 32 * np.cos(0.5) + 1 / 24 * np.sin(0.5)) - 0.5 * 2 * np.pi * 3 / 32 * np.sin(2 * np.pi * 3 * j / 32) * np.cos(0.5)
    got = array(fourier.surface_of_shading(frame(spark, shade * np.sin(0.6)), shape, np.degrees(0.5), np.degrees(0.6)).collect(), shape=shape)
    assert np.allclose(got, height, atol=1e-9)


def test_stencils_keep_rows_and_know_missing_pixels(spark, image):
    from penumbra.operators.rasters import CURVATURE, GRADIENT_DOWN

    df = frame(spark, image).filter("i <> 4 OR j <> 7").withColumn("i", F.col("i") - 5).withColumn("other", F.lit("kept"))
    rows = tiles.stencils(df, {"bend": CURVATURE, "down": GRADIENT_DOWN}, side=4).collect()
    assert len(rows) == SHAPE[0] * SHAPE[1] - 1 and all(r["other"] == "kept" for r in rows)
    held = image.copy()
    held[4, 7] = np.nan
    for r in rows:
        i, j = r["i"] + 5, r["j"]
        for name, kernel in (("bend", CURVATURE), ("down", GRADIENT_DOWN)):
            near = [w * held[i + a, j + b] if 0 <= i + a < SHAPE[0] and 0 <= j + b < SHAPE[1] else np.nan for (a, b), w in kernel.items()]
            assert (r[name] is None) == bool(np.isnan(near).any()) and (r[name] is None or abs(r[name] - sum(near)) < 1e-12)


def plain_regions(values, neighbours):
    label = {}
    for start, v in np.ndenumerate(values):
        if not v or start in label:
            continue
        todo, label[start] = [start], start
        while todo:
            i, j = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    to = (i + a, j + b)
                    if (neighbours == 4 and a and b) or to in label or not (0 <= to[0] < values.shape[0] and 0 <= to[1] < values.shape[1]) or values[to] != v:
                        continue
                    label[to] = start
                    todo.append(to)
    return {k: i * 2**32 + j for k, (i, j) in label.items()}


@pytest.mark.parametrize("neighbours", [4, 8])
@pytest.mark.parametrize("seed", range(3))
def test_regions(spark, neighbours, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 3, (19, 26)) if seed else np.zeros((19, 26), int)
    if not seed:  # one line that winds through all tiles
        values[::2] = 1
        values[1::4, -1] = values[3::4, 0] = 1
    for side in (4, 7, 32):
        rows = regions.regions(frame(spark, values.astype(float)), neighbours, side).collect()
        assert {(r["i"], r["j"]): r["region"] for r in rows} == plain_regions(values, neighbours), side
        assert all(r["value"] == values[r["i"], r["j"]] for r in rows)


def test_regions_of_two_rasters_stay_apart(spark):
    one = np.ones((9, 9))
    both = frame(spark, one).unionByName(frame(spark, one, "b"))
    rows = regions.regions(both, 8, 4).groupBy("raster_id", "region").count().collect()
    assert sorted(tuple(r) for r in rows) == [("a", 0, 81), ("b", 0, 81)]
    assert regions.regions(both.filter("value > 5"), 8, 4).count() == 0


@pytest.mark.parametrize("azimuth", [0, 30, 45, 90, 135, 200, 300])
def test_every_pixel_lies_on_one_line_of_light(spark, azimuth):
    rows = regions.sun_lines(frame(spark, np.ones((12, 15))), azimuth).collect()
    assert len({(r["line"], r["step"]) for r in rows}) == len(rows)
    away = np.array([np.cos(np.radians(azimuth)), -np.sin(np.radians(azimuth))])
    lines = {}
    for r in rows:
        lines.setdefault(r["line"], []).append((r["step"], r["i"], r["j"]))
    for points in lines.values():
        points = np.array(sorted(points), float)
        steps = np.diff(points, axis=0)
        assert (steps[:, 0] == 1).all() and np.abs(steps[:, 1:]).max(initial=0) <= 1
        if len(points) > 3:
            assert (points[-1, 1:] - points[0, 1:]) @ away > 0


def test_casters_and_casted(spark):
    values = np.zeros((10, 12))
    values[2:8, 5:7] = 1
    values[4, 5] = 0
    labelled = regions.regions(frame(spark, values), 8, 4)
    rows = regions.casters_and_casted(labelled, 0).select("caster_i", "caster_j", "casted_i", "casted_j", "length").collect()
    assert sorted(tuple(r) for r in rows) == [(2, 5, 3, 5, 1), (2, 6, 7, 6, 5), (5, 5, 7, 5, 2)]
    west = regions.casters_and_casted(labelled, 270).select("caster_i", "caster_j", "casted_i", "casted_j", "length").collect()
    assert (2, 5, 2, 6, 1) in {tuple(r) for r in west}


def inside(rings, x, y):
    crossed = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                crossed += 1
    return crossed % 2 == 1


@pytest.mark.parametrize("seed", range(4))
def test_polygons_against_all_centres(spark, seed):
    rng = np.random.default_rng(seed)
    transform, shape = (100.0, 3.0, 0.0, 900.0, 0.0, -4.0), (21, 27)
    made = []
    for place in range(8):
        x, y = 100 + rng.uniform(-20, 100), 900 - rng.uniform(-20, 100)
        angles = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 12))))
        outer = [(float(x + r * np.cos(t)), float(y + r * np.sin(t))) for t, r in zip(angles, rng.uniform(5, 40, len(angles)), strict=True)]
        hole = [(float(x + 2 * a), float(y + 3 * b)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        closed = [*outer, outer[0]] if place % 2 else outer
        made.append((place, place * 10, [closed, hole] if place % 3 else [closed]))
    made += [(None, 1, [[(0.0, 0.0), (1e4, 0.0), (0.0, 1e4)]]), (9, None, [[(0.0, 0.0), (1e4, 0.0), (0.0, 1e4)]]), (10, 5, None), (11, 6, []), (12, 7, [[]]), (13, 8, [[(110.0, 880.0)]])]
    df = spark.createDataFrame(made, "place long, value long, rings array<array<struct<x: double, y: double>>>")
    got = {(r["i"], r["j"]): r["value"] for r in polygons.rasterise(df, transform, shape).collect()}
    want = {}
    for r in polygons.centres(shape, transform, spark).collect():
        held = [v for p, v, rings in made[:8] if inside([ring[:-1] if ring[0] == ring[-1] else ring for ring in rings], r["x"], r["y"])]
        if held:
            want[r["i"], r["j"]] = held[-1]
    assert got == want
