"""Polygons as rasters.

Polygons are rows (place, value, rings): rings are arrays of (x, y), the outer
ones and holes alike, closed or not. A pixel belongs to a polygon if its centre
lies inside an odd number of rings; where polygons overlap, the one of the
largest ``place`` has the pixel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.functions.geo import map_to_pixel
from penumbra.store import settle

#: Rings of a slice of a grid cell, pairs of rings taken at once, and pairs of edges compared at once.
RINGS, PAIRS, EDGES = 256, 4096, 200_000


def _edges(ring: Column) -> Column:
    """The edges of a ring, from each corner to the next, the last to the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def scan_crossings(polygons: DataFrame, transform: Sequence[float], rows: int) -> DataFrame:
    """(place, value, i, at): the fractional column where an edge crosses the centres of row i.

    Edges are cut to the rows that they cross, the lower end left out, so a
    corner on a row counts once.
    """
    edges = polygons.select("place", "value", F.explode("rings").alias("ring")).select("place", "value", F.explode(_edges(F.col("ring"))).alias("e"))
    (i1, j1), (i2, j2) = (map_to_pixel(transform, F.col(f"e.{c}.x"), F.col(f"e.{c}.y")) for c in "pq")
    # pixel centres lie half a pixel inside, so they get whole numbers here
    flat = edges.select("place", "value", *((c.cast("double") - 0.5).alias(n) for n, c in {"i1": i1, "j1": j1, "i2": i2, "j2": j2}.items()))
    first, last = F.ceil(F.greatest(F.least("i1", "i2"), F.lit(0.0))), F.least(F.ceil(F.greatest("i1", "i2")) - 1, F.lit(rows - 1))
    cut = flat.withColumns({"first": first, "last": last}).filter("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    return cut.select("place", "value", "i", (F.col("j1") + (F.col("i") - F.col("i1")) * (F.col("j2") - F.col("j1")) / (F.col("i2") - F.col("i1"))).alias("at"))


def spans(polygons: DataFrame, transform: Sequence[float], shape: tuple[int, int]) -> DataFrame:
    """(place, value, i, first, last): the runs of pixels of each polygon, row by row."""
    rows, columns = shape
    crossed = scan_crossings(polygons, transform, rows).groupBy("place", "value", "i").agg(F.sort_array(F.collect_list("at")).alias("at"))  # the crossings of one row
    pair = F.sequence(F.lit(0), F.floor(F.size("at") / 2).cast("int") - 1)
    runs = F.transform(pair, lambda k: F.struct(F.ceil(F.greatest(F.get("at", 2 * k), F.lit(0.0))).alias("first"), F.least(F.ceil(F.get("at", 2 * k + 1)) - 1, F.lit(columns - 1)).alias("last")))
    return crossed.filter("size(at) > 1").select("place", "value", "i", F.explode(runs).alias("run")).select("place", "value", "i", "run.first", "run.last").filter("first <= last")


def rasterise(polygons: DataFrame, transform: Sequence[float], shape: tuple[int, int]) -> DataFrame:
    """(i, j, value) of all pixels that a polygon has; of several the last by ``place``.

    Edges become crossings of rows, crossings become spans, and spans become
    pixels; no task sees a whole polygon or raster. Polygons of null place,
    value or rings have no pixels.
    """
    cells = spans(polygons.filter("place IS NOT NULL AND value IS NOT NULL"), transform, shape).withColumn("j", F.explode(F.sequence("first", "last")))
    return cells.groupBy("i", "j").agg(F.max_by("value", "place").alias("value"))


def centres(shape: tuple[int, int], transform: Sequence[float], spark) -> DataFrame:
    """(i, j, x, y) of all pixel centres."""
    rows, columns = shape
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
    x0, dxj, dxi, y0, dyj, dyi = transform
    i, j = F.col("i") + 0.5, F.col("j") + 0.5
    return cells.select("i", "j", (j * dxj + i * dxi + x0).alias("x"), (j * dyj + i * dyi + y0).alias("y"))


def unwrapped(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Copies of a ring of longitudes that may cross the antimeridian: one where it doesn't.

    A ring wider than half the globe crosses: its western longitudes are raised
    by a turn, and the ring comes back there and a turn lower, so every place of
    -180 to 180 degrees meets it.
    """
    lon = F.transform(ring, lambda p: p[x])
    crosses = F.array_max(lon) - F.array_min(lon) > 180

    def moved(by: Column | float) -> Column:
        return F.transform(ring, lambda p: F.struct((p[x] + by).alias("x"), p[y].alias("y")))

    raised = F.transform(ring, lambda p: F.struct(F.when(p[x] < 0, p[x] + 360).otherwise(p[x]).alias("x"), p[y].alias("y")))
    lowered = F.transform(raised, lambda p: F.struct((p["x"] - 360).alias("x"), p["y"].alias("y")))
    return F.when(crosses, F.array(raised, lowered)).otherwise(F.array(moved(0.0)))


def _turns(a: Column, b: Column, c: Column) -> Column:
    """The sign of the turn from a over b to c."""
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def rings_cross(first: Column, second: Column) -> Column:
    """Whether an edge of one ring crosses one of the other, touching ends left out."""

    def cross(e: Column, f: Column) -> Column:
        return (_turns(e["p"], e["q"], f["p"]) * _turns(e["p"], e["q"], f["q"]) < 0) & (_turns(f["p"], f["q"], e["p"]) * _turns(f["p"], f["q"], e["q"]) < 0)

    return F.exists(_edges(first), lambda e: F.exists(_edges(second), lambda f: cross(e, f)))


def ring_holds(ring: Column, place: Column) -> Column:
    """Whether a ring holds a place: a ray from there crosses it an odd number of times."""

    def crossed(e: Column) -> Column:
        spans = (e["p"]["y"] > place["y"]) != (e["q"]["y"] > place["y"])
        return spans & (place["x"] < e["p"]["x"] + (place["y"] - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"]))

    return F.size(F.filter(_edges(ring), crossed)) % 2 == 1


def _relations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, r) of candidate pairs of rings (u, v, x_1, y_1, x_2, y_2): 2 crosses, 1 holds, 0 within; pairs apart are left out."""
    for whole in batches:
        for at in range(0, len(whole), PAIRS):
            batch = whole.slice(at, PAIRS)
            n_1, n_2 = (batch.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("x_1", "x_2"))
            r = np.full(len(batch), -1)
            # rings of like sizes go together
            sizes, group = np.unique(np.stack([n_1, n_2]), axis=1, return_inverse=True)
            group = group.ravel()
            for k, (m, n) in enumerate(sizes.T.tolist()):
                rows = np.flatnonzero(group == k)
                step = max(1, EDGES // (m * n))
                for low in range(0, len(rows), step):
                    some = rows[low : low + step]
                    held = batch.take(pa.array(some))
                    a, b = (tuple(held.column(f"{c}_{side}").flatten().to_numpy().reshape(-1, size) for c in "xy") for side, size in ((1, m), (2, n)))
                    inside = np.where(_ring_holds(a, b), 1, np.where(_ring_holds(b, a), 0, -1))
                    r[some] = np.where(_rings_cross(a, b), 2, inside)
            met = np.flatnonzero(r >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(met)), batch.column("v").take(pa.array(met)), pa.array(r[met], pa.int32())], ["u", "v", "r"])


_Rings = tuple[np.ndarray, np.ndarray]


def _ahead(a: _Rings) -> _Rings:
    return np.roll(a[0], -1, axis=1), np.roll(a[1], -1, axis=1)


def _rings_cross(a: _Rings, b: _Rings) -> np.ndarray:
    """``rings_cross`` of rows of rings of equal size."""
    (px, py), (qx, qy) = (tuple(c[:, :, None] for c in r) for r in (a, _ahead(a)))
    (sx, sy), (tx, ty) = (tuple(c[:, None, :] for c in r) for r in (b, _ahead(b)))

    def turns(ax, ay, bx, by, cx, cy):
        return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))

    first = turns(px, py, qx, qy, sx, sy) * turns(px, py, qx, qy, tx, ty) < 0
    return (first & (turns(sx, sy, tx, ty, px, py) * turns(sx, sy, tx, ty, qx, qy) < 0)).any(axis=(1, 2))


def _ring_holds(a: _Rings, b: _Rings) -> np.ndarray:
    """``ring_holds`` of rows of rings, for the first corner of ``b``."""
    (px, py), (qx, qy), (x, y) = a, _ahead(a), (b[0][:, :1], b[1][:, :1])
    spans = (py > y) != (qy > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = px + (y - py) * (qx - px) / (qy - py)
    return (spans & (x < at)).sum(axis=1) % 2 == 1


def meeting(first: DataFrame, second: DataFrame, size: float) -> DataFrame:
    """(id_1, id_2, relation) of polygons (id, ring: array of (x, y)) that share area; each pair once.

    ``relation`` is ``crosses``, ``holds`` (the first holds the second) or
    ``within``. Equal rings are compared once, whatever ids they have. Pairs come
    from an equi-join on the grid cells of ``size`` that both boxes cover, cells
    cut into slices of ``RINGS`` rings; a pair is taken from the one cell where
    the boxes' overlap begins, and only those are compared edge by edge. Rings of
    one id are its parts; an id with several parts meets if one does. Corners are
    finite.
    """
    sides = []
    for df in (first, second):
        x, y = F.transform("ring", lambda p: p["x"].cast("double")), F.transform("ring", lambda p: p["y"].cast("double"))
        sides.append(df.filter("size(ring) > 2").select("id", x.alias("x"), y.alias("y")))
    rings = settle(sides[0].select("x", "y").unionByName(sides[1].select("x", "y")).distinct().withColumn("u", F.monotonically_increasing_id()), "rings")
    members = [settle(side.join(rings, ["x", "y"]).select("id", "u").distinct(), "members") for side in sides]

    def covered(side: DataFrame, k: int) -> DataFrame:
        boxes = rings.join(side.select("u").distinct(), "u", "left_semi").select("u", "x", "y", F.array_min("x").alias("west"), F.array_max("x").alias("east"), F.array_min("y").alias("south"), F.array_max("y").alias("north"))
        cells = {c: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)) for c, low, high in (("cx", "west", "east"), ("cy", "south", "north"))}
        return boxes.withColumn("cx", F.explode(cells["cx"])).withColumn("cy", F.explode(cells["cy"])).select(*(F.col(c).alias(f"{c}_{k}") for c in ("u", "x", "y", "west", "east", "south", "north")), "cx", "cy")

    one, other = covered(members[0], 1), covered(members[1], 2)
    cut = [side.groupBy("cx", "cy").agg(F.ceil(F.count("*") / RINGS).alias(f"g_{k}")) for k, side in ((1, one), (2, other))]
    slices = settle(cut[0].join(cut[1], ["cx", "cy"]), "slices")
    dealt = []
    for k, side in ((1, one), (2, other)):
        own, every = F.pmod(F.xxhash64(f"u_{k}"), F.col(f"g_{k}")).alias(f"s_{k}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"g_{3 - k}") - 1)).alias(f"s_{3 - k}")
        dealt.append(side.join(slices, ["cx", "cy"]).select(*side.columns, own, every))
    begins = (F.col("cx") == F.floor(F.greatest("west_1", "west_2") / size)) & (F.col("cy") == F.floor(F.greatest("south_1", "south_2") / size))
    overlap = F.expr("west_1 < east_2 AND west_2 < east_1 AND south_1 < north_2 AND south_2 < north_1")
    met = dealt[0].join(dealt[1], ["cx", "cy", "s_1", "s_2"]).filter(begins & overlap)
    met = met.select(F.col("u_1").alias("u"), F.col("u_2").alias("v"), *(f"{c}_{k}" for k in (1, 2) for c in "xy"))
    related = settle(met.mapInArrow(_relations, "u long, v long, r int"), "relations")
    ids = [side.select(F.col("id").alias(f"id_{k}"), F.col("u").alias(n)) for k, n, side in ((1, "u", members[0]), (2, "v", members[1]))]
    found = related.join(ids[0], "u").join(ids[1], "v")
    name = F.element_at(F.array(F.lit("within"), F.lit("holds"), F.lit("crosses")), F.col("r") + 1)
    if all(side.groupBy("id").count().filter("count > 1").isEmpty() for side in members):
        return found.select("id_1", "id_2", name.alias("relation"))
    return found.groupBy("id_1", "id_2").agg(F.max("r").alias("r")).select("id_1", "id_2", name.alias("relation"))
