"""Queries of spectral weights and of peaks between cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions import peaks, tapers
from penumbra.operators import entropy
from penumbra.plans.pixels import rounded, rounded_sql
from penumbra.plans.registry import register
from penumbra.plans.views import PIXELS, pixels, read

#: Customers lie row by row in a spectrum of this size.
_ROWS, _COLUMNS = 30, 41
_CELLS = f"""(SELECT *, pow(cos((r - (5e-1 - 35e-2)) * (pi() / 7e-1)), 2e0) AS slope FROM (SELECT *, sqrt(x * x + y * y) AS r FROM (
 SELECT *, (cj * (41e0 / 40e0) - 20) / 41e0 AS x, ((29 - ci) * (30e0 / 29e0) - 15) / 30e0 AS y, (j * (41e0 / 40e0) - 20) / 41e0 AS mx, ((29 - i) * (30e0 / 29e0) - 15) / 30e0 AS my FROM (
 SELECT *, (i + 15) % 30 AS ci, (j + 21) % 41 AS cj FROM (SELECT c_custkey AS id, (c_custkey // 41) % 30 AS i, c_custkey % 41 AS j FROM customer)))))"""


def _window_sql(*terms: float) -> str:
    def along(k: str, size: int) -> str:
        return " + ".join([repr(terms[0]) + "::DOUBLE"] + [f"{a!r}::DOUBLE * cos(2e0 * pi() * {p} * {k} / {size - 1})" for p, a in enumerate(terms[1:], 1)])

    return f"sqrt(greatest(({along('ci', _ROWS)}) * ({along('cj', _COLUMNS)}), 0e0))"


@register("spectral_windows", rounded_sql(_CELLS, {
    "fx": "2e0 * pi() * x", "fy": "2e0 * pi() * y", "raised": "CASE WHEN r < 5e-1 - 35e-2 THEN 1 WHEN r <= 5e-1 THEN slope ELSE 0 END",
    "bell": "CASE WHEN r <= 5e-1 THEN 5e-1 * cos(2e0 * pi() * r) + 5e-1 ELSE 0 END", "rectangle": "CASE WHEN abs(x) <= 3e-1 AND abs(y) <= 3e-1 THEN 1 ELSE 0 END",
    "circle": "CASE WHEN sqrt(mx * mx + my * my) <= 3e-1 THEN 1 ELSE 0 END", "ellipse": "CASE WHEN sqrt(4e0 * x * x + y * y) <= 4e-1 THEN 1 ELSE 0 END",
    "high": "CASE WHEN r >= 3e-1 THEN 1 ELSE 0 END", "hanning": _window_sql(0.5, -0.5), "hamming": _window_sql(0.54, -0.46), "blackman": _window_sql(0.42, -0.5, 0.08),
}, keys=("id",), digits=6))
def spectral_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and weights of the cells that customers stand for."""
    k = F.col("c_custkey")
    cells = read(spark, sf_dir, "customer").select(k.alias("id"), F.pmod(F.floor(k / _COLUMNS), F.lit(_ROWS)).alias("i"), F.pmod(k, F.lit(_COLUMNS)).alias("j"))
    at = (F.col("i"), F.col("j"), _ROWS, _COLUMNS)
    fx, fy = tapers.fourier_grid(*at, system="radians")
    return rounded(cells, {
        "fx": fx, "fy": fy, "raised": tapers.raised_cosine(*at), "bell": tapers.cosine_bell(*at), "rectangle": tapers.low_pass_rectangle(*at, r=0.3),
        "circle": tapers.low_pass_circle(*at, r=0.3), "ellipse": tapers.low_pass_ellipse(*at, r_x=0.4, r_y=0.2), "high": tapers.high_pass_circle(*at, r=0.3),
        "hanning": tapers.hanning_window(*at), "hamming": tapers.hamming_window(*at), "blackman": tapers.blackman_window(*at),
    }, keys=("id",), digits=6)


_A, _B, _C = "blue", "(blue + green + red)", "green"


@register("subpixel_peaks", rounded_sql(PIXELS, {
    "parabolic": f"({_C} - {_A}) / (2 * (2 * {_B} - {_A} - {_C}))", "gaussian": f"(ln({_C}) - ln({_A})) / (2 * (2 * ln({_B}) - ln({_A}) - ln({_C})))",
    "mass": f"({_C} - {_A}) / ({_A} + {_B} + {_C})", "equiangular": f"({_C} - {_A}) / (2 * ({_B} - least({_A}, {_C})))",
    "triangular": f"CASE WHEN {_C} > {_A} THEN 1 ELSE -1 END * (1 - abs({_C} - {_A})) / ({_B} - least({_A}, {_C}))",
    "ratio": f"CASE WHEN {_C} = {_A} THEN 0 ELSE ({_C} - {_A}) / (abs({_C} - {_A}) + {_B}) END", "half_step": f"5e-1 * greatest(abs({_B} - {_A}), abs({_B} - {_C}))",
}, digits=8))
def subpixel_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks between two bands and their sum with a third."""
    scores = (F.col("blue"), F.col("blue") + F.col("green") + F.col("red"), F.col("green"))
    forms = ("parabolic", "gaussian", "mass", "equiangular", "triangular", "ratio", "half_step")
    return rounded(pixels(spark, sf_dir), {name: getattr(peaks, name)(*scores) for name in forms}, digits=8)


def _cell(a: int, b: int) -> str:
    """SQL: the cell of an embedding of eight by eight, from the fourth row and column."""
    return f"CAST(embedding[{(3 + a) * 8 + 3 + b + 1}] AS DOUBLE)"


def _crossing(axis: int) -> str:
    c = {k: _cell(*((k, 0) if axis == 0 else (0, k))) for k in range(-3, 4)}
    here, after, before = (f"({c[k - 2]} + {c[k - 1]} - {c[k + 1]} - {c[k + 2]})" for k in (0, 1, -1))
    return f"CASE WHEN {c[1]} > {c[-1]} THEN {here} / ({here} - {after}) ELSE {before} / ({before} - {here}) - 1 END"


_TWIST = f"(SELECT arg_max(w, v) FROM (VALUES {', '.join(f'({_cell(a, b)}, {a * b} * ({_cell(a, b)} + {_cell(0, 0)} - {_cell(a, 0)} - {_cell(0, b)}))' for a in (-1, 1) for b in (-1, 1))}) c(v, w))"


@register("peaks_of_grids", f"""WITH s AS (SELECT vec_id, ({_cell(1, 0)} - {_cell(-1, 0)}) / 2 AS di, ({_cell(0, 1)} - {_cell(0, -1)}) / 2 AS dj, {_cell(1, 0)} + {_cell(-1, 0)} - 2 * {_cell(0, 0)} AS pi, {_cell(0, 1)} + {_cell(0, -1)} - 2 * {_cell(0, 0)} AS pj,
 {_crossing(0)} AS crossing_i, {_crossing(1)} AS crossing_j, {_TWIST} AS t FROM embeddings WHERE len(embedding) = 64)
 SELECT vec_id, round(crossing_i, 4) + 0e0 AS crossing_i, round(crossing_j, 4) + 0e0 AS crossing_j, round((t * dj - pj * di) / (pi * pj - t * t), 4) + 0e0 AS bowl_i, round((t * di - pi * dj) / (pi * pj - t * t), 4) + 0e0 AS bowl_j FROM s""")
def peaks_of_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a peak in embeddings taken as scores of eight by eight."""
    e = read(spark, sf_dir, "embeddings").filter("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def cell(a: int, b: int):
        return F.get("e", F.lit((3 + a) * 8 + 3 + b))

    square = [[cell(a, b) for b in (-1, 0, 1)] for a in (-1, 0, 1)]
    bowl = peaks.paraboloid(square)
    crossing = peaks.gradient_crossing([cell(k, 0) for k in range(-3, 4)]), peaks.gradient_crossing([cell(0, k) for k in range(-3, 4)])
    return e.select("vec_id", *((F.round(c, 4) + 0.0).alias(f"{name}_{axis}") for name, pair in (("crossing", crossing), ("bowl", bowl)) for axis, c in zip("ij", pair, strict=True)))


_RATIOS = f"(SELECT i, j, zone, ln(blue / sqrt(red)) AS x, ln(green / sqrt(red)) AS y FROM {PIXELS})"
_ENTROPIES = f"""WITH r AS MATERIALIZED {_RATIOS}, m AS (SELECT zone, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM r GROUP BY zone),
 d AS (SELECT k * 180e0 / 70 AS direction, cos(pi() * k / 70) AS c, sin(pi() * k / 70) AS s FROM range(70) t(k)),
 w AS (SELECT zone, direction, n, c, s, 35e-1 * sqrt(greatest(xx * c * c + 2 * xy * c * s + yy * s * s, 0)) * pow(n, -1 / 3e0) AS width FROM m, d),
 b AS (SELECT zone, direction, n, CASE WHEN width > 1e-12 THEN CAST(floor((x * c + y * s) / width) AS BIGINT) ELSE 0 END AS bin, count(*) AS m FROM r JOIN w USING (zone) GROUP BY ALL),
 e AS MATERIALIZED (SELECT zone, direction, n, sum(-m / n * log2(m / n)) AS entropy FROM b GROUP BY ALL)"""


@register("direction_entropies", _ENTROPIES + " SELECT zone, round(direction, 4) AS direction, n, round(entropy, 3) AS entropy FROM e")
def direction_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropies of log ratios seen along seventy directions, none of them where bands of equal values meet at the edge of a bin."""
    x, y = entropy.log_ratios(F.col("blue"), F.col("green"), F.col("red"))
    rows = pixels(spark, sf_dir).select("zone", x.alias("x"), y.alias("y"))
    out = entropy.direction_entropies(rows, ["zone"], "x", "y", 70)
    return out.withColumns({"direction": F.round("direction", 4), "entropy": F.round("entropy", 3)})


@register("shade_free", _ENTROPIES + """, a AS (SELECT zone, radians(arg_min(direction, struct_pack(e := entropy, d := direction))) AS a FROM e GROUP BY zone)
 SELECT i, j, round(cos(a) * x + sin(a) * y, 6) AS shadow, round(sin(a) * x - cos(a) * y, 6) AS reflectance FROM r JOIN a USING (zone)""")
def shade_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log ratios turned to the direction of least entropy of their zone."""
    x, y = entropy.log_ratios(F.col("blue"), F.col("green"), F.col("red"))
    rows = pixels(spark, sf_dir).select("i", "j", "zone", x.alias("x"), y.alias("y"))
    return entropy.shade_free(rows, ["zone"], "x", "y", 70).select("i", "j", F.round("shadow", 6).alias("shadow"), F.round("reflectance", 6).alias("reflectance"))
