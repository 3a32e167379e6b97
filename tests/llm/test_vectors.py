"""Vector codes and whitening against brute force in exact numbers, on small tables with every odd case."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

DDL = "vec_id long, embedding array<float>, label int, id string, x string, vector string, entry string, w string"
CLASH = ("clash",) * 5


def table(spark, vectors, labels=None, ids=None, slices=3):
    labels, ids = labels or [0] * len(vectors), ids or list(range(len(vectors)))
    return spark.createDataFrame([(k, v, lab, *CLASH) for k, v, lab in zip(ids, vectors, labels, strict=True)], DDL).repartition(slices)


def random_vectors(n, dims, seed, scale=0.2):
    return np.random.default_rng(seed).normal(0, scale, (n, dims)).astype(np.float32).tolist()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """{(id, label): ...} by plain loops over whole numbers."""
    rows = [(k, [int(np.floor(1024 * float(c))) for c in v], lab) for k, v, lab in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(rows[0][1]) // parts
    cut = [[tuple(v[p * dims : (p + 1) * dims]) for p in range(parts)] for _, v, _ in rows]
    book = [[list(cut[r][p]) for r in range(min(entries, len(rows)))] for p in range(parts)]

    def near(part, p):
        d = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for parts_of in cut:
            for p, part in enumerate(parts_of):
                held[p][near(part, p)[0]].append(part)
        for p in range(parts):
            for e, members in held[p].items():
                book[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    found = [[near(part, p) for p, part in enumerate(parts_of)] for parts_of in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(rows, errors, strict=True):
        by_label[lab] += e
    out = sorted(((k, "".join(f"{c:02x}" for c, _ in f), e, by_label[lab]) for (k, _, lab), f, e in zip(rows, found, errors, strict=True)), key=str)
    return out, book


def codes_of(frame, **kw):
    from penumbra.llm.elkan import compress

    coded, books = compress(frame, **kw)
    assert coded.columns == ["vec_id", "code", "error", "label_error"]
    return sorted((tuple(r) for r in coded.collect()), key=str), books


def test_codes_with_every_odd_row(spark):
    vectors = random_vectors(300, 8, 1)
    vectors += [None, [], [0.1] * 7 + [None], [float("nan")] * 8, [float("inf")] + [0.0] * 7, vectors[3], vectors[3], [0.0] * 8, [-0.0] * 8]
    labels = [None if k % 5 == 0 else k % 3 for k in range(len(vectors))]
    ids = list(range(300, 300 + len(vectors)))
    ids[4], ids[10] = None, ids[11]
    got, books = codes_of(table(spark, vectors, labels, ids))
    want, book = plain_codes(list(zip(ids, vectors, labels, strict=True)))
    assert got == want and books.tolist() == book


@pytest.mark.parametrize("seed", range(3))
def test_ties_go_to_the_lower_index(spark, seed):
    """Few different whole numbers, so most parts have several nearest entries."""
    rng = np.random.default_rng(seed)
    vectors = (rng.integers(-2, 3, (120, 4)) / 1024).tolist()
    got, books = codes_of(table(spark, vectors), entries=int(rng.integers(2, 40)))
    want, book = plain_codes([(k, v, 0) for k, v in enumerate(vectors)], entries=books.shape[1])
    assert got == want and books.tolist() == book


def test_few_vectors_none_and_wrong_ones(spark):
    from penumbra.llm.elkan import compress

    got, books = codes_of(table(spark, random_vectors(3, 4, 2)))
    assert [r[2] for r in got] == [0, 0, 0] and books.shape == (4, 3, 1)
    got, books = codes_of(table(spark, [None, []]))
    assert got == [] and books.size == 0
    for wrong in ([[0.0] * 4, [0.0] * 8], [[0.0] * 6], [[1e30] * 4, [0.0] * 4]):
        with pytest.raises(ValueError):
            compress(table(spark, wrong))


def test_bounds_never_decide_a_winner():
    from penumbra.llm.elkan import first_bounds, moved_bounds, squared

    rng = np.random.default_rng(5)
    for scale in (3, 100, 100_000):
        x, book = rng.integers(-scale, scale, (400, 5)), rng.integers(-scale, scale, (60, 5))
        bounds = first_bounds(x, book)
        for _ in range(6):
            old, book = book, book + rng.integers(-max(1, scale // 8), max(2, scale // 8), book.shape)
            bounds = moved_bounds(x, old, book, bounds._replace(upper=bounds.upper.astype(np.float64)))
            d2 = squared(x, book)
            assert (bounds.entry == d2.argmin(1)).all()
            true = np.sqrt(d2.astype(float))
            assert (bounds.upper >= true.min(1)).all()
            assert (bounds.lower * bounds.step[:, None].astype(float) <= true * (1 + 1e-12)).all()


def whitened_rows(frame, **kw):
    from penumbra.llm.whitening import whiten

    return whiten(frame, **kw).collect()


@pytest.mark.parametrize(("n", "dims", "seed"), [(400, 40, 1), (60, 6, 2), (9, 12, 3)])
def test_whitening_against_a_dense_solver(spark, n, dims, seed):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((n, dims)) * np.geomspace(1, 0.05, dims) @ np.linalg.qr(rng.standard_normal((dims, dims)))[0] * 0.1 + 0.3).astype(np.float32).tolist()
    rows = whitened_rows(table(spark, [*vectors, None, [float("nan")] * dims, []]))
    x = np.floor(1024 * np.array(vectors)) + 100_000
    away = x - x.mean(0)
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(8, dims, n - 1)
    assert len(rows) == n * k and {r["component"] for r in rows} == set(range(1, k + 1))
    exact = [[int(v) for v in r] for r in x]
    sums = [sum(c) for c in zip(*exact, strict=True)]
    got = np.zeros((n, k))
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-9 and r["residual"] <= 1e-10
        assert int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(exact[r["vec_id"]], sums, strict=True))
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = away @ axes[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-7


def test_whitening_of_tables_without_variance(spark):
    for vectors in ([], [[0.5] * 4], [[0.25] * 4] * 5, [None]):
        assert whitened_rows(table(spark, vectors)) == []
    line = whitened_rows(table(spark, [[float(k)] * 4 for k in range(5)]))
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    with pytest.raises(ValueError):
        whitened_rows(table(spark, [[0.0] * 4, [0.0] * 5]))


def test_deviations_beyond_64_bits():
    from penumbra.llm.whitening import Centre, _deviations

    x, n = np.array([[10**9, -(10**9)], [7, 8]]), 10**8
    centre = Centre(n, np.array([3, 4]), np.array([5, n - 1]))
    got = [int(v) for v in _deviations(x, centre).to_pylist()]
    assert got == [sum((n * int(a) - n * q - r) ** 2 for a, q, r in zip(row, (3, 4), (5, n - 1), strict=True)) for row in x]


def test_repeated_steps_give_the_same_eigenvectors():
    from penumbra.llm.whitening import lobpcg

    rng = np.random.default_rng(9)
    for dims, close in ((30, 1e-3), (200, 1e-2)):
        values = np.sort(np.concatenate([[1, 1 - close], rng.uniform(0, 0.9, dims - 2)]))[::-1]
        basis = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        matrix = basis * values @ basis.T
        vectors, found, residual = lobpcg(lambda b, m=matrix: m @ b, dims, 8)
        assert residual <= 1e-10 and np.abs(found - values[:8]).max() < 1e-12
        assert np.abs(np.abs((vectors * basis[:, :8]).sum(0)) - 1).max() < 1e-9


def test_digest_of_codebooks_is_over_decimal_numbers():
    book = np.array([[[1, -2]], [[3, 4]]])
    assert hashlib.sha256(b"1,-2,3,4").hexdigest() == hashlib.sha256(",".join(str(x) for x in book.ravel()).encode()).hexdigest()
