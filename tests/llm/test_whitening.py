"""Whitening against numpy's own eigenvectors and exact sums in plain Python."""

import math

import numpy as np
import pytest

from loomgraph.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "x", 0) for i, v in rows], SCHEMA)


def usable(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def expected(rows):
    """Rows by brute force: (vec_id, component) to n, deviation, whitened up to sign, explained."""
    size = max(len(v) for _, v in rows if usable(v))
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (size - len(v))) for i, v in rows if usable(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], dtype=float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        spread = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(min(4, int((values > 1e-9 * values[0]).sum()))):
            out.append((i, k + 1, n, sum(v * v for v in spread), float(np.dot(np.array(spread, dtype=float) / n, vectors[:, k])) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def vectors(seed, rows, size):
    random = np.random.default_rng(seed)
    spread = random.normal(size=(size, size)) * np.exp(-np.arange(size) / 3)[:, None]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(random.normal(size=(rows, size)) @ spread)]


def check(spark, rows, tolerance=1e-9):
    got = list(whitening.whiten(frame(spark, rows).repartition(3)).toLocalIterator())
    want = expected(rows)
    assert len(got) == len(want)
    by = {}
    for i, k, *rest in want:
        by.setdefault((i, k), []).append(rest)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = min(by[r.vec_id, r.component], key=lambda w: abs(w[1] - r.deviation))
        assert (r.n, r.deviation) == (n, deviation)
        if abs(whitened) > 1e-3:
            assert sign.setdefault(r.component, r.whitened * whitened > 0) == (r.whitened * whitened > 0)
        assert abs(abs(r.whitened) - abs(whitened)) < tolerance * max(1, abs(whitened)) and abs(r.explained - explained) < 1e-10
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_matches_numpy_also_with_copies_and_odd_rows(spark):
    rows = vectors(1, 300, 16)
    odd = [(1000, rows[0][1]), (1001, rows[0][1]), (None, rows[1][1]), (5, rows[2][1]), (1002, None), (1003, [1.0, None] + [0.0] * 14), (1004, [float("nan")] * 16),
           (1005, [float("inf")] + [0.0] * 15), (1006, [0.5, -0.0]), (1007, [])]
    check(spark, rows + odd + [(2000 + i, rows[7][1]) for i in range(200)])


def test_fewer_directions_than_components(spark):
    line = [(i, [0.1 * i, 0.2 * i, -0.3 * i]) for i in range(20)]
    flat = [(i, [float(i), 0.0, 0.0]) for i in range(20)]
    assert {r.component for r in whitening.whiten(frame(spark, flat)).toLocalIterator()} == {1}
    check(spark, flat)
    assert max(r.component for r in whitening.whiten(frame(spark, line)).toLocalIterator()) <= 3
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits_are_null_and_others_exact(spark):
    rows = [(i, [float(i) * 1e6, 1.0]) for i in range(50)] + [(60, [3e15, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).toLocalIterator()}
    want = {i: d if d < 2**63 else None for i, k, _, d, *_ in expected(rows)}
    assert got == want and None in want.values()


@pytest.mark.parametrize("size", [1, 2, 5, 33])
def test_factor_and_rotations_give_eigenvalues(size):
    random = np.random.default_rng(size)
    factor = random.normal(size=(size, size)) * 10.0 ** -random.integers(0, 5, size)
    matrix = factor @ factor.T
    lower = whitening.pivoted_cholesky(matrix)
    assert np.allclose(lower @ lower.T, matrix, atol=1e-12 * np.max(matrix))
    turned = whitening.orthogonal_columns(lower)
    values = (turned * turned).sum(0)
    wanted = np.linalg.svd(factor, compute_uv=False) ** 2
    assert np.allclose(values, wanted[: len(values)], rtol=1e-9, atol=1e-13 * wanted[0])
    unit = turned / np.sqrt(values)
    assert np.allclose(unit.T @ unit, np.eye(len(values)), atol=1e-10)


def test_all_rows_of_the_table_agree_for_any_partitioning(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = ({(r.vec_id, r.component): r for r in whitening.whiten(table.repartition(p)).toLocalIterator()} for p in (1, 7))
    assert one.keys() == many.keys() and len(one) == 4 * table.count()
    assert all(abs(one[k].whitened - many[k].whitened) < 1e-9 and one[k].explained == many[k].explained for k in one)
