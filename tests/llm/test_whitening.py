import math

import numpy as np
import pytest

from gradewell.llm._spectrum import Spectrum, secular_roots
from gradewell.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, component int, n string, x int, w int"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "n", 2, 3) for i, v in enumerate(vectors)], schema).repartition(3)


def plain(vectors):
    """Whole numbers, covariance and eigenvalues in plain numpy."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    away = n * x - s
    c = away.astype(float) / n
    return n, away, c, c.T @ c / n


def check(out, kept, vectors, k=32):
    n, away, c, cov = plain(vectors)
    e = np.linalg.eigvalsh(cov)[::-1]
    e = e[e > 1e-9 * e[0]][:k]
    by = {}
    for r in out:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by) == sorted(kept) and len(out) == len(kept) * len(e)
    white = np.array([[by[i][j + 1].whitened for j in range(len(e))] for i in kept])
    for row, i in zip(away, kept, strict=True):
        assert {r.deviation for r in by[i].values()} == {int((row**2).sum())} and by[i][1].n == n
    assert np.allclose([by[kept[0]][j + 1].explained for j in range(len(e))], e / np.trace(cov), rtol=1e-9)
    assert np.abs(white.T @ white / n - np.eye(len(e))).max() < 1e-9 and out[0].identity_error < 1e-9
    # each component is an eigenvector: the covariance with the centred rows, scaled back, is e times the direction
    for j, value in enumerate(e):
        direction = c.T @ white[:, j] / n / np.sqrt(value)
        assert abs(np.linalg.norm(direction) - 1) < 1e-9 and np.linalg.norm(cov @ direction - value * direction) < 1e-8 * e[0]


def test_equals_plain_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 40)) * np.arange(1, 41) / 10).tolist()
    check(whiten(frame(spark, vectors)).collect(), list(range(300)), vectors)


def test_many_partitions_copies_and_ties(spark, monkeypatch):
    from gradewell.llm import whitening

    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(4)
    vectors = rng.integers(-2, 3, (60, 5)).astype(float).tolist() + [[1.0, 2.0, 0.0, 0.0, -1.0]] * 80
    check(whiten(frame(spark, vectors)).collect(), list(range(140)), vectors)


def test_fewer_directions_than_dimensions(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(200, 30)) * 3.0 ** -np.arange(30) * 4000).tolist()
    check(whiten(frame(spark, vectors), components=4, rank=8).collect(), list(range(200)), vectors, k=4)


def test_bad_rows_are_dropped(spark):
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [-7.0, 9.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1e30, 0.0], [1.0, 2.0, 3.0]]
    check(whiten(frame(spark, bad + good)).collect(), [7, 8, 9, 10], good)


def test_nothing_to_whiten(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 9):
        out = whiten(frame(spark, vectors))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 3.0]), (1, [0.0, 3.0]), (1, [5.0, 3.0])]
    out = whiten(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    assert sorted((r.vec_id is None, r.component) for r in out) == [(False, 1)] * 3 + [(False, 2)] * 3 + [(True, 1), (True, 2)]


def test_exact_far_from_the_origin(spark):
    vectors = [[4e6 + i % 7, -4e6 + i % 5] for i in range(50)]
    check(whiten(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect(), list(range(50)), [[float(c) for c in v] for v in vectors])


@pytest.mark.parametrize("size", [1, 2, 9, 40])
def test_roots_lie_between_their_poles(size):
    rng = np.random.default_rng(size)
    d, z2 = np.sort(rng.random(size)), rng.random(size) ** 8 + 1e-12
    diff = secular_roots(d, z2, 0.3)
    t = d - np.diag(diff)
    exact = np.linalg.eigvalsh(np.diag(d) + 0.3 * np.outer(np.sqrt(z2), np.sqrt(z2)))
    assert np.allclose(t, exact, atol=1e-13) and (t > d - 1e-15).all()


def test_merged_spectra_equal_one_spectrum():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(90, 6))
    whole, parts = Spectrum(6, 6), [Spectrum(6, 6) for _ in range(4)]
    for i, r in enumerate(rows):
        whole.add(r, 1 + i % 3)
        parts[i % 4].add(r, 1 + i % 3)
    first = parts[0]
    for p in parts[1:]:
        first.merge(p)
    assert first.weight == whole.weight and np.allclose(first.mean, whole.mean) and np.allclose(first.values, whole.values)
    assert np.allclose(abs((first.vectors * whole.vectors).sum(0)), 1)
