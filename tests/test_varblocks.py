"""Transforms of blocks against plain loops over their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import varblocks as V


def plain_inverse(c):
    h, w = c.shape
    basis = lambda n, k, i: 1.0 if k == 0 else math.sqrt(2) * math.cos(math.pi * k * (2 * i + 1) / (2 * n))
    return np.array([[sum(c[k, m] * basis(h, k, y) * basis(w, m, x) for k in range(h) for m in range(w) if c[k, m]) for x in range(w)] for y in range(h)])


def plain_special(kind, c):
    """From the definitions, coefficient by coefficient; c[row, column]."""
    c, out = c.copy(), np.zeros((8, 8))
    if kind in (V.DCT4, V.HORNUSS):
        a, b, d, e = c[0, 0], c[0, 1], c[1, 0], c[1, 1]
        c[0, 0], c[0, 1], c[1, 0], c[1, 1] = a + b + d + e, a + b - d - e, a - b + d - e, a - b - d + e
        c[0, 1], c[1, 0] = c[1, 0], c[0, 1]
        for y in (0, 1):
            for x in (0, 1):
                q = np.array([[c[y + 2 * i, x + 2 * j] for j in range(4)] for i in range(4)])
                if kind == V.DCT4:
                    q = plain_inverse(q.T)
                else:
                    mean = q[0, 0] - (q.sum() - q[0, 0]) / 16
                    q[0, 0], q[1, 1] = q[1, 1], 0
                    q = q + mean
                out[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = q
    elif kind in (V.DCT4X8, V.DCT8X4):
        c[0, 0], c[1, 0] = c[0, 0] + c[1, 0], c[0, 0] - c[1, 0]
        for half in (0, 1):
            out[4 * half : 4 * half + 4] = plain_inverse(np.array([c[2 * i + half] for i in range(4)]))
        out = out.T if kind == V.DCT8X4 else out
    else:
        n = V.AFV.index(kind)
        fy, fx = n // 2, n % 2
        corner = [4 * (c[0, 0] + c[0, 1] + c[1, 0])] + [c[2 * (k // 4), 2 * (k % 4)] for k in range(1, 16)]
        corner = np.array([sum(corner[k] * V.afv_basis()[k][p] for k in range(16)) for p in range(16)]).reshape(4, 4)
        near = np.array([[c[2 * j, 2 * i + 1] for j in range(4)] for i in range(4)])
        near[0, 0] = c[0, 0] - c[0, 1] + c[1, 0]
        wide = np.array([[c[2 * i + 1, j] for j in range(8)] for i in range(4)])
        wide[0, 0] = c[0, 0] - c[1, 0]
        near, wide = plain_inverse(near), plain_inverse(wide)
        for i in range(4):
            for j in range(4):
                out[4 * fy + i, 4 * fx + j] = corner[3 - i if fy else i, 3 - j if fx else j]
                out[4 * fy + i, 4 * (1 - fx) + j] = near[i, j]
            out[4 * (1 - fy) + i] = wide[i]
    return out


def test_the_basis_of_the_corner_is_orthonormal():
    b = V.afv_basis()
    assert np.allclose(b @ b.T, np.eye(16), atol=1e-12)
    # a few components of the format's table
    for row, at, v in ((1, 5, -0.10140050393753777), (2, 11, 0.11379074460448091), (3, 15, 0.4251149611657548), (5, 0, -0.4105377591765233), (5, 15, -0.0643507165794626), (7, 3, 0.5112616136591823), (15, 10, 0.5550443808910661)):
        assert abs(b[row, at] - v) < 1e-9


@pytest.mark.parametrize("kind", [V.HORNUSS, V.DCT4, V.DCT4X8, V.DCT8X4, *V.AFV])
def test_special_transforms(kind):
    c = np.random.default_rng(kind).normal(size=(5, 8, 8))
    assert np.allclose(V.SPECIAL[kind](c), [plain_special(kind, x) for x in c])


@pytest.mark.parametrize("h,w", [(1, 1), (1, 2), (2, 1), (2, 2), (8, 4), (3, 5), (16, 8)])
def test_transforms_are_inverses(h, w):
    c = np.random.default_rng(1).normal(size=(h, w))
    assert np.allclose(V.inverse(c), plain_inverse(c)) and np.allclose(V.forward(V.inverse(c)), c)


@pytest.mark.parametrize("kind", [0, 4, 6, 9, 11, 18, 20, 24])
def test_means_of_cells_give_the_low_frequencies(kind):
    """A smooth block's means bring back its lowest coefficients."""
    h, w = V.CELLS[kind]
    low = np.random.default_rng(2).normal(size=(1, h, w))
    whole = np.zeros((1, 8 * h, 8 * w))
    whole[:, :h, :w] = low
    means = V.inverse(whole).reshape(1, h, 8, w, 8).mean((2, 4))
    assert np.allclose(V.low_frequencies(means), low)
    assert np.allclose(V.samples_of(kind, np.zeros_like(whole), means), V.inverse(whole))


def test_all_kinds_in_one_plan(spark):
    rng, rows = np.random.default_rng(3), []
    for kind, (h, w) in enumerate(V.CELLS):
        rows += [(f"image{k}", kind, rng.normal(size=max(1, 64 * h * w - k)).tolist(), rng.normal(size=h * w).tolist()) for k in range(2)]
    rows += [("none", None, [1.0], [1.0]), ("unknown", 27, [1.0], [1.0]), ("null", 0, None, [1.0]), ("empty", 0, [], [2.0]), ("hole", 0, [None, None, 1.0], [0.0])]
    blocks = spark.createDataFrame(rows, "image string, kind int, v array<double>, lf array<double>").repartition(3)
    got = {(r.image, r.kind): r.v for r in V.transformed(blocks, lf="lf").collect()}
    assert len(got) == len(rows)
    for image, kind, v, lf in rows:
        if kind is None or kind > 26 or v is None:
            assert got[image, kind] is None
            continue
        h, w = V.CELLS[kind]
        c = np.zeros(64 * h * w)
        c[: len(v)] = [x or 0.0 for x in v]
        assert np.allclose(got[image, kind], V.samples_of(kind, c.reshape(1, 8 * h, 8 * w), np.array(lf).reshape(1, h, w)).reshape(-1))
    assert V.transformed(blocks.where("false"), lf="lf").count() == 0
    samples = V.placed(V.transformed(blocks.where("kind = 6 AND image = 'image0'"), lf="lf").withColumns({"top": F.lit(16), "left": F.lit(8)}), y0="top", x0="left")
    assert {(r.y, r.x): r.v for r in samples.collect()} == {(16 + k // 8, 8 + k % 8): v for k, v in enumerate(got["image0", 6])}


def test_samples_are_given_back_in_bounded_pieces():
    kinds = np.array([24, -1, 0] * 100)  # 100 blocks of 65,536 samples
    found = V.pieces(kinds)
    assert [a for a, _ in found[1:]] == [b for _, b in found[:-1]] and (found[0][0], found[-1][1]) == (0, 300)
    assert max((kinds[a:b] == 24).sum() for a, b in found) <= 17
