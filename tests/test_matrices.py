"""Dequantisation matrices against loops over their definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import matrices as M
from tessera.operators.varblocks import CELLS


def mult(x):
    return 1 + x if x > 0 else 1 / (1 - x)


def between(pos, top, bands):
    if len(bands) == 1:
        return bands[0]
    scaled = pos * (len(bands) - 1) / top
    k = int(scaled)
    return bands[k] * (bands[k + 1] / bands[k]) ** (scaled - k)


def cumulated(values):
    out = [values[0]]
    for v in values[1:]:
        out.append(out[-1] * mult(v))
    return out


def grid(values, height, width):
    return np.array([[between(math.hypot(x / (width - 1), y / (height - 1)), math.sqrt(2) + 1e-6, cumulated(values)) for x in range(width)] for y in range(height)])


def plain(s, lists, params):
    """One channel's weights; lists: grid -> bands."""
    height, width = M.SHAPES[s]
    out = np.zeros((height, width))
    if s == M.HORNUSS:
        out[:] = params[0]
        out[0, 0], out[0, 1], out[1, 0], out[1, 1] = 1, params[1], params[1], params[2]
    elif s == M.DCT2:
        out[0, 0] = 1
        for k, v in enumerate(params):
            d = 1 << k // 2
            if k % 2:
                out[d : 2 * d, d : 2 * d] = v
            else:
                out[:d, d : 2 * d] = out[d : 2 * d, :d] = v
    elif s == M.DCT4:
        out = np.kron(grid(lists[0], 4, 4), np.ones((2, 2)))
        out[0, 1] /= params[0]
        out[1, 0] /= params[0]
        out[1, 1] /= params[1]
    elif s == M.DCT4X8:
        out = np.repeat(grid(lists[0], 4, 8), 2, 0)
        out[1, 0] /= params[0]
    elif s == M.AFV:
        low, high = M.AFV_FREQUENCIES[2], M.AFV_FREQUENCIES[15]
        wide, small = grid(lists[0], 4, 8), grid(lists[1], 4, 4)
        for y in range(4):
            for x in range(4):
                out[2 * y, 2 * x] = {(0, 0): 1, (1, 0): params[2], (0, 1): params[3], (1, 1): params[4]}.get((y, x)) or between(M.AFV_FREQUENCIES[4 * y + x] - low, high - low + 1e-6, cumulated(lists[2]))
                out[2 * y, 2 * x + 1] = params[1] if x == y == 0 else small[y, x]
            for x in range(8):
                out[2 * y + 1, x] = params[0] if x == y == 0 else wide[y, x]
    else:
        out = grid(lists[0], height, width)
    return 1 / out


@pytest.fixture(scope="module")
def default(spark):
    table = {}
    for r in M.matrices(*M.default_tables(spark)).collect():
        table.setdefault((r.set, r.channel), np.zeros(M.SHAPES[r.set]))[r.y, r.x] = r.weight
    return table


@pytest.mark.parametrize("s", range(17))
def test_default_matrices(default, s):
    lists = M.default_lists()
    for c in range(3):
        own = {g: v[c] for (k, g), v in lists.items() if k == s}
        assert np.allclose(default[s, c], plain(s, own, M.PARAMS[s][c] if s in M.PARAMS else None), rtol=1e-12)


def test_matrices_of_several_images(spark):
    """Each image has its own bands; a single band is a constant; bands that are not positive are found."""
    bands = [("a", 0, 0, 0, 0, 50.0), ("b", 0, 0, 0, 0, 10.0), ("b", 0, 0, 0, 1, 1.0), ("c", 0, 1, 0, 0, -1.0), ("a", 3, 2, 0, 0, 8.0)]
    params = [("a", 3, 2, [2.0, 4.0]), ("a", 1, 0, [5.0, 6.0, 7.0])]
    made = M.matrices(spark.createDataFrame(bands, "image string, set int, channel int, grid int, band int, v double"), spark.createDataFrame(params, "image string, set int, channel int, values array<double>"), ("image",))
    got = {}
    for r in made.collect():
        got.setdefault((r.image, r.set, r.channel), np.zeros((8, 8)))[r.y, r.x] = r.weight
    assert np.allclose(got["a", 0, 0], 1 / 50) and np.allclose(got["b", 0, 0], plain(0, {0: (10.0, 1.0)}, None))
    assert np.allclose(got["a", 3, 2], plain(3, {0: (8.0,)}, (2.0, 4.0))) and np.allclose(got["a", 1, 0], plain(1, {}, (5.0, 6.0, 7.0)))
    assert {tuple(r) for r in M.wrong(made, ("image",)).collect()} == {("c", 0, 1)}


def test_dequantised(spark, default):
    rng = np.random.default_rng(0)
    rows = [(k, c, rng.integers(-9, 9, 64 * h * w).astype(float).tolist()) for k, (h, w) in enumerate(CELLS) if h * w <= 16 for c in range(3)]
    blocks = spark.createDataFrame([*rows, (0, 7, [1.0]), (5, 0, None)], "kind int, channel int, v array<double>")
    found = {(r.kind, r.channel): r.v for r in M.dequantised(blocks, M.matrices(*M.default_tables(spark))).collect() if r.v}
    assert found.keys() == {(k, c) for k, c, _ in rows}
    for k, c, v in rows:
        h, w = CELLS[k]
        m = default[M.SET_OF_KIND[k], c]
        assert np.allclose(found[k, c], np.array(v) * (m.T if h > w else m).reshape(-1))
