"""Delta palettes against the plain loop over all samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import recurrence as R, samples as S


def plain(values, delta, predictor):
    v = values.copy()
    height, width = v.shape
    half = lambda s, n=2: int(s / n) if abs(s) < 1 << 50 else 0
    for y in range(height):
        for x in range(width):
            if not delta[y, x]:
                continue
            w = v[y, x - 1] if x else v[y - 1, x] if y else 0
            n = v[y - 1, x] if y else w
            nw = v[y - 1, x - 1] if x and y else w
            ne = v[y - 1, x + 1] if y and x + 1 < width else n
            nn = v[y - 2, x] if y > 1 else n
            ww = v[y, x - 2] if x > 1 else w
            nee = v[y - 1, x + 2] if y and x + 2 < width else ne
            p = {
                "zero": 0, "west": w, "north": n, "avg_wn": half(w + n), "select": w if abs(n - nw) < abs(w - nw) else n, "gradient": min(max(n + w - nw, min(n, w)), max(n, w)),
                "ne": ne, "nw": nw, "ww": ww, "avg_wnw": half(w + nw), "avg_nnw": half(n + nw), "avg_nne": half(n + ne), "avg_all": half(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8, 16),
            }[predictor]
            v[y, x] = (v[y, x] + p + (1 << 31)) % (1 << 32) - (1 << 31)
    return v


@pytest.mark.parametrize("predictor", sorted(R.PREDICTIONS))
@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (7, 2), (23, 17)])
def test_wavefront(predictor, shape):
    rng = np.random.default_rng(7)
    values, delta = rng.integers(-300, 300, shape), rng.random(shape) < 0.6
    for rows in (1, 4, shape[0]):  # strips that carry their last two rows
        out, above = [], np.zeros((2, shape[1]), np.int64)
        for top in range(0, shape[0], rows):
            own = np.concatenate([above, values[top : top + rows]])
            R.filled(own, delta[top : top + rows], top, R.PREDICTIONS[predictor])
            out.append(own[2:])
            above = own[-2:].copy()
        assert (np.concatenate(out) == plain(values, delta, predictor)).all()


def test_sums_wrap():
    own = np.array([[0], [0], [(1 << 31) - 1], [1]], np.int64)
    R.filled(own, np.array([[False], [True]]), 0, R.PREDICTIONS["north"])
    assert own[3, 0] == -(1 << 31)


@pytest.mark.parametrize("cells", [1 << 18, 20])
def test_all_images_and_channels_at_once(spark, cells):
    rng, rows, expected = np.random.default_rng(1), [], {}
    for image, shape in (("a", (13, 7)), ("b", (1, 30)), (None, (5, 5)), ("d", (30, 1))):
        for c in range(3):
            values, delta = rng.integers(-50, 256, shape), rng.random(shape) < 0.5
            rows += [(image, c, y, x, int(values[y, x]), True if delta[y, x] else None if x % 2 else False, "extra") for y in range(shape[0]) for x in range(shape[1])]
            if image is not None:
                expected |= {(image, c, y, x): int(v) for (y, x), v in np.ndenumerate(plain(values, delta, "gradient"))}
    grid = spark.createDataFrame(rows, "image string, c int, y int, x int, v int, delta boolean, cells string").repartition(5)
    found = R.predicted_deltas(grid, "gradient", cells=cells)
    assert {(r.image, r.c, r.y, r.x): r.v for r in found.collect()} == expected
    assert R.predicted_deltas(grid.where("false"), "west").count() == 0


def test_palettes_of_several_images(spark):
    """Each image looks its own palette up; indices below n_deltas are marked, implicit ones among them."""
    grid = spark.createDataFrame([(i, 0, x, v) for i in range(2) for x, v in enumerate((-1, 0, 1, 2, 3, 70))], "image int, y long, x long, v long")
    colours = spark.createDataFrame([(i, k, c, 100 * i + 10 * k + c) for i in range(2) for k in range(3) for c in range(3)], "image int, idx long, c int, v int")
    found = {(r.image, r.x, r.c): (r.v, r.delta) for r in S.palette(grid, colours, 3, keys=("image",), n_deltas=2).collect()}
    alone = {(r.x, r.c): r.v for r in S.palette(grid.where("image = 1").drop("image"), colours.where("image = 1").drop("image"), 3).collect()}
    assert {(x, c): v for (i, x, c), (v, _) in found.items() if i == 1} == alone and len(found) == 36
    assert {x for (_, x, _), (_, d) in found.items() if d} == {0, 1, 2}
    assert found[0, 2, 1] == (11, True) and found[1, 3, 2] == (122, False)


def test_small_images_share_a_wavefront(spark):
    """Images of several heights and two widths, a few at a time: fewer wavefronts than images, and each as if alone."""
    rng, rows = np.random.default_rng(4), []
    for image in range(40):
        height, width = int(rng.integers(1, 7)), 5 if image % 20 < 10 else 8
        rows += [(image, 0, y, x, int(rng.integers(-50, 50)), bool(rng.random() < 0.6)) for y in range(height) for x in range(width)]
    grid = spark.createDataFrame(rows, "image long, c int, y long, x long, v long, delta boolean")
    alone = R.predicted_deltas(grid, "avg_all", cells=1).collect()
    assert sorted(map(tuple, R.predicted_deltas(grid, "avg_all").collect())) == sorted(map(tuple, alone)) and len(alone) == len(rows)
    values, open_ = rng.integers(-50, 50, (6, 5, 4)), rng.random((6, 3, 4)) < 0.6
    apart = values.copy()
    for k in range(6):
        R.filled(apart[k], open_[k], 0, R.PREDICTIONS["avg_all"])
    R.filled(values, open_, 0, R.PREDICTIONS["avg_all"])
    assert (values == apart).all()
