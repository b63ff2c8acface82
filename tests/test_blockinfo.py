"""Laying blocks on the grid, against a plain grid that is filled cell by cell."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blockinfo as I, tiles
from tessera.operators.varblocks import CELLS


def plain(blocks, height, width):
    taken, out, at = set(), [], 0
    for y in range(height):
        for x in range(width):
            if (y, x) in taken:
                continue
            if at == len(blocks):
                return [*out, (None, None, None, None, None, "short")]
            idx, k, m = blocks[at]
            at += 1
            fail = lambda e, i=idx, k=k: [*out, (i, k, None, None, None, e)]
            if k is None or k > 26 or k < 0:
                return fail("kind")
            if m is None or m + 1 <= 0:
                return fail("multiplier")
            h, w = CELLS[k]
            if x % 32 + w > 32 or y % 32 + h > 32:
                return fail("border")
            for cy in range(y, y + h):
                for cx in range(x, x + w):
                    if cy >= height or cx >= width:
                        return fail("outside")
                    if (cy, cx) in taken:
                        return fail("overlap")
                    taken.add((cy, cx))
            out.append((idx, k, m + 1, y, x, None))
    return out


def lists(seed):
    r = random.Random(seed)
    mixes = [[0], [0, 6], [4], [0, 1, 2, 3, 12], [0, 4, 6, 7], [5, 0], [8, 6, 0], [24], list(range(27)), [18, 5, 4, 0]]
    for k in range(60):
        height, width = r.choice([(1, 1), (4, 4), (8, 12), (33, 5), (32, 32), (64, 40), (0, 5), (5, 0)])
        kinds = mixes[k % len(mixes)]
        own = [(i, r.choice(kinds), r.randrange(0, 5)) for i in range(r.choice([0, 3, height * width, 2 * height * width]))]
        if own and k % 9 == 5:
            own[len(own) // 2] = (len(own) // 2, r.choice([None, 27, -1]), 1)
        if own and k % 9 == 7:
            own[len(own) // 2] = (len(own) // 2, 0, r.choice([None, -1]))
        yield height, width, own


def test_places(spark):
    groups, rows, expected = [], [], []
    for k, (height, width, own) in enumerate(lists(4)):
        key = (f"image{k % 7}", k)
        groups.append((*key, height, width, "extra"))
        rows += [(*key, *b, "extra") for b in own]
        expected += [(*key, *x) for x in plain(own, height, width)]
    random.Random(0).shuffle(rows)
    blocks = spark.createDataFrame([*rows, ("image0", 999, 0, 0, 0, "extra")], "image string, group long, idx int, kind int, mul int, by string").repartition(3)
    table = spark.createDataFrame(groups, "image string, group long, bh int, bw int, error string")
    placed = I.place(blocks, table, ("image", "group"))
    assert sorted(map(tuple, placed.collect()), key=repr) == sorted(expected, key=repr)
    assert {x[-1] for x in expected} >= {None, *I.ERRORS}
    found = I.cells(placed, ("image", "group"))
    assert I.overlapping(found, ("image", "group")).count() == 0
    taken = {(r.image, r.group): r.n for r in found.groupBy("image", "group").agg(F.count(F.lit(1)).alias("n")).collect()}
    for image, group, height, width, _ in groups:
        if not any(x[:2] == (image, group) and x[-1] for x in expected):
            assert taken.get((image, group), 0) == height * width  # each cell once
    assert I.place(blocks.where("false"), table.where("false"), ("image", "group")).count() == 0


def test_sigma_reaches_the_filter(spark):
    """Blocks to sigma to samples to the edge-preserving filter: where sharpness picks 0, samples stay."""
    rng = np.random.default_rng(0)
    blocks = spark.createDataFrame([("a", 0, 4, 0), ("a", 1, 0, 1), ("a", 2, 0, 3)], "image string, idx int, kind int, mul int")
    groups = spark.createDataFrame([("a", 2, 3)], "image string, bh int, bw int")
    found = I.cells(I.place(blocks, groups, ("image",)), ("image",))
    sharp = spark.createDataFrame([("a", y, x, 0 if (y, x) == (0, 0) else 4) for y in range(2) for x in range(3)], "image string, cy int, cx int, sharpness int")
    lut = (0.0, 1 / 7, 2 / 7, 3 / 7, 4 / 7, 5 / 7, 6 / 7, 1.0)
    sigma = I.sigmas(found, sharp, ("image",), 0.46, 2000, lut)
    got = {(r.cy, r.cx): r.sigma for r in sigma.collect()}
    assert got[0, 0] == 0 and got[0, 1] == pytest.approx(0.46 * 65536 / 2000 * 4 / 7) and got[1, 2] == pytest.approx(0.46 * 65536 / 2000 / 4 * 4 / 7)
    values = 0.5 + 0.01 * rng.random((3, 16, 24))
    grid = spark.createDataFrame([("a", y, x, *map(float, values[:, y, x])) for y in range(16) for x in range(24)], "image string, y long, x long, a double, b double, c double")
    filtered = tiles.epf(I.to_samples(grid, sigma, ("image",)), "sigma", ("a", "b", "c"), 1, ("image",))
    still = {(r.y, r.x) for r in filtered.collect() if np.allclose((r.a, r.b, r.c), values[:, r.y, r.x])}
    assert still == {(y, x) for y in range(8) for x in range(8)}


def test_groups_on_the_image(spark):
    c = spark.createDataFrame([(5, 3, 1, 2)], "group int, columns int, cy int, cx int")
    assert tuple(I.on_image(c).select("cy", "cx").first()) == (1 + 256, 2 + 2 * 256)
