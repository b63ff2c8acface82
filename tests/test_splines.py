"""Splines against a walk along the curve and loops over the dots."""

import math
import random

import numpy as np
import pytest

from tessera.operators import splines as P


def plain_curve(points):
    points = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
    if len(points) == 1:
        return points
    p = np.array([[2 * a - b for a, b in zip(points[0], points[1])], *points, [2 * a - b for a, b in zip(points[-1], points[-2])]], float)
    out = []
    for i in range(len(points) - 1):
        q, t = p[i : i + 4], [0.0]
        for k in range(3):
            t.append(t[-1] + float(((q[k + 1] - q[k]) ** 2).sum()) ** 0.25)
        out.append(q[1])
        for step in range(1, 16):
            at = t[1] + step / 16 * (t[2] - t[1])
            level, width = list(q), 1
            while len(level) > 1:  # the pyramid of lines; its last one is between the middle knots
                low = 1 if len(level) == 2 else 0
                span = 1 if len(level) == 2 else width
                level = [level[k] + (level[k + 1] - level[k]) * ((at - t[low + k]) / (t[low + k + span] - t[low + k])) for k in range(len(level) - 1)]
                width += 1
            out.append(level[0])
    return [tuple(map(float, x)) for x in [*out, p[-2]]]


def plain_dots(line):
    """A walk: steps of length 1 along the line, then what is left."""
    out, here, at = [(line[0], 1.0)], line[0], 0
    while at < len(line):
        gone, before = 0.0, here
        while True:
            if at >= len(line):
                out.append((before, gone))
                break
            step = math.dist(line[at], before)
            if gone + step >= 1.0:
                here = tuple(b + (n - b) * ((1.0 - gone) / step) for b, n in zip(before, line[at]))
                out.append((here, 1.0))
                break
            gone, before, at = gone + step, line[at], at + 1
    return out


def plain_drawn(height, width, splines):
    out = np.zeros((3, height, width))
    wave = lambda c, t: c[0] + sum(math.sqrt(2) * c[k] * math.cos(k * math.pi / 32 * (t + 0.5)) for k in range(1, 32))

    def erf(x):
        a = abs(x)
        v = 1 - 1 / ((((a * 0.0777394369 + 0.000205260015) * a + 0.232120216) * a + 0.277820801) * a + 1) ** 4
        return -v if x < 0 else v

    for points, coefficients in splines:
        dots = plain_dots(plain_curve(points))
        arc = len(dots) - 2 + dots[-1][1]
        for i, ((cy, cx), length) in enumerate(dots):
            t = 31 * (min(1.0, i / arc) if arc > 0 else 1.0)
            values, sigma = [wave(c, t) * length for c in coefficients[:3]], wave(coefficients[3], t)
            reach = math.sqrt(2 * (3 * math.log(10) + max(0.01, *values))) * abs(sigma)
            for y in range(max(0, math.floor(cy - reach + 0.5)), min(height, math.floor(cy + reach + 1.5))):
                for x in range(max(0, math.floor(cx - reach + 0.5)), min(width, math.floor(cx + reach + 1.5))):
                    d = 0.5 * math.hypot(x - cx, y - cy)
                    f = erf((d + math.sqrt(0.125)) / sigma) - erf((d - math.sqrt(0.125)) / sigma)
                    out[:, y, x] += [0.25 * v * sigma * f * f for v in values]
    return out


def drawings(seed):
    r = random.Random(seed)
    for image in range(4):
        splines = []
        for _ in range(r.randint(1, 3)):
            points = [(float(r.randint(-6, 26)), float(r.randint(-6, 26))) for _ in range(r.choice([1, 2, 3, 6]))]
            points += points[-1:] if r.random() < 0.4 else []  # a repeated one
            wide = [[r.uniform(-0.6, 0.8) / (k + 1) for k in range(32)] for _ in range(3)]
            splines.append((points, [*wide, [r.choice([-1.1, 0.7, 1.5])] + [r.uniform(-0.1, 0.1) / (k + 1) for k in range(31)]]))
        yield image, r.randint(5, 24), r.randint(5, 24), splines


def test_lines_and_dots(spark):
    own = [(k, points) for _, _, _, splines in drawings(1) for k, (points, _) in enumerate(splines)]
    rows = [(i, k, j, *p) for i, (k, points) in enumerate(own) for j, p in enumerate(points)]
    line = P.upsampled(spark.createDataFrame(rows, "image int, spline int, k int, y double, x double").repartition(3))
    found = {(r.image, r.n): (r.y, r.x) for r in line.collect()}
    marks = {(r.image, r.dot): (r.y, r.x, r.length) for r in P.dots(line).collect()}
    expected = {i: plain_curve(points) for i, (_, points) in enumerate(own)}
    assert found.keys() == {(i, n) for i, c in expected.items() for n in range(len(c))}
    assert all(np.allclose(found[i, n], p) for i, c in expected.items() for n, p in enumerate(c))
    walked = {(i, n): (*p, length) for i, c in expected.items() for n, (p, length) in enumerate(plain_dots(c))}
    assert marks.keys() == walked.keys() and all(np.allclose(marks[k], walked[k]) for k in walked)


def test_drawn(spark):
    sizes, points, splines, grid, expected = [], [], [], [], {}
    for image, height, width, own in drawings(2):
        sizes.append((image, height, width))
        for k, (p, c) in enumerate(own):
            points += [(image, k, j, *q) for j, q in enumerate(p)]
            splines.append((image, k, *c))
        base = np.random.default_rng(image).random((3, height, width))
        grid += [(image, y, x, *map(float, base[:, y, x])) for y in range(height) for x in range(width)]
        made = base + plain_drawn(height, width, own)
        expected |= {(image, y, x): tuple(made[:, y, x]) for y in range(height) for x in range(width)}
    points.append((99, 0, 0, 1.0, 1.0))  # without a spline
    splines.append((0, 99, *[[1.0] * 32] * 4))  # without points
    got = P.drawn(
        spark.createDataFrame(grid, "image int, y long, x long, x_ double, y_ double, b_ double"), spark.createDataFrame(points, "image int, spline int, k int, y double, x double"),
        spark.createDataFrame(splines, "image int, spline int, x_dct array<double>, y_dct array<double>, b_dct array<double>, sigma_dct array<double>"), spark.createDataFrame(sizes, "image int, height int, width int"),
    )
    found = {(r.image, r.y, r.x): (r.x_, r.y_, r.b_) for r in got.collect()}
    assert found.keys() == expected.keys() and all(np.allclose(found[k], expected[k]) for k in expected)


@pytest.mark.parametrize("adjust", [-8, 0, 8])
def test_dequantised(spark, adjust):
    row = spark.createDataFrame([([100] * 32, [10] * 32, [-5] * 32, [3] * 32)], "x_dct array<int>, y_dct array<int>, b_dct array<int>, sigma_dct array<int>")
    r, scale = P.dequantised(row, adjust, (0.5, 0.25)).first(), {-8: 2, 0: 1, 8: 0.5}[adjust]
    y = 10 * 0.075 * scale
    assert np.allclose((r.x_dct[0], r.y_dct[31], r.b_dct[7], r.sigma_dct[0]), (0.42 * scale + 0.5 * y, y, -0.35 * scale + 0.25 * y, 0.9999 * scale))


SPLINES = "image int, spline int, x_dct array<double>, y_dct array<double>, b_dct array<double>, sigma_dct array<double>"


def added(spark, points, splines, sizes, **limits):
    """What footprints() finds, by image, y and x."""
    frames = spark.createDataFrame(points, "image int, spline int, k int, y double, x double"), spark.createDataFrame(splines, SPLINES), spark.createDataFrame(sizes, "image int, height int, width int")
    return {(r.image, r.y, r.x): (r.x_, r.y_, r.b_) for r in P.footprints(*frames, **limits).collect()}


def test_no_row_for_each_sample_of_a_dot(spark):
    """Dots become sums by sample inside a task: nothing is exploded, and nothing that grows is broadcast."""
    frames = [spark.createDataFrame([], s) for s in ("image int, y long, x long, x_ double, y_ double, b_ double", "image int, spline int, k int, y double, x double", SPLINES, "image int, height int, width int")]
    plan = P.drawn(*frames)._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize("limits", [{}, {"most_dots": 7, "most": 50}])
def test_long_spline_in_parts(spark, limits):
    """More points than a packed row holds, many dots on one sample, a second image far wider than what it has on it."""
    r = random.Random(5)
    wide = [[r.uniform(-0.6, 0.8) / (k + 1) for k in range(32)] for _ in range(3)] + [[0.7] + [0.0] * 31]
    walk = [(float(r.randint(-3, 14)), float(r.randint(-3, 14))) for _ in range(2 * P.PACK + 9)]
    apart = [[(5.0, 4.0), (9.0, 6.0)], [(29990.0, 29980.0), (29999.0, 29999.0)]]
    points = [(0, 0, k, *p) for k, p in enumerate(walk)] + [(1, i, k, *p) for i, own in enumerate(apart) for k, p in enumerate(own)]
    found = added(spark, points, [(0, 0, *wide), (1, 0, *wide), (1, 1, *wide)], [(0, 12, 11), (1, 30000, 30000)], **limits)
    made = plain_drawn(12, 11, [(walk, wide)])
    near = plain_drawn(20, 20, [(apart[0], wide)])
    far = plain_drawn(30, 30, [([(y - 29970, x - 29970) for y, x in apart[1]], wide)])
    expected = {(0, y, x): made[:, y, x] for y, x in np.argwhere(made.any(0)).tolist()} | {(1, y, x): near[:, y, x] for y, x in np.argwhere(near.any(0)).tolist()}
    expected |= {(1, y + 29970, x + 29970): far[:, y, x] for y, x in np.argwhere(far.any(0)).tolist()}
    assert found.keys() == expected.keys() and all(np.allclose(found[k], expected[k]) for k in expected)


def test_odd_splines(spark):
    """Points and coefficients that are null or no numbers draw nothing and spoil nothing else; arrays may be of any length."""
    flat, none, nan = [0.5] + [0.0] * 31, None, float("nan")
    dot = plain_drawn(9, 9, [([(4.0, 4.0)], [flat] * 4)])
    points = [(i, 0, 0, 4.0, 4.0) for i in range(6)] + [(0, 0, 1, none, 5.0), (1, 0, 1, nan, 2.0), (6, 0, 0, none, none)]
    splines = [*((i, 0, *[flat] * 4) for i in (0, 1, 6)), (2, 0, flat, none, flat, flat), (3, 0, flat, flat, flat, [nan] * 32), (4, 0, flat, flat, flat, [0.0] * 32), (5, 0, [0.5], flat, [0.5] + [0.0] * 39, flat)]
    found = added(spark, points, splines, [(i, 9, 9) for i in range(7)])
    for image in (0, 1, 5):
        own = {k[1:]: v for k, v in found.items() if k[0] == image}
        assert own.keys() == set(map(tuple, np.argwhere(dot.any(0)).tolist())) and all(np.allclose(v, dot[:, y, x]) for (y, x), v in own.items())
    assert {k[0] for k in found} == {0, 1, 5}
