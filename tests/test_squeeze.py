"""Squeeze schedules against the rules step by step, and all images there and back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import squeeze as Q


def plain_default(sizes):
    """sizes: (height, width) of the channels -> steps (begin, n, in_place, horizontal)."""
    h, w = sizes[0]
    steps = [(1, 2, False, True), (1, 2, False, False)] if len(sizes) >= 3 and sizes[1] == (h, w) else []
    n = len(sizes)
    if h >= w and h > 8:
        steps.append((0, n, True, False))
        h = (h + 1) // 2
    while w > 8 or h > 8:
        if w > 8:
            steps.append((0, n, True, True))
            w = (w + 1) // 2
        if h > 8:
            steps.append((0, n, True, False))
            h = (h + 1) // 2
    return steps


SIZES = [[(1, 1)], [(8, 8)], [(9, 8)], [(8, 9)], [(17, 33)] * 3, [(64, 64)] * 3, [(65, 64)] * 2, [(100, 7), (50, 7), (50, 7)], [(7, 129)] * 4, [(33, 33), (33, 33), (16, 16)]]


def test_default_steps(spark):
    rows = [(f"image{k}", i, h, w) for k, sizes in enumerate(SIZES) for i, (h, w) in enumerate(sizes)]
    found = Q.default_steps(spark.createDataFrame(rows, "image string, position int, height int, width int"))
    got = {}
    for r in found.orderBy("image", "step").collect():
        got.setdefault(r.image, []).append((r.begin, r.n, r.in_place, r.horizontal))
    assert {f"image{k}": got.get(f"image{k}", []) for k in range(len(SIZES))} == {f"image{k}": plain_default(s) for k, s in enumerate(SIZES)}


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9])
def test_lines_there_and_back(n):
    v = np.random.default_rng(n).integers(-300, 300, (n, 5))
    average, residual = Q.paired(v)
    assert average.shape == ((n + 1) // 2, 5) and residual.shape == (n // 2, 5)
    assert (Q.unpaired(average, residual) == v).all()
    if n > 1:
        gap = int(v[0, 0] - v[1, 0])
        assert average[0, 0] == v[0, 0] - int(gap / 2)


def test_layout_and_errors(spark):
    channels = [("a", 0, 4, 6, 0, 0), ("a", 1, 4, 6, 1, -1), ("b", 0, 3, 3, 0, 0), ("c", 0, 0, 3, 0, 0), ("d", 0, 1, 1, 31, 0), ("e", 0, 2, 2, 0, 0)]
    steps = [("a", 0, 0, 1, True, True), ("a", 1, 2, 1, False, False), ("b", 0, 0, 2, True, True), ("c", 0, 0, 1, True, True), ("d", 0, 0, 1, True, True)]
    links, places, errors = Q.layout(spark.createDataFrame(channels, "image string, position int, height int, width int, hshift int, vshift int"), spark.createDataFrame(steps, "image string, step int, begin int, n int, in_place boolean, horizontal boolean"))
    assert {tuple(r) for r in links.collect()} == {("a", 0, 0, 2, True), ("a", 1, 1, 3, False)}
    # after step 0: channel 0, its residual (id 2), channel 1; step 1 halves what is third then, and appends
    assert sorted(map(tuple, places.where("image = 'a'").collect())) == [("a", 0, 0, 4, 3, 1, 0), ("a", 1, 2, 4, 3, 1, 0), ("a", 2, 1, 2, 6, 1, -1), ("a", 3, 3, 2, 6, 1, -1)]
    assert [tuple(r) for r in places.where("image = 'e'").collect()] == [("e", 0, 0, 2, 2, 0, 0)]
    assert {tuple(r) for r in errors.collect()} == {("b", 0, "range"), ("c", 0, "empty"), ("d", 0, "deep")}


def test_all_images_there_and_back(spark):
    """Images with default schedules, one with residuals that are squeezed again, one without steps."""
    r, channels, rows = random.Random(1), [], []
    for k, sizes in enumerate([*SIZES[:5], [(20, 30)], [(150, 3)]]):
        for i, (h, w) in enumerate(sizes):
            channels.append((k, i, h, w, 0, 0))
            rows += [(k, i, y, x, r.randrange(-100, 300)) for y in range(h) for x in range(w)]
    table = spark.createDataFrame(channels, "image long, position int, height int, width int, hshift int, vshift int")
    own = spark.createDataFrame([(5, 0, 0, 1, True, True), (5, 1, 1, 1, True, False), (5, 2, 0, 3, False, True)], "image long, step int, begin int, n int, in_place boolean, horizontal boolean")
    steps = Q.default_steps(table.where("image <> 5")).select("image", "step", "begin", "n", "in_place", "horizontal").unionByName(own)
    links, places, errors = Q.layout(table, steps)
    assert errors.count() == 0
    samples = spark.createDataFrame(rows, "image long, id int, y int, x int, v int").repartition(3)
    small = Q.squeezed(samples, links)
    sizes = {(p.image, p.id): p.height * p.width for p in places.collect() if p.height * p.width}
    assert {(x.image, x.id): x.n for x in small.groupBy("image", "id").agg(F.count(F.lit(1)).alias("n")).collect()} == sizes
    back = Q.unsqueezed(small, links)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_whole_images_as_by_rounds(spark, monkeypatch):
    """Many images of few shapes in one shuffle, in small portions, are what rounds make of them; one is too large and goes by rounds."""
    r = random.Random(2)
    sizes = {k: [(12, 10), (5, 7)] if k % 3 else [(9, 11), (1, 1)] for k in range(12)} | {12: [(40, 30), (5, 7)]}
    rows = [(k, i, y, x, r.randrange(-100, 300)) for k, own in sizes.items() for i, (h, w) in enumerate(own) for y in range(h) for x in range(w)]
    samples = spark.createDataFrame(rows, "image long, id int, y int, x int, v int").repartition(3)
    links = spark.createDataFrame([(k, *link) for k in sizes for link in ((0, 0, 2, True), (1, 1, 3, False), (1, 2, 4, False)) if k % 4 != 1], "image long, step int, id int, residual int, horizontal boolean")
    expected = sorted(map(tuple, Q._squeezed_by_rounds(samples, links).collect()))
    monkeypatch.setattr(Q, "WHOLE", 600)
    monkeypatch.setattr(Q, "HELD", 300)
    small = Q.squeezed(samples, links)
    assert sorted(map(tuple, small.collect())) == expected
    assert sorted(map(tuple, Q.unsqueezed(small, links).collect())) == sorted(rows)
    monkeypatch.setattr(Q, "_round", None)  # images that are not too large take no rounds
    assert Q.squeezed(samples.where("image < 12"), links).count() == sum(x[0] < 12 for x in rows)
