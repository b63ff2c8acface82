"""Frames over canvases and patches over frames, against loops over single samples."""

import random

import numpy as np
import pytest

from tessera.operators import compose as C

FRAME_MODES = ["replace", "add", "blend", "muladd", "mul"]
PATCH_MODES = ["none", "replace", "add", "mul", "blend_above", "blend_below", "muladd_above", "muladd_below"]
BLENDING = "array<struct<mode: string, source: int, alpha: int, clamp: boolean>>"
PATCH_BLENDING = "array<struct<mode: string, alpha: int, clamp: boolean>>"


def clip(v, on):
    return min(max(v, 0.0), 1.0) if on else v


def over(lower, upper, lower_alpha, upper_alpha, premultiplied):
    if premultiplied:
        return upper + lower * (1 - upper_alpha)
    both = 1 - (1 - upper_alpha) * (1 - lower_alpha)
    return (upper_alpha * upper + lower_alpha * lower * (1 - upper_alpha)) / both if both > 0 else 0.0


def plain_sample(mode, b, n, ab, an, clamp, is_alpha, has_alpha, premultiplied):
    kind, below = mode.split("_")[0], mode.endswith("below")
    if kind == "none":
        return b
    if kind == "replace" or kind == "blend" and not has_alpha:
        return n
    if kind == "add" or kind == "muladd" and not has_alpha:
        return b + n
    if kind == "mul":
        return b * clip(n, clamp)
    if kind == "blend" and is_alpha:
        low, high = (n, b) if below else (b, n)
        high = clip(high, clamp)
        return low + high * (1 - low)
    if kind == "muladd" and is_alpha:
        return n if below else b
    low, high, low_a, high_a = (n, b, an, ab) if below else (b, n, ab, an)
    high_a = clip(high_a, clamp)
    return over(low, high, low_a, high_a, premultiplied) if kind == "blend" else low + high_a * high


def plain_compose(image, frames, samples):
    """image: (height, width, colours, associated); -> {(frame_idx, c, y, x): v}."""
    height, width, colours, associated = image
    slots, out = [{}, {}, {}, {}], {}
    for f in sorted(frames, key=lambda f: f["frame_idx"]):
        channels = colours + len(f["blending"]) - 1
        own = {(c, y + f["y0"], x + f["x0"]): v for c, y, x, v in samples.get(f["frame_idx"], []) if 0 <= y < f["height"] and 0 <= x < f["width"] and c < channels}
        whole = f["y0"] <= 0 and f["x0"] <= 0 and f["y0"] + f["height"] >= height and f["x0"] + f["width"] >= width
        result = {}
        for y in range(height):
            for x in range(width):
                inside = f["y0"] <= y < f["y0"] + f["height"] and f["x0"] <= x < f["x0"] + f["width"]
                for c in range(channels):
                    mode, source, alpha, clamp = f["blending"][max(0, c - colours + 1)]
                    n, base = own.get((c, y, x), 0.0), slots[source]
                    if f["kind"] != "normal" or f["blending"][0][0] == "replace" and whole:
                        result[c, y, x] = n
                        continue
                    b = base.get((c, y, x), 0.0)
                    a = colours + alpha
                    has = 0 <= alpha < channels - colours
                    pre = has and alpha < len(associated or []) and associated[alpha] is True
                    result[c, y, x] = plain_sample(mode, b, n, base.get((a, y, x), 0.0), own.get((a, y, x), 0.0), clamp, has and a == c, has, pre) if inside else b
        if not f["is_last"] and (f["duration"] == 0 or f["save_as"]) and f["kind"] != "lf":
            slots[f["save_as"]] = result
        if f["kind"] == "normal" and (f["is_last"] or f["duration"]):
            out |= {(f["frame_idx"], *k): v for k, v in result.items()}
    return out


def animations(seed):
    r = random.Random(seed)
    for k in range(9):
        height, width, colours, extras = r.randint(1, 9), r.randint(1, 9), r.choice([1, 3]), r.choice([0, 1, 2])
        frames, samples = [], {}
        for i in range(r.randint(1, 9)):
            full = r.random() < 0.2
            h, w = (height, width) if full else (r.randint(1, 7), r.randint(1, 7))
            f = {"frame_idx": 10 * i, "kind": r.choice(["normal"] * 6 + ["reference", "lf"]), "y0": 0 if full else r.randint(-3, 7), "x0": 0 if full else r.randint(-3, 7), "height": h, "width": w, "duration": r.choice([0, 0, 5]), "is_last": False, "save_as": r.randrange(4)}
            f["blending"] = [(r.choice(FRAME_MODES), r.randrange(4), r.randrange(max(1, extras)), r.random() < 0.5) for _ in range(extras + 1)]
            frames.append(f)
            if r.random() < 0.9:
                samples[10 * i] = [(c, y, x, r.uniform(-0.3, 1.4)) for c in range(colours + extras) for y in range(h + 1) for x in range(w) if r.random() < 0.95]
        frames[-1] |= {"is_last": True, "kind": "normal"}
        yield f"image{k}", (height, width, colours, None if k == 0 else [r.random() < 0.5 for _ in range(extras)]), frames, samples


@pytest.mark.parametrize("size", [128, 4])
def test_frames_over_a_canvas(spark, size):
    images, rows, cells, expected = [], [], [], {}
    for name, image, frames, samples in animations(1):
        images.append((name, *image, "extra"))
        rows += [(name, *f.values()) for f in frames]
        cells += [(name, i, *s, "extra") for i, own in samples.items() for s in own]
        expected |= {(name, *k): v for k, v in plain_compose(image, frames, samples).items()}
    random.Random(3).shuffle(cells)
    images.append(("no frames", 4, 4, 1, [], "extra"))
    rows.append(("unknown", 0, "normal", 0, 0, 2, 2, 1, True, 0, [("add", 0, 0, False)]))
    frames = spark.createDataFrame(rows, f"image string, frame_idx long, kind string, y0 int, x0 int, height int, width int, duration int, is_last boolean, save_as int, blending {BLENDING}").repartition(3)
    samples = spark.createDataFrame(cells, "image string, frame_idx long, c int, y int, x int, v double, ty string").repartition(3)
    table = spark.createDataFrame(images, "image string, height int, width int, colours int, associated array<boolean>, duration string")
    got = {(r.image, r.frame_idx, r.c, r.y, r.x): r.v for r in C.compose(frames, samples, table, size).collect()}
    assert got.keys() == expected.keys() and len(got) > 500
    assert np.allclose([got[k] for k in expected], list(expected.values()))
    assert C.compose(frames.where("false"), samples, table, size).count() == 0


def plain_patched(image, base, patches, refs):
    height, width, colours, associated = image
    state = dict(base)
    channels = 1 + max(c for c, _, _ in base)
    for p in sorted(patches, key=lambda p: p["idx"]):
        for dy in range(p["height"]):
            for dx in range(p["width"]):
                y, x = p["y"] + dy, p["x"] + dx
                if not (0 <= y < height and 0 <= x < width):
                    continue
                for c in range(channels):
                    mode, alpha, clamp = p["blending"][max(0, c - colours + 1)]
                    key = (p["ref"], c, p["y0"] + dy, p["x0"] + dx)
                    if key not in refs:
                        continue
                    a, has = colours + alpha, 0 <= alpha < channels - colours
                    pre = has and alpha < len(associated or []) and associated[alpha] is True
                    state[c, y, x] = plain_sample(mode, state.get((c, y, x), 0.0), refs[key], state.get((a, y, x), 0.0), refs.get((p["ref"], a, p["y0"] + dy, p["x0"] + dx), 0.0), clamp, has and a == c, has, pre)
    return state


@pytest.mark.parametrize("size", [128, 4])
def test_patches(spark, size):
    r, images, base_rows, patch_rows, ref_rows, expected = random.Random(2), [], [], [], [], {}
    for k in range(8):
        height, width, colours, extras = r.randint(2, 10), r.randint(2, 10), r.choice([1, 3]), r.choice([0, 1, 2])
        image = (height, width, colours, [r.random() < 0.5 for _ in range(extras)])
        base = {(c, y, x): r.uniform(0, 1.2) for c in range(colours + extras) for y in range(height) for x in range(width)}
        refs = {(i, c, y, x): r.uniform(-0.2, 1.2) for i in range(2) for c in range(colours + extras) for y in range(6) for x in range(6)}
        patches = [{"idx": 3 * i, "ref": r.randrange(3), "y0": r.randrange(5), "x0": r.randrange(5), "height": r.randint(1, 5), "width": r.randint(1, 5), "y": r.randint(-2, 9), "x": r.randint(-2, 9), "blending": [(r.choice(PATCH_MODES), r.randrange(max(1, extras)), r.random() < 0.5) for _ in range(extras + 1)]} for i in range(0 if k == 3 else 14)]
        name = f"image{k}"
        images.append((name, *image))
        base_rows += [(name, *key, v) for key, v in base.items()]
        ref_rows += [(name, *key, v) for key, v in refs.items()]
        patch_rows += [(name, *p.values()) for p in patches]
        expected |= {(name, *key): v for key, v in plain_patched(image, base, patches, refs).items()}
    samples = spark.createDataFrame(base_rows, "image string, c int, y int, x int, v double").repartition(3)
    patches = spark.createDataFrame(patch_rows, f"image string, idx int, ref int, y0 int, x0 int, height int, width int, y int, x int, blending {PATCH_BLENDING}").repartition(3)
    references = spark.createDataFrame(ref_rows, "image string, ref int, c int, y int, x int, v double")
    table = spark.createDataFrame(images, "image string, height int, width int, colours int, associated array<boolean>")
    got = {(x.image, x.c, x.y, x.x): x.v for x in C.patched(samples, patches, references, table, size).collect()}
    assert got.keys() == expected.keys()
    assert np.allclose([got[k] for k in expected], list(expected.values()))
    assert C.patched(samples.where("false"), patches.where("false"), references, table, size).count() == 0


def test_targets_are_running_sums(spark):
    rows = [("a", 0, 0, 10, 20), ("a", 0, 1, 3, 4), ("a", 0, 2, 0, 1), ("a", 1, 0, 7, 8), ("b", 0, 5, 1, 1)]
    found = C.patch_targets(spark.createDataFrame(rows, "image string, patch int, target int, y long, x long"))
    assert {(r.image, r.patch, r.target): (r.y, r.x) for r in found.collect()} == {("a", 0, 0): (10, 20), ("a", 0, 1): (8, 22), ("a", 0, 2): (8, 21), ("a", 1, 0): (7, 8), ("b", 0, 5): (1, 1)}


def select(spark, columns):
    spark.range(3).createOrReplaceTempView("three")
    return spark.sql(f"SELECT {columns} FROM three")


def broadcasts(df):
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


def test_frames_are_not_sent_through_the_driver(spark):
    """The tables of a small file may be large; every join is one by sorting."""
    images = select(spark, "id AS image, 2L AS height, 2L AS width, 1 AS colours, array(true) AS associated")
    frames = select(spark, "id AS image, id AS frame_idx, 'normal' AS kind, id AS y0, 0L AS x0, 2L AS height, 2L AS width, 1 AS duration, true AS is_last, 0 AS save_as, array(named_struct('mode', 'replace', 'source', 0, 'alpha', 0, 'clamp', false)) AS blending")
    assert not broadcasts(C.compose(frames, select(spark, "id AS image, id AS frame_idx, id AS c, id AS y, id AS x, 0.5D AS v"), images))


def test_patches_are_not_sent_through_the_driver(spark):
    images = select(spark, "id AS image, 2L AS height, 2L AS width, 1 AS colours, array(true) AS associated")
    samples = select(spark, "id AS image, id AS c, id AS y, id AS x, 0.5D AS v")
    patches = select(spark, "id AS image, id AS idx, id AS ref, 0 AS y0, 0 AS x0, 1 AS height, 2 AS width, id AS y, 0L AS x, array(named_struct('mode', 'add', 'alpha', 0, 'clamp', false)) AS blending")
    assert not broadcasts(C.patched(samples, patches, samples.selectExpr("image", "image AS ref", "c", "y", "x", "v"), images))
