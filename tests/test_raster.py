"""Laws of the raster operators, and a choice of queries against DuckDB."""

import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import frame_queries  # noqa: F401  fills QUERIES
from tessera.functions import colour
from tessera.operators import blocks as B, samples as S, stencils as T, tiles
from tessera.plans.colourplan import BT2100, D65, DCI, P3, SRGB, Encoding, Plan
from tessera.plans.region import Region, source_region
from tessera.queries import ORACLE_SQL, QUERIES
from tessera.sources import container, sinks
from tessera.streaming import progressive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in ("orders", "events", "embeddings", "nation", "part", "customer", "lineitem"):
        db.sql(f"CREATE VIEW {name} AS FROM '{SF}/{name}.parquet'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", ["hybrid_uint", "half_float", "lehmer_permutation", "toc_permute", "prefix_codes", "rct_orders", "palette_lookup", "pred_select", "pred_avg_all", "ma_tree_contexts", "squeeze_rows", "squeeze_columns", "unsqueeze_rows", "unsqueeze_columns", "gabor", "lf_smoothing", "lf_smoothing_three", "epf_step", "epf_3_steps", "tone_map", "residual_samples", "modular_xyb", "upsample2", "chroma_upsample_both", "dct8_inverse", "dct2_special", "hf_dequant", "blend_blend", "keyframe_counters", "patch_apply", "crop_gabor", "orient_6", "tf_to_pq", "gamut_map", "eetf"])
def test_query(spark, db, name):
    expected = db.sql(ORACLE_SQL[name])
    columns = sorted(expected.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(got.select(columns).collect()) == rows(expected.select(*(f'"{c}"' for c in columns)).fetchall())


def grid(spark, values):
    return spark.createDataFrame([(y, x, int(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "y long, x long, v long")


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (3, 8), (130, 5)])
def test_squeeze_there_and_back(spark, shape):
    values = np.random.default_rng(0).integers(-300, 300, shape)
    for squeeze, along in ((T.squeeze_rows, "x"), (T.squeeze_columns, "y")):
        back = tiles.unsqueeze(squeeze(grid(spark, values)), along)
        assert {(r.y, r.x): r.v for r in back.collect()} == {(y, x): int(v) for (y, x), v in np.ndenumerate(values)}


def test_unsqueeze_of_a_very_long_row(spark):
    values = np.random.default_rng(0).integers(-300, 300, (1, 60_001))
    back = tiles.unsqueeze(T.squeeze_rows(grid(spark, values)))
    assert [r.v for r in back.orderBy("x").collect()] == values[0].tolist()


def reflected(at, size):
    while not 0 <= at < size:
        at = -at - 1 if at < 0 else 2 * size - 1 - at
    return at


def plain_epf(image, sigma, iterations):
    """Sample by sample; image: three channels."""
    _, height, width = image.shape
    at = lambda c, y, x: image[c, reflected(y, height), reflected(x, width)]
    plus = [(0, 0), (0, -1), (0, 1), (-1, 0), (1, 0)]
    far = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if 1 <= abs(y) + abs(x) <= 2]
    for neighbours, compared, scale in {1: [(plus[1:], plus, 1)], 2: [(plus[1:], plus, 1), (plus[1:], plus[:1], 6.5)], 3: [(far, plus, 0.9), (plus[1:], plus, 1), (plus[1:], plus[:1], 6.5)]}[iterations]:
        out = image.copy()
        for y in range(height):
            for x in range(width):
                if sigma[y, x] < 0.3:
                    continue
                border = 2 / 3 if {x % 8, y % 8} & {0, 7} else 1
                total, weights = image[:, y, x].copy(), 1.0
                for dy, dx in neighbours:
                    d = sum(s * abs(at(c, y + dy + py, x + dx + px) - at(c, y + py, x + px)) for c, s in enumerate((40, 5, 3.5)) for py, px in compared)
                    w = max(0, 1 - 6.6 * (1 - 0.5**0.5) / sigma[y, x] * scale * border * d)
                    total += w * np.array([at(c, y + dy, x + dx) for c in range(3)])
                    weights += w
                out[:, y, x] = total / weights
        image = out
    return image


@pytest.mark.parametrize("iterations", [1, 2, 3])
def test_epf_of_several_images(spark, iterations, monkeypatch):
    """Images of several sizes, one smaller than the halo, in tiles of 8 x 8."""
    rng = np.random.default_rng(iterations)
    pictures = {k: (rng.random((3, *shape)) / [[[120]], [[30]], [[24]]], np.kron(rng.choice([0.2, 1.5, 4.0], (3, 3)), np.ones((8, 8)))[: shape[0], : shape[1]]) for k, shape in {"a": (19, 17), "b": (2, 3), "c": (1, 12)}.items()}
    rows = [(k, y, x, *map(float, v[:, y, x]), float(s[y, x])) for k, (v, s) in pictures.items() for y in range(v.shape[1]) for x in range(v.shape[2])]
    frame = spark.createDataFrame(rows, "image string, y long, x long, a double, b double, c double, s double")
    whole = tiles.in_tiles
    monkeypatch.setattr(tiles, "in_tiles", lambda *args, **more: whole(*args, **more, size=8))
    got = {(r.image, r.y, r.x): (r.a, r.b, r.c) for r in tiles.epf(frame, "s", ("a", "b", "c"), iterations, ("image",)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for k, (v, s) in pictures.items():
        expected = plain_epf(v, s, iterations)
        for (y, x), _ in np.ndenumerate(s):
            assert got[k, y, x] == pytest.approx(expected[:, y, x], abs=1e-12)
            changed += got[k, y, x] != tuple(v[:, y, x])
    assert changed > len(rows) / 3


@pytest.mark.parametrize("factor", [2, 4, 8])
def test_upsampling_is_symmetric_and_bounded(spark, factor):
    n = 5 * factor // 2
    weights = tuple(np.random.default_rng(factor).random(n * (n + 1) // 2))
    kernels = tiles.upsampling_kernels(factor, weights)
    assert (kernels == kernels[::-1, :, ::-1]).all() and (kernels == kernels.transpose(1, 0, 3, 2)).all() and kernels[0, 0, 0, 4] == weights[4]
    values = np.random.default_rng(1).integers(0, 100, (9, 6))
    up = {(r.y, r.x): r.v for r in tiles.upsample(grid(spark, values), ("v",), factor, weights).collect()}
    assert len(up) == values.size * factor**2 and min(up.values()) >= values.min() and max(up.values()) <= values.max()


def test_tiles_of_no_samples(spark):
    none = grid(spark, [[1]]).where("false")
    assert tiles.upsample(none, ("v",)).count() == 0 and tiles.unsqueeze(T.squeeze_rows(none)).count() == 0


@pytest.mark.parametrize("depth", [8, 10, 30])
def test_palette_deltas_are_the_formats(spark, depth):
    known = {-1: (0, 0, 0), -2: (4, 4, 4), -3: (-4, -4, -4), -4: (11, 0, 0), -7: (0, 0, 13), -142: (-24, 45, -45), -143: (24, -45, 45), -144: (0, 0, 0), -145: (4, 4, 4), 0: (7, 8, 9)}
    colours = spark.createDataFrame([(0, c, 7 + c) for c in range(4)], "idx long, c int, v long")
    got = {(r.x, r.c): r.v for r in S.palette(grid(spark, [list(known)]), colours, 1, depth, 4).collect()}
    shift = max(min(depth, 24) - 8, 0)
    assert got == {(x, c): (10 if c == 3 else v[c]) if i == 0 else 0 if c == 3 else v[c] << shift for x, (i, v) in enumerate(known.items()) for c in range(4)}


def test_strips_do_not_show(spark):
    """Neighbours across the strips of rows."""
    values = np.random.default_rng(1).integers(0, 99, (131, 3))
    rows = T.around(grid(spark, values), 2).collect()
    assert len(rows) == 131
    for r in rows:
        for d, own in ((-2, r.m2), (-1, r.m1), (0, r.r0), (1, r.p1), (2, r.p2)):
            assert own == (values[r.y + d].tolist() if 0 <= r.y + d < 131 else None)


def test_dct_there_and_back(spark):
    v = np.random.default_rng(2).normal(size=64).tolist()
    out = spark.createDataFrame([(v,)], "v array<double>").select(B.inverse_dct(B.forward_dct(F.col("v")))).first()[0]
    assert out == pytest.approx(v, abs=1e-9)


@pytest.mark.parametrize("code", range(1, 9))
def test_orientation_there_and_back(spark, code):
    g = grid(spark, np.arange(12).reshape(3, 4))
    out_w, out_h = (3, 4) if code > 4 else (4, 3)
    turned = S.oriented(g, code, out_w, out_h)
    back = S.oriented(turned, {6: 8, 8: 6}.get(code, code), 4, 3)
    assert sorted(map(tuple, back.select("y", "x", "v").collect())) == sorted(map(tuple, g.collect()))


def test_crop_of_filter_is_filter_of_crop(spark):
    values = np.random.default_rng(3).integers(0, 255, (40, 30))
    whole = {(r.y, r.x): r.v for r in T.gabor(grid(spark, values)).collect()}
    for seed in range(3):
        rng = random.Random(seed)
        crop = Region(rng.randrange(20), rng.randrange(30), 8, 7)
        need = source_region(crop, gabor=True).intersection(Region(0, 0, 30, 40))
        local = need.where(grid(spark, values)).withColumn("x", F.col("x") - need.left)
        part = {(r.y, r.x + need.left): r.v for r in T.gabor(local).collect()}
        for y in range(crop.top, crop.bottom):
            for x in range(crop.left, crop.right):
                if (y, x) in whole:
                    assert part[y, x] == pytest.approx(whole[y, x])


def test_region_algebra():
    a, b = Region(0, 0, 10, 10), Region(5, -3, 10, 8)
    assert a.intersection(b) == Region(5, 0, 5, 5) and a.merge(b) == Region(0, -3, 15, 13)
    assert a.contains(a.intersection(b)) and not a.contains(b)
    assert Region(3, 5, 10, 10).aligned(8) == Region(0, 0, 16, 16) and Region(3, 5, 10, 10).downsample(8).upsample(8) == Region(0, 0, 16, 16)


def test_fused_plan_is_the_same(spark):
    plan = Plan.convert(Encoding(D65, SRGB, "srgb"), Encoding(DCI, P3, "dci"))
    assert sum(k == "matrix" for k, _ in plan.steps) == 3 and sum(k == "matrix" for k, _ in plan.fused().steps) == 1
    df = spark.createDataFrame([(0.1, 0.5, 0.9), (0.0, 1.0, 0.3)], "a double, b double, c double")
    rgb = [F.col(c) for c in "abc"]
    for r in df.select(*(c.alias(f"x{i}") for i, c in enumerate(plan.apply(rgb))), *(c.alias(f"y{i}") for i, c in enumerate(plan.fused().apply(rgb)))).collect():
        assert r[:3] == pytest.approx(r[3:], abs=1e-9)
    there = Plan.convert(Encoding(D65, SRGB, "srgb"), Encoding(D65, BT2100, "pq"))
    back = Plan.convert(Encoding(D65, BT2100, "pq"), Encoding(D65, SRGB, "srgb"))
    for r in df.select(*back.apply(there.apply(rgb)), *rgb).collect():
        assert r[:3] == pytest.approx(r[3:], abs=1e-6)


#: A complete image of 240 x 135 pixels.
SAMPLE = bytes.fromhex("ff 0a 30 54 10 09 08 06 01 00 78 00 4b 38 41 3c b6 3a 51 fe 00 47 1e a0 85 b8 27 1a 48 45 84 1b 71 4f a8 3e 8e 30 03 92 84 01")


def test_containers(spark):
    box = lambda name, data: struct.pack(">I4s", 8 + len(data), name) + data
    head = bytes.fromhex(container.CONTAINER)
    part = lambda n, data: box(b"jxlp", struct.pack(">I", n) + data)
    exif = box(b"Exif", struct.pack(">I", 4) + b"tiff")
    rows = [("bare", SAMPLE), ("one", head + exif + box(b"jxlc", SAMPLE)), ("parts", head + part(0, SAMPLE[:5]) + part(1 | 1 << 31, SAMPLE[5:])), ("wrong", head + part(1, SAMPLE[:5]) + part(0, SAMPLE[5:])), ("cut", head + exif[:-1]), ("none", b"GIF89a"), ("null", None)]
    images = spark.createDataFrame(rows, "image_id string, bytes binary")
    found = {r.image_id: r for r in container.codestreams(images).collect()}
    assert set(found) == {"bare", "one", "parts", "wrong"}
    assert all(bytes(found[k].codestream) == SAMPLE and found[k].problem is None for k in ("bare", "one", "parts")) and found["wrong"].problem
    assert [tuple(r) for r in container.exif(container.boxes(images)).collect()] == [("one", 4, bytearray(b"tiff"))]
    ends = [("none", head + part(0, SAMPLE)), ("early", head + part(1 << 31, SAMPLE[:5]) + part(1, SAMPLE[5:])), ("once", head + part(1 << 31, SAMPLE))]
    problems = {r.image_id: r.problem for r in container.codestreams(spark.createDataFrame(ends, "image_id string, bytes binary")).collect()}
    assert problems["none"] and problems["early"] and problems["once"] is None
    side = spark.createDataFrame([("a", head + box(b"brob", b"Exifdata") + box(b"brob", b"jxlcdata") + box(b"brob", b"Ex") + box(b"xml ", b"<x/>") + box(b"jxlc", SAMPLE))], "image_id string, bytes binary")
    found_side = [(r.box_seq, r.type, bytes(r.payload), r.problem) for r in container.side_boxes(container.boxes(side)).orderBy("box_seq").collect()]
    assert found_side == [(1, "Exif", b"data", "compressed"), (2, "jxlc", b"data", "may not be compressed"), (3, "Ex", b"", "cut short"), (4, "xml ", b"<x/>", None)]
    sizes = container.sizes(container.codestreams(images).where("problem IS NULL"))
    assert {(r.width, r.height) for r in sizes.collect()} == {(240, 135)}


def test_sinks(spark):
    g = grid(spark, [[0, 128, 255], [1, 2, 3]]).withColumn("image_id", F.lit("i"))
    packed = sinks.interleaved(g, ["v"])
    import io
    import zlib

    data = bytes(sinks.encode(packed, 1).first().content)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == bytes([0, 0, 128, 255, 0, 1, 2, 3])
    array = np.load(io.BytesIO(bytes(sinks.encode(packed, 1, "npy").first().content)))
    assert array.shape == (1, 2, 3, 1) and array[0, 0, 2, 0] == 1.0


def test_stream_is_batch(spark, tmp_path):
    sections = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 10, 5), ("b", 0, 0, 7)], "image_id string, section int, offset long, size long")
    chunks = [("a", 0, 8), ("b", 0, 7), ("a", 8, 4)]
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    for k, chunk in enumerate(chunks):
        spark.createDataFrame([chunk], progressive.CHUNKS).coalesce(1).write.mode("append").parquet(source)
        progressive.follow(spark.readStream.schema(progressive.CHUNKS).parquet(source), sections, table, str(tmp_path / "state")).awaitTermination()
    last = {}
    for r in spark.read.parquet(table).orderBy("batch").collect():
        last[r.image_id, r.section] = (r.filled, r.complete)
    batch = progressive.section_states(sections, progressive.received(spark.createDataFrame(chunks, progressive.CHUNKS)))
    assert last == {(r.image_id, r.section): (r.filled, r.complete) for r in batch.collect()} == {("a", 0): (10, True), ("a", 1): (2, False), ("b", 0): (7, True)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_tone_map_to_each_images_peak(spark):
    """Each image's largest luminance, given to all its samples, is the curve's upper end."""
    luma = [0.2, 0.7, 0.1]
    rows = [(image, y, x, *(v / 100 * (image + 1) for v in (3 * y + x, 2 * x + 1, 5 * y + 2))) for image in range(2) for y in range(4) for x in range(4)]
    frame = spark.createDataFrame(rows, "image int, y long, x long, a double, b double, c double")
    luminance = sum(w * F.col(c) for w, c in zip(luma, "abc"))
    peaks = {k: max(sum(w * v for w, v in zip(luma, r[3:])) for r in rows if r[0] == k) for k in range(2)}
    found = S.with_peak(frame, luminance, ("image",))
    mapped = lambda peak: [v.alias(n) for v, n in zip(colour.tone_map([F.col(c) for c in "abc"], luma, 1000.0, 100.0, peak=peak), "rgb")]
    got = {r[:3]: r[3:] for r in map(tuple, found.select("image", "y", "x", *mapped(F.col("peak"))).collect())}
    for k, peak in peaks.items():
        for r in frame.where(F.col("image") == k).select("image", "y", "x", *mapped(F.lit(peak))).collect():
            assert got[tuple(r)[:3]] == pytest.approx(tuple(r)[3:])
    brightest = max(sum(w * v for w, v in zip(luma, got[r[:3]])) for r in rows if r[0] == 1)
    assert brightest == pytest.approx(1.0, abs=1e-3)  # the display's own brightest


def test_upsampled_halves_are_rounded_as_in_sql(spark, tmp_path):
    """150 surroundings of 5 x 5 whose first sample makes the sum by decimal weights end in half a hundredth exactly."""
    import duckdb
    import numpy as np
    import pandas as pd

    import __spark_entry__ as entry
    from tessera.operators import tiles

    weights = np.rint(tiles.upsampling_kernels(2, tiles.UP2)[0, 0].reshape(-1) * 1e8).astype(np.int64)
    at = int(np.flatnonzero(np.gcd(weights, 10) == 1)[0])
    near = np.random.default_rng(3).integers(0, 500_000, (150, 25))
    near[:, at] = 0
    near[:, at] = (500_000 - near @ weights) * pow(int(weights[at]), -1, 1_000_000) % 1_000_000
    image = near.reshape(6, 25, 5, 5).transpose(0, 2, 1, 3).reshape(-1)
    pd.DataFrame({"o_orderkey": np.arange(image.size), "o_custkey": 0, "o_totalprice": image.astype(float)}).to_parquet(tmp_path / "orders.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    expected = {tuple(r) for r in connection.execute(entry.oracle_sql()["upsample2"]).fetchall()}
    assert {tuple(r) for r in entry.queries()["upsample2"](spark, str(tmp_path)).collect()} == expected


def test_joins_with_tables_that_grow_are_sorted(spark, tmp_path):
    """Patch pixels and the palettes of all images are not broadcast, however small the compressed files behind them."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("patch_apply", "delta_palette_select"):
        text = plan(QUERIES[name](spark, SF))
        assert "SortMergeJoin" in text and "BroadcastHashJoin [y" not in text and "BroadcastHashJoin [image" not in text
