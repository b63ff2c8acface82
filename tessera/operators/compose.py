"""Frames over a canvas and patches over a frame: ordered folds, tile by tile.

A layer is a frame or a patch.  Its samples are packed by tile of the canvas; each tile's layers come one after the
other to one task, in order, and only the tile's state is in memory: four slots for frames, the frame itself for
patches.  Neither the number of layers nor the size of an image bounds what is done at once; images are
told apart by a column.

Tables:

* images: image, height, width, colours (number of colour channels), associated (array: is the k-th extra channel an alpha
  that colours are multiplied with already?)
* frames: image, frame_idx, kind (`normal`, `reference`, `lf`), y0, x0, height, width, duration, is_last, save_as, and
  `blending`: array of struct<mode, source, alpha, clamp>, first for all colours, then for each extra channel
* samples: image, frame_idx, c, y, x, v, counted from the frame's corner; colours come first
* patches: image, idx (their order), ref, y0, x0, height, width (the rectangle in the reference), y, x (its place), and
  `blending`: array of struct<mode, alpha, clamp>
* references: image, ref, c, y, x, v

Missing samples of a frame are 0, those of a reference leave the base as it is.  What lies outside the canvas is dropped.  A slot
that nothing was saved to is a canvas of zeros.  Images without frames give no row; frames of unknown images are dropped.
"""

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions.bits import zigzag
from tessera.sources.grids import large

TILE, SLOTS = 128, 4
WRITTEN = 1 << 16  #: samples that are written at a time
OUT = "image {image}, {layer}c int, y long, x long, v double"


# ---- blending of arrays ----


def unit(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0.0, 1.0)


def mixed(mode: str, base: np.ndarray, new: np.ndarray, base_alpha: np.ndarray, new_alpha: np.ndarray, clamp: bool, premultiplied: bool) -> np.ndarray:
    """The upper sample `new` over the lower one, with their alphas."""
    if mode == "mul":
        return base * (unit(new) if clamp else new)
    if mode == "mix":  # alphas themselves
        new = unit(new) if clamp else new
        return base + new * (1.0 - base)
    alpha = unit(new_alpha) if clamp else new_alpha
    if mode == "muladd":
        return base + alpha * new
    if premultiplied:
        return new + base * (1.0 - alpha)
    both = 1.0 - (1.0 - alpha) * (1.0 - base_alpha)
    total = alpha * new + base_alpha * base * (1.0 - alpha)
    return np.where(both > 0, total / np.where(both > 0, both, 1.0), 0.0)


class Way(NamedTuple):
    """How one channel is blended: replace, add, mul, blend, muladd, mix or skip; below: new samples go under the base."""

    mode: str
    below: bool = False


def way(mode: str, is_alpha: bool, has_alpha: bool) -> Way | None:
    """What a mode of a frame or of a patch means for a channel; None: nothing is done."""
    kind, _, place = mode.partition("_")
    below = place == "below"
    if kind == "none":
        return None
    if kind == "blend":
        return Way("mix", below) if is_alpha else Way("blend", below) if has_alpha else Way("replace")
    if kind == "muladd":
        return Way("replace" if below else "skip") if is_alpha else Way("muladd", below) if has_alpha else Way("add")
    return Way(kind)


def blended(how: Way, base: np.ndarray, new: np.ndarray, base_alpha, new_alpha, clamp: bool, premultiplied: bool) -> np.ndarray:
    if how.mode in ("replace", "add", "skip"):
        return {"replace": new, "add": base + new, "skip": base}[how.mode]
    if how.below:
        base, new, base_alpha, new_alpha = new, base, new_alpha, base_alpha
    return mixed(how.mode, base, new, base_alpha, new_alpha, clamp, premultiplied)


# ---- layers by tile ----


def tiles_of(images: DataFrame, size: int) -> DataFrame:
    """images with ty, tx: a row for each tile of the canvas."""
    for n, side in (("ty", "height"), ("tx", "width")):
        images = images.where(F.col(side) > 0).withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(side) - 1) / size))))
    return images


def packed(samples: DataFrame, layer: str, size: int) -> DataFrame:
    """Samples (image, layer, c, y, x, v) of the canvas by image, layer and tile: `cells`."""
    at = samples.withColumns({"ty": F.floor(F.col("y") / size), "tx": F.floor(F.col("x") / size)})
    cell = F.struct(F.col("c").cast("int").alias("c"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))
    return at.groupBy("image", layer, "ty", "tx").agg(F.collect_list(cell).alias("cells"))


@lru_cache(64)
def places(shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Channel, row and column of each sample of an array."""
    c, y, x = np.indices(shape).reshape(3, -1)
    return c.astype(np.int32), y, x


def folded(layers: DataFrame, layer: str, fold, size: int, out_layer: str | None = None) -> DataFrame:
    """layers: a row for each layer and tile with the image's columns and `cells`; fold(tile) is a generator that gets
    rows as dicts with the arrays `new` and `there` (channels x rows x columns) and gives arrays to write out, or None."""
    kinds = dict(layers.dtypes)
    schema = OUT.format(image=kinds["image"], layer=f"{out_layer} {kinds[layer]}, " if out_layer else "")
    names = ["image", *([out_layer] if out_layer else []), "c", "y", "x", "v"]
    types = [layers.schema["image"].dataType, *([layers.schema[layer].dataType] if out_layer else [])]

    def table(made: list) -> pa.RecordBatch:
        """The arrays (image, layer, ty, tx, array) as samples."""
        sizes = [found.size for *_, found in made]
        own = pa.array(np.repeat(np.arange(len(made), dtype=np.int32), sizes))
        heads = [pa.array([m[k] for m in made], to_arrow_type(t)).take(own) for k, t in enumerate(types)]
        c, y, x = (np.concatenate(v) for v in zip(*(places(m[-1].shape) for m in made)))
        ty, tx = (np.repeat([m[k] * size for m in made], sizes) for k in (2, 3))
        return pa.RecordBatch.from_arrays([*heads, pa.array(c), pa.array(y + ty), pa.array(x + tx), pa.array(np.concatenate([m[-1].reshape(-1) for m in made]))], names)

    def run(batches):
        at, own, made, held = None, None, [], 0
        for batch in batches:
            cells, rows = batch.column(batch.schema.get_field_index("cells")), batch.drop_columns(["cells"]).to_pylist()
            there, ends = cells.is_valid().to_numpy(zero_copy_only=False), cells.offsets.to_numpy()
            columns = [cells.values.field(n).to_numpy(zero_copy_only=False) for n in ("c", "y", "x", "v")]
            for k, row in enumerate(rows):
                key = row["image"], row["ty"], row["tx"]
                if key != at:
                    at, own = key, fold(row)
                    next(own)
                top, left = row["ty"] * size, row["tx"] * size
                shape = row["channels_"], min(size, row["height_"] - top), min(size, row["width_"] - left)
                row["new"], row["there"] = np.zeros(shape), np.zeros(shape, bool)
                if there[k]:
                    c, y, x, v = (column[ends[k] : ends[k + 1]] for column in columns)
                    good = (c >= 0) & (c < shape[0])
                    place = c[good], y[good] - top, x[good] - left
                    row["new"][place], row["there"][place] = v[good], True
                found = own.send(row)
                if found is not None:
                    made.append((row["image"], row[layer], row["ty"], row["tx"], found))
                    held += found.size
                    if held >= WRITTEN:
                        yield table(made)
                        made, held = [], 0
        if made:
            yield table(made)

    dealt = layers.repartition("image", "ty", "tx").sortWithinPartitions("image", "ty", "tx", layer)
    return dealt.mapInArrow(run, schema)


def canvas_of(images: DataFrame) -> DataFrame:
    return images.select("image", F.col("height").cast("long").alias("height_"), F.col("width").cast("long").alias("width_"), "colours", "associated")


def inside(height: str = "height_", width: str = "width_") -> Column:
    return (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col(height)) & (F.col("x") < F.col(width))


def alpha_of(row: dict, info: dict, needs_alpha: bool) -> int | None:
    """The channel that holds the alpha of a mode that has one."""
    extras = row["channels_"] - row["colours"]
    return row["colours"] + info["alpha"] if needs_alpha and extras and 0 <= info["alpha"] < extras else None


# ---- frames ----


def compose(frames: DataFrame, samples: DataFrame, images: DataFrame, size: int = TILE) -> DataFrame:
    """image, frame_idx, c, y, x, v: the whole canvas at every keyframe.

    Each frame is blended over what its source slots hold, channel by channel; if it can be referred to, the result goes into
    slot save_as.  Frames that are no normal ones, and those that replace the whole canvas, are taken as they are."""
    canvas = canvas_of(images)
    info = frames.select("image", "frame_idx", "kind", F.col("y0").cast("long").alias("y0"), F.col("x0").cast("long").alias("x0"), F.col("height").cast("long").alias("h_"), F.col("width").cast("long").alias("w_"), "duration", "is_last", "save_as", "blending")
    info = info.join(large(canvas), "image").withColumn("channels_", F.col("colours") + F.size("blending") - 1)
    placed = samples.join(large(info.select("image", "frame_idx", "y0", "x0", "h_", "w_", "height_", "width_")), ["image", "frame_idx"])
    placed = placed.where(inside("h_", "w_")).withColumns({"y": F.col("y") + F.col("y0"), "x": F.col("x") + F.col("x0")}).where(inside())
    tiles = tiles_of(images.select("image", "height", "width"), size).select("image", "ty", "tx")
    layers = info.join(large(tiles), "image").join(large(packed(placed.select("image", "frame_idx", "c", "y", "x", "v"), "frame_idx", size)), ["image", "frame_idx", "ty", "tx"], "left")

    def fold(first: dict):
        slots: list = [None] * SLOTS
        row = yield
        while True:
            result = frame_over(row, slots)
            if not row["is_last"] and (not row["duration"] or row["save_as"]) and row["kind"] != "lf":
                slots[row["save_as"]] = result
            row = yield result if row["kind"] == "normal" and (row["is_last"] or row["duration"]) else None

    def frame_over(row: dict, slots: list) -> np.ndarray:
        new = row["new"]
        y0, x0 = row["y0"] - row["ty"] * size, row["x0"] - row["tx"] * size
        here = slice(max(y0, 0), max(y0 + row["h_"], 0)), slice(max(x0, 0), max(x0 + row["w_"], 0))
        whole = row["y0"] <= 0 and row["x0"] <= 0 and row["y0"] + row["h_"] >= row["height_"] and row["x0"] + row["w_"] >= row["width_"]
        if row["kind"] != "normal" or row["blending"][0]["mode"] == "replace" and whole:
            return new
        out = np.zeros_like(new)
        for c in range(len(new)):
            own = row["blending"][max(0, c - row["colours"] + 1)]
            base = slots[own["source"]]
            base = np.zeros_like(new) if base is None else base
            alpha = alpha_of(row, own, own["mode"] in ("blend", "muladd"))
            how = way(own["mode"], alpha == c, alpha is not None)
            out[c] = base[c]
            a = c if alpha is None else alpha
            premultiplied = alpha is not None and bool((row["associated"] or [])[alpha - row["colours"] : alpha - row["colours"] + 1] == [True])
            out[c][here] = blended(how, base[c][here], new[c][here], base[a][here], new[a][here], own["clamp"], premultiplied)
        return out

    return folded(layers, "frame_idx", fold, size, "frame_idx")


# ---- patches ----


def patch_targets(tokens: DataFrame) -> DataFrame:
    """tokens (image, patch, target, y, x): the first target of a patch has its place, each later one the zig-zag of its distance from the
    one before.  Running sums give all places; other columns are kept."""
    order = Window.partitionBy("image", "patch").orderBy("target")
    first = F.row_number().over(order) == 1
    steps = tokens.withColumns({c: F.when(first, F.col(c)).otherwise(zigzag(F.col(c))) for c in ("y", "x")})
    return steps.withColumns({c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in ("y", "x")})


def patched(samples: DataFrame, patches: DataFrame, references: DataFrame, images: DataFrame, size: int = TILE) -> DataFrame:
    """image, c, y, x, v: the frames (image, c, y, x, v) with their patches applied one after the other.

    Every pixel of a patch is a row that meets its reference sample by an equi-join, so a rectangle costs its area."""
    canvas = canvas_of(images)
    spread = patches.select("image", "idx", "ref", "y0", "x0", "y", "x", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("dy"))
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("dx"))
    pixels = spread.select("image", "idx", "ref", (F.col("y0") + F.col("dy")).cast("long").alias("ry"), (F.col("x0") + F.col("dx")).cast("long").alias("rx"), (F.col("y") + F.col("dy")).cast("long").alias("y"), (F.col("x") + F.col("dx")).cast("long").alias("x"))
    pixels = pixels.join(large(canvas), "image").where(inside())
    found = references.select("image", "ref", F.col("y").cast("long").alias("ry"), F.col("x").cast("long").alias("rx"), "c", "v").join(large(pixels), ["image", "ref", "ry", "rx"])
    base = samples.select("image", F.lit(-1).cast("long").alias("idx"), "c", "y", "x", "v").join(large(canvas), "image").where(inside())
    columns = ["image", F.col("idx").cast("long").alias("idx"), "c", "y", "x", "v"]
    cells = packed(found.select(columns).unionByName(base.select(columns)), "idx", size)
    channels = samples.groupBy("image").agg((F.max("c") + 1).cast("int").alias("channels_"))
    layers = cells.join(large(patches.select("image", F.col("idx").cast("long").alias("idx"), "blending")), ["image", "idx"], "left").join(large(canvas.join(large(channels), "image")), "image")
    last = F.lead("idx").over(Window.partitionBy("image", "ty", "tx").orderBy("idx")).isNull()
    layers = layers.select("*", last.alias("last_"))

    def fold(first: dict):
        state, row = None, (yield)
        while True:
            if state is None:
                state = np.zeros_like(row["new"])
            if row["idx"] < 0:
                state[:] = row["new"]
            else:
                apply(state, row)
            row = yield state if row["last_"] else None

    def apply(state: np.ndarray, row: dict) -> None:
        for c in range(len(state)):
            own = row["blending"][max(0, c - row["colours"] + 1)]
            alpha = alpha_of(row, own, own["mode"].partition("_")[0] in ("blend", "muladd"))
            how = way(own["mode"], alpha == c, alpha is not None)
            if how is None:
                continue
            a = c if alpha is None else alpha
            premultiplied = alpha is not None and bool((row["associated"] or [])[alpha - row["colours"] : alpha - row["colours"] + 1] == [True])
            at = row["there"][c]
            state[c][at] = blended(how, state[c][at], row["new"][c][at], state[a][at], row["new"][a][at], own["clamp"], premultiplied)

    return folded(layers, "idx", fold, size)
