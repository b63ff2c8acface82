"""Recurrences over two dimensions: samples that are predicted from samples that were predicted before them.

Rows of an image's channel come one after the other to one task, in order, and only a strip of them and the two rows
before it are in memory; images and channels run side by side.  Within a strip the samples whose x + 3 y is equal depend
on smaller ones only, so they are computed together, as a wavefront.  Images and channels that are one strip, of equal
width, are stacked and share their wavefront, CELLS samples of them at a time.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.sources.grids import large

CELLS = 1 << 18  #: samples of a strip; a longer row is a strip of its own


def halved(s: np.ndarray, shift: int = 1) -> np.ndarray:
    """Division by a power of two towards zero."""
    return np.where(s < 0, -(-s >> shift), s >> shift)


#: Predictions from the neighbours w, n, nw, ne, nn, ww and nee.
PREDICTIONS = {
    "zero": lambda p: 0 * p["w"],
    "west": lambda p: p["w"],
    "north": lambda p: p["n"],
    "avg_wn": lambda p: halved(p["w"] + p["n"]),
    "select": lambda p: np.where(np.abs(p["n"] - p["nw"]) < np.abs(p["w"] - p["nw"]), p["w"], p["n"]),
    "gradient": lambda p: np.clip(p["n"] + p["w"] - p["nw"], np.minimum(p["n"], p["w"]), np.maximum(p["n"], p["w"])),
    "ne": lambda p: p["ne"],
    "nw": lambda p: p["nw"],
    "ww": lambda p: p["ww"],
    "avg_wnw": lambda p: halved(p["w"] + p["nw"]),
    "avg_nnw": lambda p: halved(p["n"] + p["nw"]),
    "avg_nne": lambda p: halved(p["n"] + p["ne"]),
    "avg_all": lambda p: halved(6 * p["n"] - 2 * p["nn"] + 7 * p["w"] + p["ww"] + p["nee"] + 3 * p["ne"] + 8, 4),
}


def filled(values: np.ndarray, open_: np.ndarray, top: int, predict) -> None:
    """Adds its prediction to each open sample; values: two rows of what is above (row `top` of the image comes third), changed in place;
    both may be stacks of images."""
    values, open_ = (t.reshape(-1, *t.shape[-2:]) for t in (values, open_))
    image, rows, x = np.nonzero(open_)
    front = x + 3 * rows
    order = np.argsort(front, kind="stable")
    cuts = np.flatnonzero(np.diff(front[order])) + 1
    width = values.shape[2]
    for own in np.split(order, cuts) if len(order) else ():
        k, i, j = image[own], rows[own] + 2, x[own]
        above, left = i + top > 2, j > 0  # the image's first row has none above it
        at = lambda up, by: values[k, i - up, np.clip(j + by, 0, width - 1)]
        w = np.where(left, at(0, -1), np.where(above, at(1, 0), 0))
        n = np.where(above, at(1, 0), w)
        ne = np.where(above & (j + 1 < width), at(1, 1), n)
        near = {"w": w, "n": n, "ne": ne, "nw": np.where(left & above, at(1, -1), w), "nn": np.where(i + top > 3, at(2, 0), n), "ww": np.where(j > 1, at(0, -2), w), "nee": np.where(above & (j + 2 < width), at(1, 2), ne)}
        total = values[k, i, j] + predict(near)
        values[k, i, j] = ((total + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


def predicted_deltas(grid: DataFrame, predictor: str, keys: tuple[str, ...] = ("image",), cells: int = CELLS) -> DataFrame:
    """grid (keys, c, y, x, v, delta) -> keys, c, y, x, v: where delta is true, v is added to the prediction from its finished neighbours.

    Sums wrap at 32 bits.  Missing samples count as 0; a null delta is false; rows with a null key are dropped.  The image is as wide as its widest row."""
    widths = grid.groupBy(*keys).agg((F.max("x") + 1).cast("long").alias("width_"))  # a row for each image
    cell = F.struct(F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"), F.coalesce("delta", F.lit(False)).alias("delta"))
    rows = grid.groupBy(*keys, "c", F.col("y").cast("long").alias("y")).agg(F.collect_list(cell).alias("cells")).join(large(widths), list(keys))
    kinds = dict(grid.dtypes)
    names = [*keys, "c", "y", "x", "v"]
    predict = PREDICTIONS[predictor]

    def strips(stack: list[list], above: np.ndarray, top: int):
        """A batch of the samples of strips of one width, and the last two rows of each."""
        height, width = max(own[-1][1] for own in stack) - top + 1, stack[0][0][0]["width_"]
        values, open_ = np.zeros((len(stack), height + 2, width), np.int64), np.zeros((len(stack), height, width), bool)
        values[:, :2] = above
        there = np.zeros_like(open_)
        for i, waiting in enumerate(stack):
            for _, y, x, v, delta in waiting:
                values[i, y - top + 2, x], open_[i, y - top, x], there[i, y - top, x] = v, delta, True
        filled(values, open_, top, predict)
        image, y, x = np.nonzero(there)
        heads = [pa.array([own[0][0][k].as_py() for own in stack], own_type).take(pa.array(image)) for k, own_type in ((k, stack[0][0][0][k].type) for k in (*keys, "c"))]
        batch = pa.RecordBatch.from_arrays([*heads, pa.array(y + top), pa.array(x), pa.array(values[:, 2:][there])], names)
        return batch, values[0, -2:].copy()

    def run(batches):
        at, waiting, held, above, top = None, [], 0, None, 0
        stack, tallest = [], 0

        def shared():
            if stack:
                yield strips(stack, 0, 0)[0]

        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in (*keys, "c", "y", "width_", "cells")}
            for k in range(batch.num_rows):
                key = tuple(column[c][k].as_py() for c in (*keys, "c"))
                flat = column["cells"][k].values
                x, v, delta = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("x", "v", "delta"))
                y, width = column["y"][k].as_py(), column["width_"][k].as_py()
                if waiting and key != at and not top:  # a whole image waits for others of its width
                    if stack and (stack[0][0][0]["width_"] != waiting[0][0]["width_"] or (len(stack) + 1) * max(tallest, waiting[-1][1] + 1) * waiting[0][0]["width_"] > cells):
                        yield from shared()
                        stack, tallest = [], 0
                    stack.append(waiting)
                    tallest = max(tallest, waiting[-1][1] + 1)
                    waiting, held = [], 0
                elif waiting and (key != at or held >= cells):
                    made, below = strips([waiting], above, top)
                    yield made
                    above, top, waiting, held = below, waiting[-1][1] + 1, [], 0
                if key != at:
                    at, above, top = key, np.zeros((2, width), np.int64), 0
                waiting.append(({c: column[c][k] for c in (*keys, "c")} | {"width_": width}, y, x, v, delta))
                held += width
        yield from shared()
        if waiting:
            yield strips([waiting], above, top)[0]

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*keys, "c")), "y long, x long, v long"])
    return rows.repartition(*keys, "c").sortWithinPartitions(*keys, "c", "y").mapInArrow(run, schema)
