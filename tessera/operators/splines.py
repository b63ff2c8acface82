"""Splines: curves through control points, drawn as a row of soft dots one unit of length apart.

A segment's four points come from a window, and with them its cubic; where its dots lie follows from running sums of lengths, since the
k-th dot is k units along the curve.  Segments are packed, some tens of one spline to a row, and dealt by image; only in a task do they become
dots and footprints, a bounded number of samples at a time, and what leaves the task are sums by sample, not a row for each sample of each dot.
Sums of one sample from several tasks are added up by a shuffle.  Many splines and images, and many dots on one sample, are one plan.

Tables: points (keys, k, y, x), keys being image and spline; splines (keys, x_dct, y_dct, b_dct, sigma_dct: arrays of 32 numbers).
A point that repeats the one before it is dropped.  Splines without points, and points without a spline, draw nothing.
"""

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.sources.grids import large

STEPS = 16  #: pieces of a segment
WEIGHTS = (0.0042, 0.075, 0.07, 0.3333)  #: of the quantised X, Y, B and sigma (fixed values of the format)
REACH = 3 * math.log(10)
PACK, DOTS, CELLS = 64, 1 << 15, 1 << 17  #: segments of one spline in a row; dots, and samples of their footprints, that are made at a time
KNOTS = np.array([[(j / STEPS) ** k for j in range(STEPS + 1)] for k in (1, 2, 3)])  #: powers of the places where a segment's pieces meet


def dequantised(splines: DataFrame, adjust: int = 0, correlation: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Quantised coefficients to real ones; X and B get their share of Y."""
    scale = 1 / (1 + adjust / 8) if adjust >= 0 else 1 - adjust / 8

    def times(by: float):
        return lambda v: v * by

    splines = splines.withColumns({c: F.transform(c, times(w * scale)) for c, w in zip(("x_dct", "y_dct", "b_dct", "sigma_dct"), WEIGHTS)})
    share = lambda c, by: F.zip_with(c, "y_dct", lambda v, y: v + by * y)
    return splines.withColumns({"x_dct": share("x_dct", correlation[0]), "b_dct": share("b_dct", correlation[1])})


def _between(a: Column, b: Column, start: Column, stop: Column, at: Column) -> Column:
    """The point on the line through a (at start) and b (at stop)."""
    return a + (b - a) * ((at - start) / (stop - start))


def segments(points: DataFrame, keys: tuple[str, ...] = ("image", "spline")) -> DataFrame:
    """keys, k, i (from 0), y, x, y1 to y3, x1 to x3: each point, and the centripetal curve from it to the next, y + y1 u + y2 u^2 + y3 u^3 for u from 0 to 1; null at the last."""
    order = Window.partitionBy(*keys).orderBy("k")
    own = points.select(*keys, "k", *(F.col(c).cast("double").alias(c) for c in "yx"))
    again = (F.lag("y").over(order) == F.col("y")) & (F.lag("x").over(order) == F.col("x"))
    own = own.withColumn("again_", F.coalesce(again, F.lit(False))).where("NOT again_")

    def at(c: str, by: int) -> Column:
        return F.lag(c, -by).over(order) if by < 0 else F.lead(c, by).over(order)

    rows = own.select(*keys, "k", (F.row_number().over(order) - 1).cast("long").alias("i"), *(v.alias(f"{c}p{j}") for c in "yx" for j, v in enumerate((at(c, -1), F.col(c), at(c, 1), at(c, 2)))))
    ends = {f"{c}p0": F.coalesce(f"{c}p0", 2 * F.col(f"{c}p1") - F.col(f"{c}p2")) for c in "yx"} | {f"{c}p3": F.coalesce(f"{c}p3", 2 * F.col(f"{c}p2") - F.col(f"{c}p1")) for c in "yx"}
    rows = rows.withColumns(ends)
    far = lambda j: F.sqrt(F.sqrt((F.col(f"yp{j + 1}") - F.col(f"yp{j}")) ** 2 + (F.col(f"xp{j + 1}") - F.col(f"xp{j}")) ** 2))
    rows = rows.withColumns({f"g{j}": far(j) for j in range(3)})
    g = [F.col(f"g{j}") for j in range(3)]

    def slopes(c: str) -> dict[str, Column]:
        p = [F.col(f"{c}p{j}") for j in range(4)]
        return {f"{c}in": p[2] - p[1] + (p[1] - p[0]) * (g[1] / g[0]) - (p[2] - p[0]) * (g[1] / (g[0] + g[1])), f"{c}out": p[2] - p[1] + (p[3] - p[2]) * (g[1] / g[2]) - (p[3] - p[1]) * (g[1] / (g[1] + g[2]))}

    def cubic(c: str) -> list[Column]:
        p1, p2, start, stop = (F.col(f"{c}{j}") for j in ("p1", "p2", "in", "out"))
        return [p1.alias(c), start.alias(f"{c}1"), (3 * (p2 - p1) - 2 * start - stop).alias(f"{c}2"), (2 * (p1 - p2) + start + stop).alias(f"{c}3")]

    return rows.withColumns(slopes("y") | slopes("x")).select(*keys, "k", "i", *cubic("y"), *cubic("x"))


def upsampled(points: DataFrame, keys: tuple[str, ...] = ("image", "spline")) -> DataFrame:
    """keys, n, y, x: centripetal curves through the points, STEPS pieces a segment; n counts from 0."""
    rows = segments(points, keys)
    last = F.col("x1").isNull()  # the last point starts no segment
    rows = rows.withColumn("step_", F.explode(F.when(last, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(STEPS - 1)))))
    u = F.col("step_") / float(STEPS)
    curve = lambda c: F.when(F.col("step_") == 0, F.col(c)).otherwise(F.col(c) + u * (F.col(f"{c}1") + u * (F.col(f"{c}2") + u * F.col(f"{c}3"))))
    return rows.select(*keys, (F.col("i") * STEPS + F.col("step_")).alias("n"), curve("y").alias("y"), curve("x").alias("x"))


def measured(points: DataFrame, keys: tuple[str, ...] = ("image", "spline")) -> DataFrame:
    """segments() with from_ and to_, how far along the pieces' line they begin and end, arc, the length of the whole line, and first_ and last_ of the spline's points."""
    order = Window.partitionBy(*keys).orderBy("k")
    move = lambda c, j: reduce(add, (F.col(f"{c}{k}") * float(KNOTS[k - 1, j + 1] - KNOTS[k - 1, j]) for k in (1, 2, 3)))
    size = reduce(add, (F.sqrt(move("y", j) ** 2 + move("x", j) ** 2) for j in range(STEPS)))
    # never null: with a check for null at each step the generated method would be too long for Java to compile
    rows = segments(points, keys).withColumns({f"{c}{k}": F.coalesce(f"{c}{k}", F.lit(math.nan)) for c in "yx" for k in (1, 2, 3)})
    rows = rows.withColumn("size_", size).withColumn("size_", F.when(F.col("size_") < math.inf, F.col("size_")).otherwise(0.0))
    rows = rows.withColumn("to_", F.sum("size_").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("size_")
    rows = rows.withColumns({"from_": F.coalesce(F.lag("to_").over(order), F.lit(0.0)), "last_": F.lead("i").over(order).isNull(), "first_": F.col("i") == 0})
    return rows.withColumn("arc", F.max("to_").over(Window.partitionBy(*keys)))


def dots(line: DataFrame, keys: tuple[str, ...] = ("image", "spline")) -> DataFrame:
    """keys, dot, y, x, length, arc: dots one unit apart along the line (keys, n, y, x), the last at its end for what is left; arc: the whole length."""
    order = Window.partitionBy(*keys).orderBy("n")
    pieces = line.select(*keys, "n", *(v.alias(f"{c}{j}") for c in "yx" for j, v in enumerate((F.lag(c).over(order), F.col(c)))))
    size = F.sqrt((F.col("y1") - F.col("y0")) ** 2 + (F.col("x1") - F.col("x0")) ** 2)
    pieces = pieces.withColumn("size_", F.coalesce(size, F.lit(0.0)))
    pieces = pieces.withColumn("to_", F.sum("size_").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("from_", F.coalesce(F.lag("to_").over(order), F.lit(0.0)))
    pieces = pieces.withColumns({"arc": F.max("to_").over(Window.partitionBy(*keys)), "last_": F.lead("n").over(order).isNull(), "first_": F.col("y0").isNull()})
    units = F.when(F.floor("to_") > F.floor("from_"), F.sequence(F.floor("from_") + 1, F.floor("to_"))).otherwise(F.array().cast("array<bigint>"))
    one = F.lit(1.0)
    inner = F.transform(units, lambda k: F.struct(k.alias("dot"), _between(F.col("y0"), F.col("y1"), F.col("from_"), F.col("to_"), k).alias("y"), _between(F.col("x0"), F.col("x1"), F.col("from_"), F.col("to_"), k).alias("x"), one.alias("length")))
    end = lambda dot, length: F.array(F.struct(dot.cast("long").alias("dot"), F.col("y1").alias("y"), F.col("x1").alias("x"), length.alias("length")))
    none = F.array().cast("array<struct<dot:bigint,y:double,x:double,length:double>>")
    made = F.concat(F.when(F.col("first_"), end(F.lit(0), one)).otherwise(none), inner, F.when(F.col("last_"), end(F.floor("to_") + 1, F.col("to_") - F.floor("to_"))).otherwise(none))
    return pieces.select(*keys, "arc", F.explode(made).alias("d_")).select(*keys, "d_.dot", "d_.y", "d_.x", "d_.length", "arc")


def _stacked(lists: pa.Array) -> np.ndarray:
    """A row for each list; zeros follow the shorter ones, and null is NaN."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(1, size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    out[lists.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return out


def _ranges(counts: np.ndarray, most: int):
    """What counts[i] items of each i are, `most` at a time: i of each, and its number among its like."""
    stop = np.cumsum(counts)
    start = stop - counts
    for low in range(0, int(stop[-1]) if len(stop) else 0, most):
        high = min(low + most, int(stop[-1]))
        a, b = np.searchsorted(stop, (low, high - 1), "right") + (0, 1)
        own = np.repeat(np.arange(a, b), np.minimum(stop[a:b], high) - np.maximum(start[a:b], low))
        yield own, np.arange(low, high) - start[own]


#: Coefficients of the error function's approximation (fixed values of the format).
ERF = (0.277820801, 0.232120216, 0.000205260015, 0.0777394369)


def erf(v: np.ndarray) -> np.ndarray:
    x = np.abs(v)
    below = x * ERF[3]
    for c in (*ERF[2::-1], 1.0):  # in place, as the samples are many
        below += c
        if c != 1.0:
            below *= x
    below *= below
    below *= below
    np.divide(1.0, below, out=below)
    np.subtract(1.0, below, out=below)
    return np.copysign(below, v, out=below)


def _places(part: dict[str, np.ndarray], most: int):
    """Dots of segments, `most` at a time: which segment, the dot's number along the spline, y, x, length."""
    first, last = part["first_"], part["last_"]
    before, inner = np.floor(part["from_"]), np.floor(part["to_"]) - np.floor(part["from_"])
    counts = (first + inner + last).astype(np.int64)
    some = np.flatnonzero(counts)
    for own, j in _ranges(counts[some], most):
        low = own[0]
        seen, at = some[low : own[-1] + 1], own - low
        seg = some[own]
        moves = {c: np.stack([part[f"{c}{k}"][seen] for k in (1, 2, 3)], 1) for c in "yx"}
        steps = {c: m @ np.diff(KNOTS) for c, m in moves.items()}
        size = np.sqrt(steps["y"] ** 2 + steps["x"] ** 2)
        upto = np.cumsum(size, 1)
        dot = before[seg] + 1 + j - first[seg]
        along = dot - part["from_"][seg]
        piece = np.minimum((upto[at] < along[:, None]).sum(1), STEPS - 1)
        whole = size[at, piece]
        share = np.divide(along - (upto[at, piece] - whole), whole, out=np.zeros(len(own)), where=whole > 0)
        end = last[seg] & (j == counts[seg] - 1)
        given = end | (first[seg] & (j == 0))
        y, x = (np.where(given, part[c][seg], part[c][seg] + (moves[c] @ KNOTS)[at, piece] + steps[c][at, piece] * share) for c in "yx")
        yield seg, dot, y, x, np.where(end, part["to_"][seg] - np.floor(part["to_"][seg]), 1.0)


def _added(image: np.ndarray, low: dict, count: dict, own: np.ndarray, y: np.ndarray, x: np.ndarray, values: list[np.ndarray]):
    """image, y, x of the samples that footprints reach, and their sums; own: the footprint that each value is of."""
    a, b = own[0], own[-1] + 1
    seen, place = np.unique(image[a:b], return_inverse=True)  # a box around what each image has here
    box = {}
    for c in "yx":
        least, beyond = np.full(len(seen), np.iinfo(np.int64).max), np.zeros(len(seen), np.int64)
        np.minimum.at(least, place, low[c][a:b])
        np.maximum.at(beyond, place, low[c][a:b] + count[c][a:b])
        box[c] = least, beyond - least
    stop = np.cumsum(box["y"][1] * box["x"][1])
    base = stop - box["y"][1] * box["x"][1] - box["y"][0] * box["x"][1] - box["x"][0]
    cell = base[place][own - a] + y * box["x"][1][place][own - a] + x
    if stop[-1] <= 8 * len(own):
        reached = np.zeros(stop[-1], bool)
        reached[cell] = True
        cells = np.flatnonzero(reached)
        sums = [np.bincount(cell, v, len(reached))[cells] for v in values]
    else:
        cells, cell = np.unique(cell, return_inverse=True)
        sums = [np.bincount(cell, v, len(cells)) for v in values]
    which = np.searchsorted(stop, cells, "right")
    y, x = np.divmod(cells - (base + box["y"][0] * box["x"][1] + box["x"][0])[which], box["x"][1][which])
    return seen[which], y + box["y"][0][which], x + box["x"][0][which], sums


def footprints(points: DataFrame, splines: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ("image", "spline"), most_dots: int = DOTS, most: int = CELLS) -> DataFrame:
    """image, y, x and what the splines' dots add to each channel there (x_, y_, b_); sizes: image, height, width."""
    own = [*(f"{c}{j}" for c in "yx" for j in ("", 1, 2, 3)), "from_", "to_", "first_", "last_"]
    packed = measured(points, keys).groupBy(*keys, "arc", F.floor(F.col("i") / PACK).alias("pack_")).agg(F.collect_list(F.struct(*own)).alias("parts"))
    waves = [f"{c}_dct" for c in ("x", "y", "b", "sigma")]
    rows = packed.join(large(splines.select(*keys, *(F.col(c).cast("array<double>").alias(c) for c in waves))), list(keys))
    rows = rows.join(large(sizes.select("image", *(F.col(c).cast("double").alias(c) for c in ("height", "width")))), "image")
    rows = rows.select("image", "height", "width", "arc", *waves, "parts")
    edge = math.sqrt(0.125)

    def run(batches):
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns))
            images = column["image"].dictionary_encode()
            code, parts, of = images.indices.to_numpy(), column["parts"].flatten(), pc.list_parent_indices(column["parts"]).to_numpy()
            arc, *sides = (column[c].to_numpy(zero_copy_only=False) for c in ("arc", "height", "width"))
            coefficients = [_stacked(column[c]) for c in waves]
            scale = np.arange(max(c.shape[1] for c in coefficients)) * (math.pi / 32)
            for seg, dot, cy, cx, length in _places({c: parts.field(c).to_numpy(zero_copy_only=False) for c in own}, most_dots):
                row = of[seg]
                at = 31.0 * np.where(arc[row] > 0, np.minimum(1.0, dot / np.where(arc[row] > 0, arc[row], 1.0)), 1.0)
                basis = math.sqrt(2) * np.cos((at[:, None] + 0.5) * scale)
                basis[:, 0] = 1.0
                *values, sigma = (np.einsum("dk,dk->d", basis[:, : c.shape[1]], c[row]) for c in coefficients)
                values = [v * length for v in values]
                reach = np.sqrt(2.0 * (REACH + np.maximum(0.01, np.maximum.reduce(values)))) * np.abs(sigma)
                low, count = {}, {}
                for c, centre, side in (("y", cy, sides[0]), ("x", cx, sides[1])):
                    low[c] = np.maximum(0.0, np.floor(centre - reach + 0.5))
                    count[c] = np.minimum(side[row], np.floor(centre + reach + 1.5)) - low[c]  # nothing outside the image
                some = np.flatnonzero((count["y"] > 0) & (count["x"] > 0) & (sigma != 0))
                low, count = ({c: v[some].astype(np.int64) for c, v in d.items()} for d in (low, count))
                row, cy, cx, sigma, *values = (v[some] for v in (row, cy, cx, sigma, *values))
                for own_, k in _ranges(count["y"] * count["x"], most):
                    y, x = np.divmod(k, count["x"][own_])
                    y, x = y + low["y"][own_], x + low["x"][own_]
                    by = 1 / np.abs(sigma)
                    far, by = np.sqrt((x - cx[own_]) ** 2 + (y - cy[own_]) ** 2) * (0.5 * by)[own_], (edge * by)[own_]
                    factor = erf(far + by)
                    factor -= erf(far - by)
                    factor *= factor
                    soft = (0.25 * sigma)[own_] * factor
                    found, y, x, sums = _added(code[row], low, count, own_, y, x, [v[own_] * soft for v in values])
                    yield pa.RecordBatch.from_arrays([images.dictionary.take(pa.array(found)), pa.array(y), pa.array(x), *map(pa.array, sums)], ["image", "y", "x", "x_", "y_", "b_"])

    made = rows.mapInArrow(run, f"image {dict(rows.dtypes)['image']}, y long, x long, x_ double, y_ double, b_ double")
    return made.groupBy("image", "y", "x").agg(*(F.sum(f"{c}_").alias(f"{c}_") for c in "xyb"))


def drawn(grid: DataFrame, points: DataFrame, splines: DataFrame, sizes: DataFrame, channels: tuple[str, str, str] = ("x_", "y_", "b_")) -> DataFrame:
    """grid (image, y, x and the channels X, Y, B) with the splines on it."""
    added = footprints(points, splines, sizes).withColumnsRenamed({"x_": "add_x_", "y_": "add_y_", "b_": "add_b_"})
    joined = grid.join(large(added), ["image", "y", "x"], "left")
    return joined.select("image", "y", "x", *((F.col(c) + F.coalesce(f"add_{k}_", F.lit(0.0))).alias(c) for c, k in zip(channels, "xyb")))
