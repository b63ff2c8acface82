"""Stencils in tiles: all images, frames and channels of a table at once.

A grid has a row for each sample: key columns (image, frame ...), y, x and a column for each channel; a missing
sample is NaN inside.  One shuffle deals the samples to square tiles by key and place, each with the samples up
to `halo` beyond its edges; beyond the image's edges samples are mirrored.  So neither large images nor wide ones
meet in one task, and no image waits for another.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Tile:
    """Rows and columns of the image that an array with its halo shows, mirrored ones included, and the image's size."""

    y: np.ndarray
    x: np.ndarray
    height: int
    width: int


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Places beyond the edges reflected into the image, again and again if it is small."""
    at = at % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def in_tiles(grid: DataFrame, channels: tuple[str, ...], halo: int, kernel, keys: tuple[str, ...] = (), out: tuple[str, ...] | None = None, scale: tuple[int, int] = (1, 1), size: int = 128) -> DataFrame:
    """kernel(array of channels x rows x columns with halo, Tile) -> array of the `out` channels without it, `scale` times as high and wide."""
    out, keys = out or channels, keys or ("one_",)
    if keys == ("one_",):
        grid = grid.withColumn("one_", F.lit(0))
    dims = grid.groupBy(*keys).agg((F.max("y") + 1).cast("long").alias("height_"), (F.max("x") + 1).cast("long").alias("width_"))  # a row for each image
    tiles = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + d) / size).cast("long") for d in ((-halo, 0, halo) if halo else (0,)))))
    spread = grid.select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(F.col(c).cast("double").alias(c) for c in channels))
    spread = spread.select("*", F.explode(tiles("y")).alias("ty_")).select("*", F.explode(tiles("x")).alias("tx_"))
    spread = spread.join(dims, list(keys)).where((F.col("ty_") >= 0) & (F.col("tx_") >= 0) & (F.col("ty_") * size < F.col("height_")) & (F.col("tx_") * size < F.col("width_")))
    kinds = dict(grid.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        height, width = (table.column(c)[0].as_py() for c in ("height_", "width_"))
        y0, x0 = (key[len(keys) + k].as_py() * size for k in (0, 1))
        rows, columns = np.arange(y0 - halo, min(y0 + size, height) + halo), np.arange(x0 - halo, min(x0 + size, width) + halo)
        y, x = (table.column(c).to_numpy() for c in "yx")
        own = np.full((len(channels), len(rows), len(columns)), np.nan)
        for k, c in enumerate(channels):
            own[k, y - rows[0], x - columns[0]] = table.column(c).to_numpy()
        tile = Tile(mirrored(rows, height), mirrored(columns, width), height, width)
        found = kernel(own[:, tile.y - rows[0]][:, :, tile.x - columns[0]], tile)
        at = np.indices(found.shape[1:]).reshape(2, -1)
        count = at.shape[1]
        values = [pa.array(at[0] + y0 * scale[0]), pa.array(at[1] + x0 * scale[1]), *(pa.array(c.reshape(-1)) for c in found)]
        return pa.table([*(pa.array([key[k].as_py()] * count, table.schema.field(name).type) for k, name in enumerate(keys)), *values], [*keys, "y", "x", *out])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y long", "x long", *(f"{c} double" for c in out)])
    return spread.groupBy(*keys, "ty_", "tx_").applyInArrow(run, schema).drop("one_")


def moved(a: np.ndarray, dy: int, dx: int, by: int) -> np.ndarray:
    """The array without `by` samples at each edge, as seen from (dy, dx) away."""
    rows, columns = a.shape[-2:]
    return a[..., by + dy : rows - by + dy, by + dx : columns - by + dx]


# ---- the edge-preserving filter ----

#: Weights of the three channels' distances, of the first and the last step, and at the borders of 8 x 8 blocks (fixed values of the format).
EPF_CHANNELS, EPF_FIRST, EPF_LAST, EPF_BORDER = (40.0, 5.0, 3.5), 0.9, 6.5, 2 / 3
PLUS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
NEAR = PLUS[1:]
FAR = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if 0 < abs(dy) + abs(dx) <= 2]
#: Of each step: neighbours, the surroundings that are compared, and the distances' scale.
EPF_STEPS = {0: (FAR, PLUS, EPF_FIRST), 1: (NEAR, PLUS, 1.0), 2: (NEAR, PLUS[:1], EPF_LAST)}
EPF_REACH = {0: 3, 1: 2, 2: 1}


def epf(grid: DataFrame, sigma: str, channels: tuple[str, str, str], iterations: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """The edge-preserving filter: the mean of neighbours weighted by how alike their surroundings are, in 1 to 3 steps.

    sigma: a column that is constant on each 8 x 8 block; samples where it is below 0.3 stay.  All steps take one shuffle:
    the halo is what they reach together, and a step's result beyond the image's edge is again the mirrored one."""
    steps = {1: (1,), 2: (1, 2), 3: (0, 1, 2)}[iterations]

    def step(image: np.ndarray, spread: np.ndarray, edge: np.ndarray, which: int) -> np.ndarray:
        neighbours, compared, factor = EPF_STEPS[which]
        reach = EPF_REACH[which]
        slope = -6.6 * (1 - np.sqrt(0.5)) * factor * np.where(edge, EPF_BORDER, 1.0) / np.maximum(spread, 0.3)
        here = moved(image, 0, 0, reach)
        total, weights = here.copy(), np.ones(here.shape[1:])
        for dy, dx in neighbours:
            around = reach - max(abs(dy), abs(dx))  # as far as both samples of a pair are there
            gap = np.tensordot(EPF_CHANNELS, np.abs(moved(image, dy, dx, reach - around) - moved(image, 0, 0, reach - around)), 1)
            distance = sum(moved(gap, py, px, around) for py, px in compared)
            w = np.maximum(0, 1 + distance * moved(slope, 0, 0, reach))
            total += w * moved(image, dy, dx, reach)
            weights += w
        return np.where(moved(spread, 0, 0, reach) < 0.3, here, total / weights)

    def kernel(a: np.ndarray, tile: Tile) -> np.ndarray:
        border = lambda at: np.isin(at % 8, (0, 7))
        image, spread, edge = a[:3], a[3], border(tile.y)[:, None] | border(tile.x)[None]
        for which in steps:
            reach = EPF_REACH[which]
            image = step(image, spread, edge, which)
            spread, edge = moved(spread, 0, 0, reach), moved(edge, 0, 0, reach)
        return image

    return in_tiles(grid, (*channels, sigma), sum(EPF_REACH[s] for s in steps), kernel, keys, channels)


# ---- resampling ----

#: Default weights of the 2 x upsampling (fixed values of the format).
UP2 = (
    -0.01716200, -0.03452303, -0.04022174, -0.02921014, -0.00624645,
    0.14111091, 0.28896755, 0.00278718, -0.01610267, 0.56661550,
    0.03777607, -0.01986694, -0.03144731, -0.01185068, -0.00213539,
)


def upsampling_kernels(factor: int, weights: tuple[float, ...]) -> np.ndarray:
    """factor x factor kernels of 5 x 5 weights: a symmetric matrix, given by its upper triangle, holds one quarter of them; the rest are their mirror images."""
    n = 5 * factor // 2
    square = np.zeros((n, n))
    square[np.triu_indices(n)] = weights
    square += np.triu(square, 1).T
    phase = np.arange(factor)
    back = phase >= factor // 2
    taps = np.arange(5)
    line = 5 * np.where(back, factor - 1 - phase, phase)[:, None] + np.where(back[:, None], 4 - taps, taps)
    return square[line[:, None, :, None], line[None, :, None, :]]


def upsample(grid: DataFrame, channels: tuple[str, ...], factor: int = 2, weights: tuple[float, ...] = UP2, keys: tuple[str, ...] = ()) -> DataFrame:
    """2, 4 or 8 times the size by 5 x 5 kernels (15, 55 or 210 weights), held within what the 25 samples span."""
    kernels, parts = upsampling_kernels(factor, weights), 1e8
    if np.allclose(np.rint(kernels * parts), kernels * parts, rtol=0, atol=1e-6):  # weights of eight decimals: sums of whole samples are exact
        kernels = np.rint(kernels * parts)
    else:
        parts = 1.0

    def kernel(a: np.ndarray, tile: Tile) -> np.ndarray:
        near = np.stack([moved(a, dy, dx, 2) for dy in range(-2, 3) for dx in range(-2, 3)])
        fine = np.einsum("pqk,kcyx->cypxq", kernels.reshape(factor, factor, 25), near) / parts
        low, high = near.min(0)[:, :, None, :, None], near.max(0)[:, :, None, :, None]
        c, h, _, w, _ = fine.shape
        return np.clip(fine, low, high).reshape(c, h * factor, w * factor)

    return in_tiles(grid, channels, 2, kernel, keys, scale=(factor, factor))


def chroma_upsample(grid: DataFrame, channels: tuple[str, ...], across: bool = True, down: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Twice the width and then twice the height by the triangle filter."""

    def doubled(a: np.ndarray, axis: int) -> np.ndarray:
        """Of an axis with a halo of one: both outputs of each inner sample, in turn."""
        a = np.moveaxis(a, axis, -1)
        both = np.stack([0.25 * a[..., :-2] + 0.75 * a[..., 1:-1], 0.75 * a[..., 1:-1] + 0.25 * a[..., 2:]], -1)
        return np.moveaxis(both.reshape(*both.shape[:-2], -1), -1, axis)

    def kernel(a: np.ndarray, tile: Tile) -> np.ndarray:
        a = doubled(a, 2) if across else a[:, :, 1:-1]
        return doubled(a, 1) if down else a[:, 1:-1]

    return in_tiles(grid, channels, 1, kernel, keys, scale=(1 + down, 1 + across))


# ---- smoothing of low frequencies ----


def lf_smoothing(grid: DataFrame, channels: tuple[str, ...], scales: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adaptive smoothing: the interior only, less where any channel's change is large against its scale."""
    from tessera.operators.stencils import LF_CENTRE, LF_CORNER, LF_SIDE

    def kernel(a: np.ndarray, tile: Tile) -> np.ndarray:
        here = moved(a, 0, 0, 1)
        ring = lambda places: sum(moved(a, dy, dx, 1) for dy, dx in places)
        change = LF_CENTRE * here + LF_SIDE * ring(NEAR) + LF_CORNER * ring([(dy, dx) for dy in (-1, 1) for dx in (-1, 1)]) - here
        gap = np.maximum(0.5, (np.abs(change) / np.array(scales)[:, None, None]).max(0))
        inside = lambda at, size: ((at > 0) & (at < size - 1))[1:-1]
        inner = inside(tile.y, tile.height)[:, None] & inside(tile.x, tile.width)[None]
        return np.where(inner, here + change * np.maximum(0, 3 - 4 * gap), here)

    return in_tiles(grid, channels, 1, kernel, keys)


# ---- recurrences along rows or columns ----


def unsqueeze(squeezed: DataFrame, along: str = "x", strip: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of a squeeze along x or y: (keys, y, x, average, residual) to (keys, y, x, v).  Each second sample feeds the next pair's
    tendency, so a line is one recurrence; lines go to tasks in strips and advance side by side."""
    across = "y" if along == "x" else "x"

    def run(key: tuple, table: pa.Table) -> pa.Table:
        line, pair = (table.column(c).to_numpy().astype(np.int64) for c in (across, along))
        lines, row = np.unique(line, return_inverse=True)
        average, residual = (np.zeros((pair.max() + 1, len(lines)), np.int64) for _ in range(2))
        length = np.zeros(len(lines), np.int64)
        average[pair, row] = table.column("average").to_numpy()
        rest = table.column("residual")
        residual[pair, row] = rest.fill_null(0).to_numpy()
        np.maximum.at(length, row, 2 * pair + 1 + rest.is_valid().to_numpy())
        out = np.zeros((2 * len(average), len(lines)), np.int64)
        before = average[0]
        for k, now in enumerate(average):
            ahead = np.where(2 * (k + 1) < length, average[min(k + 1, len(average) - 1)], now)
            p, q = before - now, now - ahead
            slope = np.minimum(np.minimum((4 * np.abs(p) + 3 * np.abs(q) + 6) // 12, 2 * np.abs(p) + 1), 2 * np.abs(q))
            gap = residual[k] + np.where((p >= 0) & (q >= 0), slope, np.where((p <= 0) & (q <= 0), -slope, 0))
            first = now + np.where(gap < 0, -(-gap // 2), gap // 2)
            whole = 2 * k + 1 < length
            out[2 * k] = np.where(whole, first, now)
            out[2 * k + 1] = before = first - gap
        at, row = np.nonzero(np.arange(len(out))[:, None] < length)
        places = {along: at, across: lines[row]}
        heads = [pa.array([k.as_py()]).cast(table.schema.field(n).type).take(pa.array(np.zeros(len(at), np.int32))) for n, k in zip(keys, key)]
        return pa.table([*heads, pa.array(places["y"]), pa.array(places["x"]), pa.array(out[at, row])], [*keys, "y", "x", "v"])

    kinds = dict(squeezed.dtypes)
    lines = squeezed.select(*keys, "y", "x", "average", "residual", F.floor(F.col(across) / strip).alias("strip_"))
    return lines.groupBy(*keys, "strip_").applyInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y long, x long, v long"]))
