"""Photon noise: a generator that any tile can start by itself, a convolution, and modulation by brightness.

The image falls into groups; each has a generator of its own, seeded by the frame's number and the group's place, so groups
are made in any order on any task.  Eight lanes run side by side, and so do all groups of one shape in a batch.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.tiles import Tile, in_tiles, moved

LANES = 8
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  #: of the seeding (fixed values)
SPREAD, CENTRE = 0.16, 4.0  #: weights of the 5 x 5 samples, and what the middle one loses (fixed values of the format)
OWN, SHARED, STRENGTH = 0.0078125, 0.9921875, 0.22  #: of each channel's noise, of the third one's, of both (fixed values of the format)
MOST = 1 << 22  #: samples that are made at a time


def scrambled(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return z ^ (z >> np.uint64(31))


def lanes_of(seed: np.ndarray) -> np.ndarray:
    """groups x lanes: each lane's state is the scrambled state of the lane before."""
    out = np.empty((len(seed), LANES), np.uint64)
    z = seed + GOLDEN
    for k in range(LANES):
        z = out[:, k] = scrambled(z)
    return out


def uniform(first: np.ndarray, second: np.ndarray, channels: int, height: int, width: int) -> np.ndarray:
    """groups x channels x height x width, from 1 to 2, of groups with these seeds."""
    per_row = -(-width // (2 * LANES))
    bits = np.empty((channels * height * per_row, len(first), LANES), np.uint64)
    a, b = lanes_of(first), lanes_of(second)
    for k in range(len(bits)):
        bits[k] = a + b
        a = a ^ (a << np.uint64(23))
        a, b = b, a ^ b ^ (a >> np.uint64(18)) ^ (b >> np.uint64(5))
    halves = np.ascontiguousarray(bits.transpose(1, 0, 2)).view("<u4").reshape(len(first), channels, height, -1)
    return 1.0 + (halves[..., :width] >> np.uint32(9)) / float(1 << 23)


def field(frames: DataFrame, keys: tuple[str, ...] = ("image",), group: int = 256) -> DataFrame:
    """frames (keys, height, width, visible, invisible: frames before) -> keys, y, x, n0, n1, n2.  Frames of no size give no row."""
    tiles = frames.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("height", "width", "visible", "invisible"))).where("height > 0 AND width > 0")
    for n, side in (("y0", "height"), ("x0", "width")):
        tiles = tiles.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(side) - 1) / group)))).withColumn(n, F.col(n) * group)
    tiles = tiles.select(*keys, "y0", "x0", F.least(F.col("height") - F.col("y0"), F.lit(group)).alias("h"), F.least(F.col("width") - F.col("x0"), F.lit(group)).alias("w"), "visible", "invisible")
    kinds = dict(tiles.dtypes)

    def run(batches):
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            number = {c: column[c].to_numpy() for c in ("y0", "x0", "h", "w", "visible", "invisible")}
            shapes = np.stack([number["h"], number["w"]], 1)
            for h, w in np.unique(shapes, axis=0).tolist():
                own = np.flatnonzero((shapes == (h, w)).all(1))
                for rows in np.array_split(own, -(-len(own) * 3 * h * w // MOST)):
                    seeds = [(number[high][rows].astype(np.uint64) << np.uint64(32)) + number[low][rows].astype(np.uint64) for high, low in (("visible", "invisible"), ("x0", "y0"))]
                    made = uniform(*seeds, 3, h, w).reshape(len(rows), 3, -1)
                    y, x = (i.reshape(-1) for i in np.indices((h, w)))
                    for r, n in zip(rows.tolist(), made):
                        heads = [pa.repeat(column[k][r], h * w) for k in keys]
                        yield pa.RecordBatch.from_arrays([*heads, pa.array(y + number["y0"][r]), pa.array(x + number["x0"][r]), *map(pa.array, n)], [*keys, "y", "x", "n0", "n1", "n2"])

    # groups are few and heavy: they go to tasks of their own
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y long, x long, n0 double, n1 double, n2 double"])
    return tiles.repartition(*keys, "y0", "x0").mapInArrow(run, schema)


def sharpened(noise: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """The field without its slow part: 5 x 5 samples, mirrored at the edges."""

    def kernel(a: np.ndarray, tile: Tile) -> np.ndarray:
        return SPREAD * sum(moved(a, dy, dx, 2) for dy in range(-2, 3) for dx in range(-2, 3)) - CENTRE * moved(a, 0, 0, 2)

    return in_tiles(noise, ("n0", "n1", "n2"), 2, kernel, keys)


def strength(v: Column, lut: Column) -> Column:
    """The table's value for a brightness: eight values a third apart; straight lines between them, and the last value beyond, from its start on."""
    scaled = F.greatest(v * 3.0, F.lit(0.0))
    low = F.least(F.floor(scaled), F.lit(7)).cast("int")
    a, b = F.get(lut, low), F.get(lut, F.least(low + 1, F.lit(7)))
    return (b - a) * (scaled - low) + a


def with_noise(grid: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("image",), channels: tuple[str, str, str] = ("x_", "y_", "b_"), correlation: tuple[float, float] = (0.0, 1.0), group: int = 256) -> DataFrame:
    """grid (keys, y, x and the channels X, Y, B) with noise; frames have `lut` (eight values) besides what `field` needs.

    Samples of unknown frames and those outside their frame are dropped; a null lut gives null samples."""
    made = sharpened(field(frames, keys, group), keys).join(frames.select(*keys, "lut"), list(keys))
    cx, cy, cb = map(F.col, channels)
    joined = grid.join(made, [*keys, "y", "x"])
    near = lambda v, n: STRENGTH * strength(v, F.col("lut")) * (OWN * F.col(n) + SHARED * F.col("n2"))
    joined = joined.withColumns({"p_": near(cy + cx, "n0"), "q_": near(cy - cx, "n1")})
    p, q = F.col("p_"), F.col("q_")
    new = (cx + correlation[0] * (p + q) + p - q, cy + p + q, cb + correlation[1] * (p + q))
    return joined.select(*keys, "y", "x", *(v.alias(c) for v, c in zip(new, channels)))
