"""Blocks of variable size: the 27 transforms of coefficients to samples, from 8 x 8 to 256 x 256.

A block is a row: its kind and its coefficients as an array, row by row.  A batch of rows is sorted by kind, and
the blocks of one kind go through one product of matrices; nothing is shuffled, and images are told apart by other
columns, which are kept.  `placed` turns blocks into samples.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Height and width in cells of 8 x 8 of each kind, by its number (fixed values of the format).
CELLS = (
    (1, 1), (1, 1), (1, 1), (1, 1), (2, 2), (4, 4), (2, 1), (1, 2), (4, 1), (1, 4), (4, 2), (2, 4), (1, 1), (1, 1),
    (1, 1), (1, 1), (1, 1), (1, 1), (8, 8), (8, 4), (4, 8), (16, 16), (16, 8), (8, 16), (32, 32), (32, 16), (16, 32),
)
DCT8, HORNUSS, DCT2, DCT4, DCT4X8, DCT8X4, AFV = 0, 1, 2, 3, 12, 13, (14, 15, 16, 17)
MOST = 1 << 20  #: samples that are made and given back at a time


@lru_cache
def cosines(n: int) -> np.ndarray:
    """n x n: samples by frequencies."""
    k, i = np.arange(n), np.arange(n)[:, None]
    return np.where(k == 0, 1.0, math.sqrt(2) * np.cos(math.pi * k * (2 * i + 1) / (2 * n)))


def inverse(c: np.ndarray) -> np.ndarray:
    """Samples of coefficients, over the last two axes."""
    return cosines(c.shape[-2]) @ c @ cosines(c.shape[-1]).T


def forward(s: np.ndarray) -> np.ndarray:
    """Coefficients of samples, over the last two axes: the means of what `inverse` adds."""
    h, w = s.shape[-2:]
    return cosines(h).T @ s @ cosines(w) / (h * w)


def shrinkage(n: int) -> np.ndarray:
    """What the mean of eight samples leaves of each of the n lowest frequencies of 8 n samples."""
    a = math.pi * np.arange(n) / (16 * n)
    return np.divide(np.sin(8 * a), 8 * np.sin(a), out=np.ones(n), where=a > 0)


def low_frequencies(lf: np.ndarray) -> np.ndarray:
    """The lowest h x w coefficients of a block of h x w cells, of which lf are the means."""
    h, w = lf.shape[-2:]
    return forward(lf) / (shrinkage(h)[:, None] * shrinkage(w))


# ---- the special transforms of one cell ----

HAAR = np.array([[1.0, 1.0], [1.0, -1.0]])
#: Of the 4 x 4 corner without its own corner and that one's two neighbours: which eigenvector of the grid's
#: Laplacian, by ascending eigenvalue, each row of the basis is, and the sign of its first component (fixed values).
AFV_ROWS = {2: (1, 1), 3: (6, -1), 6: (5, -1), 7: (7, -1), 8: (2, 1), 9: (4, 1), 10: (8, 1), 11: (11, -1), 12: (3, -1), 13: (9, -1), 14: (10, -1), 15: (12, 1)}
AFV_CORNER, AFV_NEXT = 0.876902929799142, 0.2206518106944235  #: row 1: the corner, and its two neighbours (fixed values)


@lru_cache(1)
def afv_basis() -> np.ndarray:
    """16 x 16, orthonormal: the mean, three functions of the corner's pixels, and the modes of the other thirteen."""
    place = [(y, x) for y in range(4) for x in range(4)]
    rest = [k for k, p in enumerate(place) if p not in ((0, 0), (0, 1), (1, 0))]
    near = np.array([[sum(map(abs, np.subtract(place[a], place[b]))) == 1 for b in rest] for a in rest], float)
    _, modes = np.linalg.eigh(np.diag(near.sum(1)) - near)
    basis = np.zeros((16, 16))
    basis[0] = 0.25
    basis[1] = -(AFV_CORNER + 2 * AFV_NEXT) / 13
    basis[1, [0, 1, 4]] = AFV_CORNER, AFV_NEXT, AFV_NEXT
    basis[4, [1, 4]] = -math.sqrt(0.5), math.sqrt(0.5)
    for row, (k, sign) in AFV_ROWS.items():
        basis[row, rest] = modes[:, k] * np.sign(modes[0, k]) * sign
    left = np.eye(16)[0] - basis[:5].T @ basis[:5, 0]  # what of the corner no other row has
    basis[5] = -left / np.linalg.norm(left)
    return basis


def with_sums(c: np.ndarray) -> np.ndarray:
    """The 2 x 2 lowest coefficients as sums and differences."""
    c = c.copy()
    c[..., :2, :2] = HAAR @ c[..., :2, :2] @ HAAR
    return c


def in_quarters(quarter) -> np.ndarray:
    """8 x 8 of four 4 x 4, by quarter(y, x)."""
    return np.concatenate([np.concatenate([quarter(y, x) for x in (0, 1)], -1) for y in (0, 1)], -2)


def dct2(c: np.ndarray) -> np.ndarray:
    for n in (1, 2, 4):
        sub = c[..., : 2 * n, : 2 * n].reshape(*c.shape[:-2], 2, n, 2, n)
        c = c.copy()
        c[..., : 2 * n, : 2 * n] = np.einsum("ip,...pyqx,qj->...yixj", HAAR, sub, HAAR).reshape(*c.shape[:-2], 2 * n, 2 * n)
    return c


def dct4(c: np.ndarray) -> np.ndarray:
    c = with_sums(c)
    return in_quarters(lambda y, x: inverse(c[..., y::2, x::2].swapaxes(-1, -2)))


def hornuss(c: np.ndarray) -> np.ndarray:
    c = with_sums(c)

    def quarter(y: int, x: int) -> np.ndarray:
        s = c[..., y::2, x::2].copy()
        mean = s[..., 0, 0] - (s.sum((-1, -2)) - s[..., 0, 0]) / 16
        s[..., 0, 0], s[..., 1, 1] = s[..., 1, 1], 0
        return s + mean[..., None, None]

    return in_quarters(quarter)


def dct4x8(c: np.ndarray) -> np.ndarray:
    """Two halves of 4 x 8, one above the other."""
    c = c.copy()
    c[..., :2, 0] = c[..., :2, 0] @ HAAR
    return np.concatenate([inverse(c[..., 0::2, :]), inverse(c[..., 1::2, :])], -2)


def dct8x4(c: np.ndarray) -> np.ndarray:
    """Two halves of 8 x 4, side by side."""
    return dct4x8(c).swapaxes(-1, -2)


def afv(c: np.ndarray, flip_y: int, flip_x: int) -> np.ndarray:
    """One corner by the basis above, the 4 x 4 beside it and the other half by cosines."""
    mean, along, below = c[..., 0, 0], c[..., 0, 1], c[..., 1, 0]
    corner, beside, half = c[..., 0::2, 0::2].copy(), c[..., 0::2, 1::2].copy(), c[..., 1::2, :].copy()
    corner[..., 0, 0], beside[..., 0, 0], half[..., 0, 0] = 4 * (mean + along + below), mean - along + below, mean - below
    corner = (corner.reshape(*c.shape[:-2], 16) @ afv_basis()).reshape(corner.shape)
    corner = corner[..., :: -1 if flip_y else 1, :: -1 if flip_x else 1]
    beside = inverse(beside.swapaxes(-1, -2))
    row = np.concatenate([beside, corner] if flip_x else [corner, beside], -1)
    return np.concatenate([inverse(half), row] if flip_y else [row, inverse(half)], -2)


SPECIAL = {HORNUSS: hornuss, DCT2: dct2, DCT4: dct4, DCT4X8: dct4x8, DCT8X4: dct8x4} | {k: (lambda c, n=n: afv(c, n // 2, n % 2)) for n, k in enumerate(AFV)}


def samples_of(kind: int, coefficients: np.ndarray, lf: np.ndarray | None = None) -> np.ndarray:
    """Samples of blocks of one kind (blocks x height x width); lf: the means of their cells, which give the lowest coefficients."""
    h, w = CELLS[kind]
    c = coefficients.copy()
    if lf is not None:
        c[:, :h, :w] = low_frequencies(lf)
    return SPECIAL.get(kind, inverse)(c)


def pieces(kinds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with MOST samples at most, and one block more."""
    area = np.array([64 * h * w for h, w in CELLS] + [0])
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(area[kinds]) // MOST)) + 1).tolist(), len(kinds)]
    return list(zip(edges, edges[1:]))


def transformed(blocks: DataFrame, kind: str = "kind", coefficients: str = "v", lf: str | None = None) -> DataFrame:
    """Blocks with samples in place of their coefficients; lf: an array column with the means of each block's cells.

    Missing coefficients at the end of an array, and null ones, are 0.  A null kind, one that is no number of a kind, and a null array give a null block."""
    kept = [f for f in blocks.schema.fields if f.name not in (coefficients, lf)]
    schema = T.StructType([*kept, T.StructField(coefficients, T.ArrayType(T.DoubleType()))])

    def filled(lists: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
        """Arrays of the rows, each with 0 for what is null or missing."""
        out = np.zeros((len(rows), size))
        for k, r in enumerate(rows.tolist()):
            own = lists[r].values.to_numpy(zero_copy_only=False)[:size]
            out[k, : len(own)] = np.nan_to_num(own) if own.dtype != object else [x or 0.0 for x in own]
        return out

    def run(batches):
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index(kind)).cast(pa.int64()).fill_null(-1).to_numpy()
            kinds = np.where((kinds >= 0) & (kinds < len(CELLS)), kinds, -1)
            for start, stop in pieces(kinds):
                yield made(batch.slice(start, stop - start), kinds[start:stop])

    def made(batch: pa.RecordBatch, kinds: np.ndarray) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        values, means = column(coefficients), column(lf) if lf else None
        there = values.is_valid() if means is None else pa.compute.and_(values.is_valid(), means.is_valid())
        kinds = np.where(there.to_numpy(zero_copy_only=False), kinds, -1)
        found: list = [None] * batch.num_rows
        for k in np.unique(kinds[kinds >= 0]).tolist():
            h, w = CELLS[k]
            rows = np.flatnonzero(kinds == k)
            c = filled(values, rows, 64 * h * w).reshape(-1, 8 * h, 8 * w)
            s = samples_of(k, c, None if means is None else filled(means, rows, h * w).reshape(-1, h, w))
            for r, x in zip(rows.tolist(), s.reshape(len(rows), -1)):
                found[r] = x
        return pa.RecordBatch.from_arrays([*(column(f.name) for f in kept), pa.array(found, pa.list_(pa.float64()))], schema.names)

    return blocks.withColumn(coefficients, F.col(coefficients).cast("array<double>")).mapInArrow(run, schema)


def width_of(kind: str = "kind"):
    """8 times the cells of a kind's width."""
    return F.get(F.array(*(F.lit(8 * w) for _, w in CELLS)), F.col(kind))


def placed(blocks: DataFrame, kind: str = "kind", value: str = "v", y0: str | None = None, x0: str | None = None) -> DataFrame:
    """A row for each sample: the other columns, y, x and the value; y0, x0: the block's place in samples, if it has one."""
    rest = [c for c in blocks.columns if c not in (value, y0, x0)]
    cells = blocks.select("*", F.posexplode(value).alias("n_", "s_")).withColumn("w_", width_of(kind))
    at = {"y": F.floor(F.col("n_") / F.col("w_")), "x": F.col("n_") % F.col("w_")}
    return cells.select(*rest, *((at[c].cast("long") + (F.col(o) if o else 0)).alias(c) for c, o in (("y", y0), ("x", x0))), F.col("s_").alias(value))


def line_transform(lines: DataFrame, value: str = "v", height: str = "h", width: str = "w", back: bool = False) -> DataFrame:
    """The cosine transform of arrays of height x width samples (any sizes), or its inverse, as one plan for all sizes."""
    schema = T.StructType([*(f for f in lines.schema.fields if f.name != value), T.StructField(value, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            sizes = np.stack([column(c).cast(pa.int64()).to_numpy() for c in (height, width)], 1)
            found: list = [None] * batch.num_rows
            for h, w in np.unique(sizes, axis=0).tolist():
                rows = np.flatnonzero((sizes == (h, w)).all(1)).tolist()
                stack = np.stack([column(value)[r].values.to_numpy(zero_copy_only=False) for r in rows]).reshape(-1, h, w)
                for r, x in zip(rows, (inverse if back else forward)(stack).reshape(len(rows), -1)):
                    found[r] = x
            yield pa.RecordBatch.from_arrays([*(column(f.name) for f in schema if f.name != value), pa.array(found, pa.list_(pa.float64()))], schema.names)

    return lines.mapInArrow(run, schema)
