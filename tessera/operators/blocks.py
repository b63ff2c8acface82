"""Operators on 8 x 8 blocks held as arrays: transforms, dequantisation, coefficient order."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SQRT2 = math.sqrt(2)


def basis(n: int = 8) -> list[list[float]]:
    """Row k: the k-th cosine at the n places, scaled as the inverse transform needs it."""
    return [[1.0 if k == 0 else SQRT2 * math.cos(math.pi * k * (2 * i + 1) / (2 * n)) for i in range(n)] for k in range(n)]


def linear(matrix: list[list[float]], values: list[Column]) -> list[Column]:
    out = []
    for row in matrix:
        terms = [v * w for w, v in zip(row, values) if w]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        out.append(total)
    return out


def two_passes(v: Column, matrix: list[list[float]]) -> Column:
    """matrix applied to the rows of an 8 x 8 block, then to the columns."""
    n = len(matrix)
    rows = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(*linear(matrix, [F.get(v, i * n + k) for k in range(n)])))
    held = F.transform(F.array(rows), lambda r: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda p: sum_of([F.get(F.get(r, F.lit(k)), (p % n)) * F.get(F.array(*[F.lit(matrix[i][k]) for i in range(n)]), F.floor(p / n).cast("int")) for k in range(n)])))
    return F.get(held, F.lit(0))


def sum_of(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def inverse_dct(v: Column) -> Column:
    """x[n] = c[0] + sqrt(2) sum c[k] cos(pi k (2n + 1) / 16), over both axes."""
    b = basis()
    return two_passes(v, [[b[k][i] for k in range(8)] for i in range(8)])


def forward_dct(v: Column) -> Column:
    return two_passes(v, [[x / 8 for x in row] for row in basis()])


def haar_map() -> np.ndarray:
    """64 x 64: corners of 2 x 2, then 4 x 4, then 8 x 8 coefficients become sums and differences, each four a square of four."""
    sign = np.array([[1, 1], [1, -1]])
    whole = np.eye(64)
    for half in (1, 2, 4):
        level = np.eye(64).reshape(8, 8, 8, 8)
        y, x, i, j, p, q = np.indices((half, half, 2, 2, 2, 2))
        level[: 2 * half, : 2 * half] = 0
        level[2 * y + i, 2 * x + j, y + half * p, x + half * q] = sign[j, p] * sign[i, q]
        whole = level.reshape(64, 64) @ whole
    return whole


def haar(v: Column) -> Column:
    """The special transform of sums and differences on an 8 x 8 block."""
    return F.array(*linear(haar_map().tolist(), [F.get(v, F.lit(k)) for k in range(64)]))


def exploded(blocks: DataFrame) -> DataFrame:
    """block, i, j, v."""
    return blocks.select("block", F.posexplode("v").alias("n", "v")).select("block", F.floor(F.col("n") / 8).alias("i"), (F.col("n") % 8).cast("long").alias("j"), "v")


#: Default channel factors of the low frequencies, and bias and numerator of the high ones (fixed values of the format).
LF_FACTORS = {"x": 1 / 32, "y": 1 / 4, "b": 1 / 2}
HF_BIAS = {"x": 1 - 0.05465007330715401, "y": 1 - 0.07005449891748593, "b": 1 - 0.049935103337343655}
HF_NUMERATOR = 0.145


def dequant_lf(q: Column, channel: str, global_scale: int, quant_lf: int, precision: int = 0) -> Column:
    return q * (LF_FACTORS[channel] * 2 ** (9 - precision)) / (global_scale * quant_lf)


def dequant_hf(q: Column, channel: str, weight: Column, global_scale: int, multiplier: Column, qm_scale: int = 2) -> Column:
    unbiased = F.when(F.abs(q) <= 1, q * HF_BIAS[channel]).otherwise(q - HF_NUMERATOR / q)
    return unbiased * weight * (65536.0 / (global_scale * multiplier)) * (1.0 if channel == "y" else 0.8 ** (qm_scale - 2))


def natural_order(n: int = 8) -> list[tuple[int, int]]:
    """Coefficients (row, column) by anti-diagonals of alternating direction, from the lowest frequency on."""
    cells = [(y, x) for y in range(n) for x in range(n)]
    return sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
