"""Colour plans: a list of steps over three channels, adjacent matrices fused before Spark sees them."""

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, functions as F

from tessera.functions import colour


class Encoding(NamedTuple):
    white: tuple[float, float]
    primaries: tuple[tuple[float, float], ...]
    transfer: str


#: White points and primaries in xy chromaticity (fixed values of the standards).
D65, DCI, E_WHITE = (0.3127, 0.329), (0.314, 0.351), (1 / 3, 1 / 3)
SRGB = ((0.639998686, 0.330010138), (0.300003784, 0.600003357), (0.150002046, 0.059997204))
BT2100 = ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))
P3 = ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))

TO_LINEAR = {"linear": lambda v: v, "srgb": colour.from_srgb, "bt709": colour.from_bt709, "pq": colour.from_pq, "hlg": colour.from_hlg, "dci": lambda v: colour.gamma(v, 2.6)}
FROM_LINEAR = {"linear": lambda v: v, "srgb": colour.to_srgb, "bt709": colour.to_bt709, "pq": colour.to_pq, "hlg": colour.to_hlg, "dci": lambda v: colour.gamma(v, 1 / 2.6)}


def xyz(xy: tuple[float, float]) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def to_xyz(e: Encoding) -> np.ndarray:
    columns = np.array([xyz(p) for p in e.primaries]).T
    return columns * np.linalg.solve(columns, xyz(e.white))


def adapt(source: tuple[float, float], target: tuple[float, float]) -> np.ndarray:
    """Bradford adaptation from one white point to another."""
    m = np.array(BRADFORD)
    return np.linalg.inv(m) @ np.diag((m @ xyz(target)) / (m @ xyz(source))) @ m


class Plan:
    """Steps: ("matrix", 3 x 3) or ("each", function of a channel)."""

    def __init__(self, steps: list):
        self.steps = steps

    @classmethod
    def convert(cls, source: Encoding, target: Encoding) -> "Plan":
        if source == target:
            return cls([])
        steps = [("each", TO_LINEAR[source.transfer]), ("matrix", to_xyz(source))]
        if source.white != target.white:
            steps.append(("matrix", adapt(source.white, target.white)))
        steps += [("matrix", np.linalg.inv(to_xyz(target))), ("each", FROM_LINEAR[target.transfer])]
        if source[:2] == target[:2]:
            steps = [steps[0], steps[-1]]
        return cls(steps)

    def fused(self) -> "Plan":
        """Adjacent matrices as one; Catalyst merges expressions, not algebra."""
        out: list = []
        for kind, what in self.steps:
            if kind == "matrix" and out and out[-1][0] == "matrix":
                out[-1] = ("matrix", what @ out[-1][1])
            else:
                out.append((kind, what))
        return Plan(out)

    def apply(self, rgb: list[Column]) -> list[Column]:
        for kind, what in self.steps:
            rgb = colour.matrix([[F.lit(float(v)) for v in row] for row in what], rgb) if kind == "matrix" else [what(c) for c in rgb]
        return rgb
