"""Regions, and how far a stage must look beyond them: what a crop needs of each stage's input."""

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F


class Region(NamedTuple):
    left: int
    top: int
    width: int
    height: int

    @property
    def right(self) -> int:
        return self.left + self.width

    @property
    def bottom(self) -> int:
        return self.top + self.height

    def is_empty(self) -> bool:
        return self.width <= 0 or self.height <= 0

    def contains(self, other: "Region") -> bool:
        return other.is_empty() or (self.left <= other.left and self.top <= other.top and self.right >= other.right and self.bottom >= other.bottom)

    def translate(self, dx: int, dy: int) -> "Region":
        return self._replace(left=self.left + dx, top=self.top + dy)

    def intersection(self, other: "Region") -> "Region":
        left, top = max(self.left, other.left), max(self.top, other.top)
        return Region(left, top, max(0, min(self.right, other.right) - left), max(0, min(self.bottom, other.bottom) - top))

    def merge(self, other: "Region") -> "Region":
        if self.is_empty() or other.is_empty():
            return other if self.is_empty() else self
        left, top = min(self.left, other.left), min(self.top, other.top)
        return Region(left, top, max(self.right, other.right) - left, max(self.bottom, other.bottom) - top)

    def pad(self, n: int) -> "Region":
        return Region(self.left - n, self.top - n, self.width + 2 * n, self.height + 2 * n)

    def aligned(self, n: int) -> "Region":
        """The smallest region of multiples of n that contains this one."""
        left, top = self.left // n * n, self.top // n * n
        return Region(left, top, -(-self.right // n) * n - left, -(-self.bottom // n) * n - top)

    def downsample(self, factor: int) -> "Region":
        a = self.aligned(factor)
        return Region(a.left // factor, a.top // factor, a.width // factor, a.height // factor)

    def upsample(self, factor: int) -> "Region":
        return Region(*(v * factor for v in self))

    def where(self, grid: DataFrame) -> DataFrame:
        """The filter that the scan gets."""
        return grid.where(F.col("x").between(self.left, self.right - 1) & F.col("y").between(self.top, self.bottom - 1))


#: Pixels that the edge-preserving filter needs around a sample, by its iterations (fixed values of the format).
EPF_HALO = {0: 0, 1: 2, 2: 5, 3: 6}


def source_region(crop: Region, upsampling: int = 1, epf: int = 0, gabor: bool = False, chroma_subsampled: bool = False) -> Region:
    """What must be decoded so that the crop comes out as it would of the whole image."""
    need = crop
    if upsampling > 1:
        need = need.downsample(upsampling).pad(2 + (upsampling - 1) // 3)
    if epf:
        need = need.pad(EPF_HALO[epf])
    if gabor:
        need = need.pad(1)
    if chroma_subsampled:
        need = need.pad(1).aligned(2)
    return need.aligned(8) if epf else need


def groups(crop: Region, group: int, per_row: int) -> DataFrame | list[int]:
    """Numbers of the groups that a crop touches: the partitions that remain."""
    g = crop.downsample(group)
    return [y * per_row + x for y in range(max(0, g.top), g.bottom) for x in range(max(0, g.left), min(per_row, g.right))]
