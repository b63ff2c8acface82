"""Block metadata: blocks of variable size laid on a grid of 8 x 8 cells, and what each cell gets from its block.

A group (a square of 256 x 256 cells at most, by the format) lists its blocks without their places: each goes to the
first free cell, row by row.  The free cells of a column are always below its taken ones, so a group's state is
one number for each column.  `place` runs this recurrence group by group, all groups of all images in one
plan; a group has a bound of 65,536 cells, whatever the image.  All else is joins: blocks to cells, cells to
sharpness, cells to samples.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.operators.varblocks import CELLS

BORDER = 32  #: cells of a pass group; no block crosses its border
GROUP = 256  #: cells along a group
#: What is wrong with a block, in the order in which it is looked for; `short`: the list ends before the grid is full.
ERRORS = ("kind", "multiplier", "border", "overlap", "outside", "short")


def place(blocks: DataFrame, groups: DataFrame, keys: tuple[str, ...], idx: str = "idx", kind: str = "kind", mul: str = "mul") -> DataFrame:
    """blocks (keys, idx, kind, mul: the stored multiplier) and groups (keys, bh, bw: cells) -> keys, idx, kind, hf_mul, by, bx, error.

    Rows of a group end with its first error, if it has one: that row has no place, all others of the group no error.  Blocks that come
    when the grid is full are ignored.  A group without blocks whose grid has cells is one row of error `short`, with a null idx,
    as is the end of every list that is too short.  Blocks of unknown groups are dropped; null kinds and multipliers are errors."""
    kept = groups.select(*keys, "bh", "bw")
    rows = kept.join(blocks.select(*keys, F.col(idx).cast("long").alias("idx"), F.col(kind).cast("int").alias("kind"), F.col(mul).cast("long").alias("mul")), list(keys), "left")
    kinds = {f.name: f for f in kept.schema.fields}
    schema = T.StructType([*(kinds[k] for k in keys), *(T.StructField(n, t) for n, t in (("idx", T.LongType()), ("kind", T.IntegerType()), ("hf_mul", T.LongType()), ("by", T.IntegerType()), ("bx", T.IntegerType()), ("error", T.StringType())))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        height, width = table.column("bh")[0].as_py(), table.column("bw")[0].as_py()
        listed = table.filter(pa.compute.is_valid(table.column("idx"))).sort_by("idx")
        out = laid(zip(*(listed.column(c).to_pylist() for c in ("idx", "kind", "mul"))), height, width)
        columns = list(zip(*out)) or [[]] * 6
        arrays = [pa.array([k.as_py()] * len(out), pa.schema([table.schema.field(n)]).types[0]) for n, k in zip(keys, key)]
        return pa.table([*arrays, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string())))], schema.names)

    return rows.groupBy(*keys).applyInArrow(run, schema)


def laid(blocks, height: int, width: int) -> list[tuple]:
    """(idx, kind, hf_mul, by, bx, error) of the blocks of one group."""
    taken, out, y, x = [0] * width, [], 0, 0  # rows that are full, of each column

    def wrong(k, m, h: int, w: int) -> str | None:
        if m is None or m < 0:
            return "multiplier"
        if x % BORDER + w > BORDER or y % BORDER + h > BORDER:
            return "border"
        across = taken[x : x + w]
        if any(t > y for t in across):
            return "overlap"
        return "outside" if len(across) < w or y + h > height else None

    for idx, k, m in blocks:
        while y < height:  # the first free cell
            while x < width and taken[x] > y:
                x += 1
            if x < width:
                break
            y, x = y + 1, 0
        if y >= height or not width:
            return out
        if k is None or not 0 <= k < len(CELLS):
            return [*out, (idx, k, None, None, None, "kind")]
        h, w = CELLS[k]
        if error := wrong(k, m, h, w):
            return [*out, (idx, k, None, None, None, error)]
        taken[x : x + w] = [y + h] * w
        out.append((idx, k, m + 1, y, x, None))
        x += w
    return out if not width or min(taken) >= height else [*out, (None, None, None, None, None, "short")]


def cells(placed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, cy, cx, idx, kind, hf_mul and `first` (the block's own top left cell), a row for each cell that a block takes."""
    sizes = F.get(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in CELLS)), F.col("kind"))
    spread = placed.where("error IS NULL").withColumn("size_", sizes)
    for n, side in (("dy_", "h"), ("dx_", "w")):
        spread = spread.withColumn(n, F.explode(F.sequence(F.lit(0), F.col(f"size_.{side}") - 1)))
    return spread.select(*keys, (F.col("by") + F.col("dy_")).alias("cy"), (F.col("bx") + F.col("dx_")).alias("cx"), "idx", "kind", "hf_mul", ((F.col("dy_") == 0) & (F.col("dx_") == 0)).alias("first"))


def overlapping(cells_: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells that several blocks take (keys, cy, cx, n): none, of what `place` has laid."""
    return cells_.groupBy(*keys, "cy", "cx").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sigmas(cells_: DataFrame, sharpness: DataFrame, keys: tuple[str, ...], quant_mul: float, global_scale: int | Column, lut: tuple[float, ...]) -> DataFrame:
    """cells with `sigma` for the edge-preserving filter: sharpness (keys, cy, cx, sharpness) picks a factor of eight; null where it picks none."""
    scale = (global_scale if isinstance(global_scale, Column) else F.lit(global_scale)).cast("double")
    factor = F.get(F.array(*map(F.lit, lut)), F.col("sharpness").cast("int"))
    return cells_.join(sharpness.select(*keys, "cy", "cx", "sharpness"), [*keys, "cy", "cx"], "left").withColumn("sigma", quant_mul * 65536.0 / scale / F.col("hf_mul") * factor)


def on_image(cells_: DataFrame, group: str = "group", columns: str = "columns") -> DataFrame:
    """Cells of groups at their places in the image, which has `columns` groups in a row: cy and cx count from the image's corner."""
    across = F.col(columns)
    return cells_.withColumns({"cy": F.col("cy") + F.floor(F.col(group) / across).cast("int") * GROUP, "cx": F.col("cx") + (F.col(group) % across).cast("int") * GROUP})


def to_samples(grid: DataFrame, cells_: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...] = ("sigma",)) -> DataFrame:
    """grid (keys, y, x, ...) with columns of the cell of 8 x 8 that each sample lies in; null where no block is."""
    own = cells_.select(*keys, F.col("cy").cast("long").alias("cy_"), F.col("cx").cast("long").alias("cx_"), *columns)
    at = grid.withColumns({"cy_": F.floor(F.col("y") / 8), "cx_": F.floor(F.col("x") / 8)})
    return at.join(own, [*keys, "cy_", "cx_"], "left").drop("cy_", "cx_")
