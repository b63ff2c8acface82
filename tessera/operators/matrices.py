"""Dequantisation matrices: a weight for each coefficient of a block, from a few numbers for each channel.

Most weights lie on bands: the first band's value is given, each further one relative to the one before, and between bands
weights are interpolated geometrically by the coefficient's distance from the corner.  Tables:

* bands: set, channel, grid, band, v (grid 0: the set's own; sets of the corner transform have 1: its 4 x 4, and 2: its frequencies)
* params: set, channel, values (array; what the special transforms of 8 x 8 need besides)

Both may have image keys in front: then every image has its own matrices.  Bands become arrays (17 numbers at most, by the
format), cells of all sets meet them by one equi-join, so all matrices of all images are one plan.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.operators.varblocks import CELLS

#: The set of each kind of block, and each set's rows and columns (fixed values of the format).
SET_OF_KIND = (0, 1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10, 10, 10, 11, 12, 12, 13, 14, 14, 15, 16, 16)
SHAPES = ((8, 8), (8, 8), (8, 8), (8, 8), (16, 16), (32, 32), (8, 16), (8, 32), (16, 32), (8, 8), (8, 8), (64, 64), (32, 64), (128, 128), (64, 128), (256, 256), (128, 256))
HORNUSS, DCT2, DCT4, DCT4X8, AFV = 1, 2, 3, 9, 10

#: Default bands of the three channels, first those of the sets of cosines up to 32 x 32 (fixed values of the format).
BANDS = {
    0: ((3150.0, 0.0, -0.4, -0.4, -0.4, -2.0), (560.0, 0.0, -0.3, -0.3, -0.3, -0.3), (512.0, -2.0, -1.0, 0.0, -1.0, -2.0)),
    4: ((8996.873, -1.3000778, -0.4942453, -0.43909377, -0.6350102, -0.9017726, -1.6162099), (3191.4836, -0.67424583, -0.80745816, -0.4492584, -0.3586544, -0.3132239, -0.37615025), (1157.504, -2.0531423, -1.4, -0.5068713, -0.4270873, -1.4856834, -4.920914)),
    5: ((15718.408, -1.025, -0.98, -0.9012, -0.4, -0.48819396, -0.421064, -0.27), (7305.7637, -0.8041958, -0.76330364, -0.5566038, -0.49785304, -0.43699592, -0.40180868, -0.27321684), (3803.5317, -3.0607336, -2.041327, -2.023565, -0.54953897, -0.4, -0.4, -0.3)),
    6: ((7240.7734, -0.7, -0.7, -0.2, -0.2, -0.2, -0.5), (1448.1547, -0.5, -0.5, -0.5, -0.2, -0.2, -0.2), (506.85413, -1.4, -0.2, -0.5, -0.5, -1.5, -3.6)),
    7: ((16283.249, -1.7812846, -1.6309059, -1.0382179, -0.85, -0.7, -0.9, -1.2360638), (5089.1577, -0.3200494, -0.3536285, -0.3034, -0.61, -0.5, -0.5, -0.6), (3397.7761, -0.32132736, -0.3450762, -0.7034, -0.9, -1.0, -1.0, -1.1754606)),
    8: ((13844.971, -0.971138, -0.658, -0.42026, -0.22712, -0.2206, -0.226, -0.6), (4798.964, -0.6112531, -0.8377079, -0.7901486, -0.26927274, -0.38272768, -0.22924222, -0.20719099), (1807.2369, -1.2, -1.2, -0.7, -0.7, -0.7, -0.4, -0.5)),
}
#: The larger sets have first bands of their own and share all others (fixed values of the format).
LARGE = {11: (23966.166, 8380.191, 4493.024), 12: (15358.898, 5597.3604, 2919.9617), 13: (47932.332, 16760.383, 8986.048), 14: (30717.797, 11194.721, 5839.9233), 15: (95864.664, 33520.766, 17972.096), 16: (61435.594, 24209.441, 12979.847)}
LARGE_REST = ((-1.025, -0.78, -0.65012, -0.19041574, -0.20819396, -0.421064, -0.32733846), (-0.30419582, -0.36330363, -0.3566038, -0.34430745, -0.33699593, -0.30180866, -0.27321684), (-1.2, -1.2, -0.8, -0.7, -0.7, -0.4, -0.5))
#: Bands of 4 x 8 and of 4 x 4, and the numbers of the special sets (fixed values of the format).
BANDS_4X8 = ((2198.0505, -0.96269625, -0.7619425, -0.65511405), (764.36554, -0.926302, -0.967523, -0.2784529), (527.10754, -1.4594386, -1.4500821, -1.5843723))
BANDS_4X4 = ((2200.0, 0.0, 0.0, 0.0), (392.0, 0.0, 0.0, 0.0), (112.0, -0.25, -0.25, -0.5))
PARAMS = {
    HORNUSS: ((280.0, 3160.0, 3160.0), (60.0, 864.0, 864.0), (18.0, 200.0, 200.0)),
    DCT2: ((3840.0, 2560.0, 1280.0, 640.0, 480.0, 300.0), (960.0, 640.0, 320.0, 180.0, 140.0, 120.0), (640.0, 320.0, 128.0, 64.0, 32.0, 16.0)),
    DCT4: ((1.0, 1.0),) * 3,
    DCT4X8: ((1.0,),) * 3,
    AFV: ((3072.0, 3072.0, 256.0, 256.0, 256.0), (1024.0, 1024.0, 50.0, 50.0, 50.0), (384.0, 384.0, 12.0, 12.0, 12.0)),
}
AFV_BANDS = ((414.0, 0.0, 0.0, 0.0), (58.0, 0.0, 0.0, 0.0), (22.0, -0.25, -0.25, -0.25))
#: Frequencies of the corner's sixteen functions; the first and the last band lie at the third and at the last (fixed values of the format).
AFV_FREQUENCIES = (0.0, 0.0, 0.8517779, 5.3777843, 0.0, 0.0, 4.734748, 5.4492455, 1.659827, 4.0, 7.275749, 10.423227, 2.6629324, 7.6306577, 8.962389, 12.971662)
MARGIN = 1e-6  #: keeps the farthest coefficient below the last band


def default_lists() -> dict[tuple[int, int], tuple]:
    """(set, grid) -> the bands of the three channels."""
    large = {(s, 0): tuple((first, *rest) for first, rest in zip(firsts, LARGE_REST)) for s, firsts in LARGE.items()}
    return {(s, 0): v for s, v in BANDS.items()} | large | {(DCT4, 0): BANDS_4X4, (DCT4X8, 0): BANDS_4X8, (AFV, 0): BANDS_4X8, (AFV, 1): BANDS_4X4, (AFV, 2): AFV_BANDS}


def default_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """bands and params of the format, as inline tables."""
    bands = ", ".join(f"({s}, {c}, {g}, {k}, {v!r}D)" for (s, g), channels in sorted(default_lists().items()) for c, values in enumerate(channels) for k, v in enumerate(values))
    params = ", ".join(f"({s}, {c}, array({', '.join(f'{v!r}D' for v in values)}))" for s, channels in PARAMS.items() for c, values in enumerate(channels))
    return spark.sql(f"SELECT * FROM VALUES {bands} AS t(set, channel, grid, band, v)"), spark.sql(f"SELECT * FROM VALUES {params} AS t(set, channel, values)")


def levels(bands: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, set, channel, grid, levels: the values of all bands."""
    step = F.when(F.col("band") == 0, F.col("v")).when(F.col("v") > 0, 1 + F.col("v")).otherwise(1 / (1 - F.col("v")))
    whole = Window.partitionBy(*keys, "set", "channel", "grid").orderBy("band")
    values = bands.select(*keys, "set", "channel", "grid", "band", F.product(step).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("level"))
    return values.groupBy(*keys, "set", "channel", "grid").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "level"))), lambda b: b["level"]).alias("levels"))


def interpolated(levels_: Column, place: Column) -> Column:
    """The value at a place from 0 to 1: between two bands the ratio of their values to the power of the way gone."""
    scaled = place * (F.size(levels_) - 1)
    low = F.floor(scaled).cast("int")
    a, b = F.get(levels_, low), F.get(levels_, low + 1)
    return F.when(F.size(levels_) == 1, F.get(levels_, F.lit(0))).otherwise(a * F.pow(b / a, scaled - low))


def set_cells(spark: SparkSession) -> DataFrame:
    """set, y, x, grid and place (in the grid's bands) of every coefficient of every set."""
    shapes = ", ".join(f"({s}, {h}, {w})" for s, (h, w) in enumerate(SHAPES))
    cells = spark.sql(f"SELECT * FROM VALUES {shapes} AS t(set, h, w)")
    for n, side in (("y", "h"), ("x", "w")):
        cells = cells.withColumn(n, F.explode(F.sequence(F.lit(0), F.col(side) - 1)))
    y, x, s = F.col("y"), F.col("x"), F.col("set")
    half = lambda v: F.floor(v / 2)
    odd_row, odd_column = y % 2 == 1, x % 2 == 1
    grid = F.when((s == AFV) & ~odd_row, F.when(odd_column, 1).otherwise(2)).otherwise(0)
    small = (s == DCT4) | (s == AFV) & ~odd_row
    down = F.when(small | (s == DCT4X8) | (s == AFV), half(y) / 3).otherwise(y / (F.col("h") - 1))
    along = F.when(small, half(x) / 3).otherwise(x / (F.col("w") - 1))
    frequency = F.get(F.array(*map(F.lit, AFV_FREQUENCIES)), (half(y) * 4 + half(x)).cast("int"))
    first, last = AFV_FREQUENCIES[2], AFV_FREQUENCIES[15]
    place = F.when(grid == 2, F.greatest(frequency - first, F.lit(0.0)) / (last - first + MARGIN)).otherwise(F.sqrt(along * along + down * down) / (math.sqrt(2) + MARGIN))
    return cells.select("set", "y", "x", grid.alias("grid"), place.alias("place"))


def matrices(bands: DataFrame, params: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, set, channel, y, x, weight: what a coefficient is multiplied with, for all sets that bands or params have."""
    spark, y, x, s = bands.sparkSession, F.col("y"), F.col("x"), F.col("set")
    p = lambda k: F.get("values", F.lit(k) if isinstance(k, int) else k)
    at = lambda row, column: (y == row) & (x == column)
    on = [*keys, "set", "channel"]
    lists = levels(bands, keys)
    wanted = lists.select(*on).union(params.select(*on)).distinct()
    cells = wanted.join(set_cells(spark), "set").join(lists, [*on, "grid"], "left").join(params.select(*on, "values"), on, "left")

    far = F.greatest(y, x)
    octave = F.floor(F.log2(F.greatest(far, F.lit(1)).cast("double"))).cast("int")
    square = 2 * octave + F.when(F.least(y, x) >= F.pow(F.lit(2.0), octave), 1).otherwise(0)
    banded = interpolated(F.col("levels"), F.col("place"))
    weight = (
        F.when(at(0, 0) & s.isin(HORNUSS, DCT2, AFV), 1.0)
        .when(s == HORNUSS, F.when(at(0, 1) | at(1, 0), p(1)).when(at(1, 1), p(2)).otherwise(p(0)))
        .when(s == DCT2, p(square.cast("int")))
        .when(s == DCT4, F.when(at(0, 1) | at(1, 0), banded / p(0)).when(at(1, 1), banded / p(1)).otherwise(banded))
        .when(s == DCT4X8, F.when(at(1, 0), banded / p(0)).otherwise(banded))
        .when(s == AFV, F.when(at(1, 0), p(0)).when(at(0, 1), p(1)).when(at(2, 0), p(2)).when(at(0, 2), p(3)).when(at(2, 2), p(4)).otherwise(banded))
        .otherwise(banded)
    )
    return cells.select(*on, "y", "x", (1 / weight).alias("weight"))


def wrong(matrices_: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, set, channel of matrices with a weight that is missing, not positive or too large (10^8 and more)."""
    good = (F.col("weight") > 0) & (F.col("weight") < 1e8)
    return matrices_.where(~F.coalesce(good, F.lit(False))).select(*keys, "set", "channel").distinct()


def dequantised(blocks: DataFrame, matrices_: DataFrame, kind: str = "kind", channel: str = "channel", value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocks (keys, kind, channel, array of coefficients) with each coefficient times its weight; blocks that are higher than wide use the matrix on its side.

    A matrix is one array (the format bounds it); null where the block's matrix is missing."""
    across = F.get(F.array(*(F.lit(h > w) for h, w in CELLS)), F.col(kind))
    sides = F.explode(F.array(F.lit(False), F.lit(True)))
    cells = matrices_.select(*keys, "set", F.col("channel").alias("channel_"), "weight", "y", "x", sides.alias("side_"))
    place = F.when(F.col("side_"), F.struct("x", "y", "weight")).otherwise(F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "weight"))
    arrays = cells.groupBy(*keys, "set", "channel_", "side_").agg(F.transform(F.sort_array(F.collect_list(place)), lambda c: c["weight"]).alias("weights_"))
    own = blocks.withColumns({"set": F.get(F.array(*map(F.lit, SET_OF_KIND)), F.col(kind)), "side_": across, "channel_": F.col(channel)})
    joined = own.join(arrays, [*keys, "set", "channel_", "side_"], "left")
    made = F.when(F.col("weights_").isNotNull(), F.transform(F.col(value), lambda v, k: v * F.get("weights_", k)))
    return joined.withColumn(value, made).select(*blocks.columns)
