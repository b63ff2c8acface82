"""Sample-wise operators and joins: colour transforms, palettes, blending, patches, orientation, metrics."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.bits import orient, wrap32, zigzag
from tessera.sources.grids import div, large


#: What each kind of the reversible colour transform adds to its second and to its third channel.
RCT_ADDS = {0: (None, None), 1: (None, "first"), 2: ("first", None), 3: ("first", "first"), 4: ("mean", None), 5: ("mean", "first")}
#: Which of the three results becomes which channel, by the order's number (fixed values of the format).
RCT_ORDERS = [(0, 1, 2), (2, 0, 1), (1, 2, 0), (0, 2, 1), (1, 0, 2), (2, 1, 0)]


def inverse_rct(kind: int, order: int, a: Column, b: Column, c: Column) -> list[Column]:
    """Reversible colour transform: seven kinds, six orders of the outputs; sums wrap at 32 bits."""
    if kind == 6:  # luma, and two differences: halves rounded up on one side, down on the other
        half = lambda v: F.shiftright(v, 1)
        green = wrap32(a + half(c + 1))
        blue = wrap32(green - c - half(b))
        out = wrap32(blue + b), green, blue
    else:
        second, third = RCT_ADDS[kind]
        last = wrap32(c + a) if third else c
        out = a, {None: b, "first": wrap32(b + a), "mean": wrap32(b + F.shiftright(wrap32(a + last), 1))}[second], last
    return [out[k] for k in RCT_ORDERS[order]]


def from_residual(token: Column, prediction: Column, multiplier: Column | int = 1, offset: Column | int = 0) -> Column:
    """A sample from its unsigned residual token; sums wrap at 32 bits."""
    return wrap32(zigzag(token) * multiplier + offset + prediction)


def to_float(v: Column, depth: int) -> Column:
    """Integer samples to [0, 1]."""
    return v / float((1 << depth) - 1)


def modular_xyb(y: Column, x: Column, b: Column, factors: tuple[float, float, float]) -> list[Column]:
    """x, y, b from integer channels in the order y, x, b - y; factors: those of the low frequencies, for 128 steps each."""
    both = F.least(F.greatest(b + y, F.lit(-(1 << 31))), F.lit((1 << 31) - 1))
    return [v * (f / 128) for v, f in zip((x, y, both), factors)]


def with_peak(grid: DataFrame, luminance: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """`peak`: each image's largest luminance, 0 at least; a row for each image is joined back."""
    named = grid if keys else grid.withColumn("one_", F.lit(0))
    top = named.groupBy(*(keys or ("one_",))).agg(F.greatest(F.max(luminance), F.lit(0.0)).alias("peak"))
    return named.join(top, list(keys or ("one_",))).drop("one_")


def forward_ycocg(d: Column, e: Column, f: Column) -> list[Column]:
    """What kind 6 undoes."""
    b = d - f
    t = f + F.shiftright(b, 1)
    c = e - t
    return [t + F.shiftright(c, 1), b, c]


#: The format's own deltas, that indices below 0 stand for (72 entries of three channels).
DELTAS = [
    (0, 0, 0), (4, 4, 4), (11, 0, 0), (0, 0, -13), (0, -12, 0), (-10, -10, -10), (-18, -18, -18), (-27, -27, -27), (-18, -18, 0),
    (0, 0, -32), (-32, 0, 0), (-37, -37, -37), (0, -32, -32), (24, 24, 45), (50, 50, 50), (-45, -24, -24), (-24, -45, -45), (0, -24, -24),
    (-34, -34, 0), (-24, 0, -24), (-45, -45, -24), (64, 64, 64), (-32, 0, -32), (0, -32, 0), (-32, 0, 32), (-24, -45, -24), (45, 24, 45),
    (24, -24, -45), (-45, -24, 24), (80, 80, 80), (64, 0, 0), (0, 0, -64), (0, -64, -64), (-24, -24, 45), (96, 96, 96), (64, 64, 0),
    (45, -24, -24), (34, -34, 0), (112, 112, 112), (24, -45, -45), (45, 45, -24), (0, -32, 32), (24, -24, 45), (0, 96, 96), (45, -24, 24),
    (24, -45, -24), (-24, -45, 24), (0, -64, 0), (96, 0, 0), (128, 128, 128), (64, 0, 64), (144, 144, 144), (96, 96, 0), (-36, -36, 36),
    (45, -24, -45), (45, -45, -24), (0, 0, -96), (0, 128, 128), (0, 96, 0), (45, 24, -45), (-128, 0, 0), (24, -45, 24), (-45, 24, -45),
    (64, 0, -64), (64, -64, -64), (96, 0, 96), (45, -45, 24), (24, 45, -45), (64, 64, -64), (128, 128, 0), (0, 0, -128), (-24, 45, -45),
]


def palette(grid: DataFrame, colours: DataFrame, size: int, depth: int = 8, channels: int = 3, deltas: DataFrame | None = None, keys: tuple[str, ...] = (), n_deltas: int | None = None) -> DataFrame:
    """Indices to colours: the palette (keys, idx, c, v), beyond it two implicit colour cubes, below 0 the
    format's deltas and their negatives (deltas: another table of 72 entries (idx, c, v) in their place).

    keys: images, each with its palette.  n_deltas: entries below are deltas; the column `delta` tells their samples,
    which still lack the prediction (predicted_deltas)."""
    if deltas is None:  # an inline table, of which Spark knows the size
        rows = ", ".join(f"({k}, {c}, {v})" for k, entry in enumerate(DELTAS) for c, v in enumerate(entry))
        deltas = grid.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(idx, c, v)")
    top = (1 << depth) - 1
    spread = grid.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    i = F.col("v")
    k = i - size
    small = div(div(k, F.pow(F.lit(4), F.col("c")).cast("long")) % 4 * top, 4) + (1 << max(depth - 3, 0))
    fives = div(div(k - 64, F.pow(F.lit(5), F.col("c")).cast("long")) % 5 * top, 4)
    delta = (-i - 1) % 143
    look = F.when(i >= 0, i).otherwise(-1 - div(delta + 1, 2))
    shifted = F.col("v") * (1 << max(min(depth, 24) - 8, 0))
    own = colours.select(*keys, F.col("idx").alias("look"), "c", F.col("v").alias("colour"))
    implicit = deltas.select((-1 - F.col("idx")).alias("look"), "c", shifted.alias("implicit_"))
    if keys:
        found = spread.withColumn("look", look).join(large(own), [*keys, "look", "c"], "left").join(implicit, ["look", "c"], "left")
        colour = F.coalesce("implicit_", "colour")
    else:
        found, colour = spread.withColumn("look", look).join(own.unionAll(implicit), ["look", "c"], "left"), F.col("colour")
    value = F.when(i < 0, F.when(F.col("c") >= 3, 0).when(delta % 2 == 0, -colour).otherwise(colour)).when(i < size, colour).when(k < 64, small).otherwise(fives)
    return found.select(*keys, "y", "x", "c", value.alias("v"), *([(i < n_deltas).alias("delta")] if n_deltas is not None else []))


def blend(mode: str, b: Column, n: Column, ab: Column, an: Column, clamp: bool = False) -> Column:
    """New sample n over base b, with their alphas; 0 stands for what is missing."""
    if clamp:
        an = F.greatest(F.least(an, F.lit(1.0)), F.lit(0.0))
    both = 1 - (1 - an) * (1 - ab)
    return {
        "replace": lambda: n,
        "add": lambda: b + n,
        "mul": lambda: b * (F.greatest(F.least(n, F.lit(1.0)), F.lit(0.0)) if clamp else n),
        "blend_premultiplied": lambda: n + b * (1 - an),
        "blend": lambda: F.when(both <= 0, 0.0).otherwise((an * n + ab * b * (1 - an)) / both),
        "muladd": lambda: b + an * n,
        "mixalpha": lambda: b + n * (1 - b),
        "skip": lambda: b,
    }[mode]()


def blend_frames(mode: str, base: DataFrame, new: DataFrame) -> DataFrame:
    """Frames (y, x, v, alpha) joined by coordinate; the base keeps its canvas."""
    n = new.select("y", "x", F.col("v").alias("n_"), F.col("alpha").alias("an_"))
    joined = base.join(n, ["y", "x"], "left")
    here = F.col("n_").isNotNull()
    value = blend(mode, F.col("v"), F.col("n_"), F.col("alpha"), F.col("an_"))
    return joined.select("y", "x", F.when(here, value).otherwise(F.col("v")).alias("v"))


def apply_patches(grid: DataFrame, patches: DataFrame) -> DataFrame:
    """patches (y0, x0, h, w, add): each rectangle's pixels become rows and join by coordinate; several add up."""
    pixels = patches.select("x0", "w", "add", F.explode(F.sequence("y0", F.col("y0") + F.col("h") - 1)).alias("y")).select("y", "add", F.explode(F.sequence("x0", F.col("x0") + F.col("w") - 1)).alias("x"))
    total = pixels.groupBy("y", "x").agg(F.sum("add").alias("add"))
    return grid.join(large(total), ["y", "x"], "left").select("y", "x", (F.col("v") + F.coalesce("add", F.lit(0))).alias("v"))


def oriented(grid: DataFrame, code: int, width: Column | int, height: Column | int) -> DataFrame:
    """Samples at their output coordinates; width, height: of the output, numbers or columns.  (x, y) -> source is its own kind of inverse for all but 6 and 8."""
    inverse = {6: 8, 8: 6}.get(code, code)
    w, h = (height, width) if code > 4 else (width, height)  # the grid's own size
    x, y = orient(inverse, F.col("x"), F.col("y"), F.lit(w), F.lit(h))  # lit leaves columns as they are
    return grid.select(y.alias("y"), x.alias("x"), "v")


def upsample_nearest(grid: DataFrame, factor: int) -> DataFrame:
    d = F.sequence(F.lit(0), F.lit(factor - 1))
    rows = grid.select("y", "x", "v", F.explode(d).alias("dy")).select("y", "x", "v", "dy", F.explode(d).alias("dx"))
    return rows.select((F.col("y") * factor + F.col("dy")).alias("y"), (F.col("x") * factor + F.col("dx")).alias("x"), "v")


def rle(tokens: DataFrame) -> DataFrame:
    """(y, x, v, length) to samples: place counts within the run."""
    return tokens.select("y", "x", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("place"))


def offsets(sections: DataFrame, owner: str, place: str, size: str) -> DataFrame:
    """Sections with `offset`: the sizes before them, by owner."""
    before = Window.partitionBy(owner).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def slot_references(frames: DataFrame, slots: int = 4) -> DataFrame:
    """For every frame the frame that each slot held before it: an as-of lookup by one window."""
    before = Window.partitionBy("image").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return frames.select("image", "frame_idx", *(F.last(F.when(F.col("slot") == k, F.col("frame_idx")), True).over(before).alias(f"ref{k}") for k in range(slots)))


def keyframes(frames: DataFrame) -> DataFrame:
    """keyframe, and the numbers of visible and invisible frames before each frame (the latter since the last visible one)."""
    before = Window.partitionBy("image").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    key = F.col("is_last") | (F.col("duration") != 0)
    f = frames.withColumn("keyframe", key).withColumn("visible", F.coalesce(F.count_if("keyframe").over(before), F.lit(0)))
    since = Window.partitionBy("image", "visible").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return f.withColumn("invisible", F.coalesce(F.count_if(~F.col("keyframe")).over(since), F.lit(0))).select("image", "frame_idx", "keyframe", "visible", "invisible")


def canonical_codes(symbols: DataFrame, owner: str, symbol: str, length: str) -> DataFrame:
    """Canonical prefix codes from code lengths: by length, then symbol."""
    counts = symbols.groupBy(owner, F.col(length).alias("shorter")).agg(F.count(F.lit(1)).alias("n"))
    lengths = symbols.select(owner, length).distinct()
    firsts = lengths.join(counts, owner).where(F.col("shorter") < F.col(length)).groupBy(owner, length).agg(F.sum(F.col("n") * F.pow(F.lit(2), F.col(length) - F.col("shorter")).cast("long")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(owner, length).orderBy(symbol)) - 1
    return symbols.join(firsts, [owner, length], "left").select(owner, symbol, length, (F.coalesce("first", F.lit(0)) + rank).cast("long").alias("code"))


def peak_and_rmse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest and root mean square difference of two grids where both have samples."""
    d = a.join(b.select("y", "x", F.col("v").alias("w_")), ["y", "x"]).select((F.col("v") - F.col("w_")).alias("d"))
    return d.agg(F.max(F.abs("d")).alias("peak"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
