"""Grids over tables: a row for each sample (y, x, v ...), and packed rows for neighbourhood operators.

The two shapes of the engine: exploded samples for projections, joins and aggregations, and
rows packed as arrays, with the rows around them, for stencils and recurrences.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def large(rows: DataFrame) -> DataFrame:
    """rows to be joined by sorting: they grow with the input.  Spark guesses their size by the compressed file behind them, which may be
    below the limit of a broadcast where the rows themselves, sent through the driver, are beyond its memory."""
    return rows.hint("merge")


def orders_grid(spark: SparkSession, sf_dir: str, width: int = 125) -> DataFrame:
    """y, x, v: an 8-bit channel."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(div(k, width).alias("y"), (k % width).alias("x"), (F.floor("o_totalprice") % 256).alias("v"))


def rgb_grid(spark: SparkSession, sf_dir: str, width: int = 125) -> DataFrame:
    """y, x, a, b, c: three 8-bit channels."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(div(k, width).alias("y"), (k % width).alias("x"), (F.floor("o_totalprice") % 256).alias("a"), (F.col("o_custkey") % 256).alias("b"), (k % 256).alias("c"))


def events_grid(spark: SparkSession, sf_dir: str, width: int = 40) -> DataFrame:
    """y, x, v: a channel of wide range; u: the same in [0, 1]."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(div(k, width).alias("y"), (k % width).alias("x"), F.floor(F.col("value") * 16).alias("v"), (F.col("value") / 560.25).alias("u"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, v: 8 x 8 blocks as arrays of 64, row by row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), F.col("embedding").cast("array<double>").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, frame_idx, slot, duration, is_last: every user's events are an animation."""
    last = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("image"), F.col("event_id").alias("frame_idx"), (F.col("event_id") % 4).alias("slot"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("duration"), (F.col("event_id") == F.max("event_id").over(last)).alias("is_last")
    )


def around(grid: DataFrame, radius: int, value: str = "v", strip: int = 64) -> DataFrame:
    """y and the packed rows m2, m1, r0, p1, p2 (as far as the radius): rows y - 2 to y + 2, null beyond the grid.

    One shuffle, by strips of rows; each strip also gets the `radius` rows next to it, so
    that no neighbour is looked up across partitions and no window spans the whole grid.
    """
    ends = F.array_distinct(F.array(*(F.floor((F.col("y") + d) / strip) for d in (-radius, 0, radius))))
    spread = grid.select("y", "x", F.col(value).alias("value_"), F.explode(ends).alias("strip")).repartition("strip")
    packed = spread.groupBy("strip", "y").agg(F.sort_array(F.collect_list(F.struct("x", "value_"))).alias("cells"))
    packed = packed.select("strip", "y", F.transform("cells", lambda c: c["value_"]).alias("row_"))
    w = Window.partitionBy("strip").orderBy("y")

    def at(d: int) -> Column:
        if not d:
            return F.col("row_")
        row, y = (F.lag("row_", -d), F.lag("y", -d)) if d < 0 else (F.lead("row_", d), F.lead("y", d))
        return F.when(y.over(w) == F.col("y") + d, row.over(w))

    names = {d: f"{'m' if d < 0 else 'p' if d else 'r'}{abs(d)}" for d in range(-radius, radius + 1)}
    return packed.select("strip", "y", *(at(d).alias(n) for d, n in names.items())).where(F.col("strip") == F.floor(F.col("y") / strip)).drop("strip")


def spread_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """Packed arrays back to samples: y, x and a column for each array."""
    cells = F.arrays_zip(*(c.alias(n) for n, c in columns.items()))
    return rows.select("y", F.posexplode(cells).alias("x", "cell_")).select("y", F.col("x").cast("long").alias("x"), *(F.col(f"cell_.{n}").alias(n) for n in columns))


def get(row: Column, i: Column) -> Column:
    """Element i counted from 0, null outside."""
    return F.get(row, i)


def fixed(value: Column) -> Column:
    """Ten-thousandths as a whole number, for exact comparison."""
    return F.floor(value * 10000 + 0.5)
