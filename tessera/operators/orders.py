"""Coefficient orders of all shapes of blocks as a table, with coded permutations, joined to coefficients."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows and columns of the coefficients of each order (fixed values of the format; the longer side lies across).
SHAPES = [(8, 8), (8, 8), (16, 16), (32, 32), (8, 16), (8, 32), (16, 32), (64, 64), (32, 64), (128, 128), (64, 128), (256, 256), (128, 256)]


def natural_orders(spark: SparkSession) -> DataFrame:
    """(order_id, place, y, x) for every coefficient of the 13 shapes (131,264 rows): the corner that holds the low
    frequencies row by row, then anti-diagonals of alternating direction of the square on the longer side."""

    def of(side: int) -> Column:
        return F.get(F.array(*(F.lit(shape[side]) for shape in SHAPES)), F.col("order_id"))

    shapes = spark.range(len(SHAPES)).select(F.col("id").cast("int").alias("order_id")).withColumns({"h": of(0), "w": of(1)})
    cells = shapes.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)))
    cells = cells.withColumns({"y": F.floor(F.col("n") / F.col("w")), "x": (F.col("n") % F.col("w")).cast("long")})
    cells = cells.withColumns({"far": F.col("y") * F.floor(F.col("w") / F.col("h")), "low": (8 * F.col("y") < F.col("h")) & (8 * F.col("x") < F.col("w"))})
    line = F.col("x") + F.col("far")
    order = Window.partitionBy("order_id").orderBy(~F.col("low"), F.when(F.col("low"), F.col("n")).otherwise(line), F.when(line % 2 == 1, F.col("far")).otherwise(F.col("x")))
    return cells.select("order_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "y", "x")


def coded_orders(natural: DataFrame, permutations: DataFrame, channels: int = 3) -> DataFrame:
    """(order_id, channel, place, y, x): permutations (order_id, channel, place, source) send the natural order's
    coefficient `source` to a place; places, channels and orders that they do not name keep the natural order."""
    each = natural.select("order_id", "place", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"))
    each = each.join(permutations.select("order_id", "channel", "place", "source"), ["order_id", "channel", "place"], "left")
    at = natural.withColumnRenamed("place", "source")
    return each.withColumn("source", F.coalesce("source", "place")).join(at, ["order_id", "source"]).select("order_id", "channel", "place", "y", "x")


def placed(coefficients: DataFrame, orders: DataFrame) -> DataFrame:
    """Coefficients (order_id, channel, place, and others) with their row y and column x.  The format bounds the table
    of orders (131,264 rows a channel), so it goes to all tasks; coefficients are not shuffled."""
    return coefficients.join(F.broadcast(orders), ["order_id", "channel", "place"])
