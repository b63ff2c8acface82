"""Registered queries of squeeze schedules."""

from pyspark.sql import functions as F

from tessera.operators import squeeze as Q
from tessera.queries import query
from tessera.sources.grids import div, table


@query(
    "squeeze_default_steps",
    """WITH RECURSIVE im AS (SELECT c_custkey AS image, 1 + c_custkey * 7 % 300 AS h, 1 + c_custkey * 13 % 200 AS w, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS n FROM customer),
s AS (SELECT image, h, w, n, 0 AS phase, NULL::BOOLEAN AS horizontal, 0 AS k FROM im
  UNION ALL SELECT image, CASE WHEN e = false THEN (h + 1) // 2 ELSE h END, CASE WHEN e THEN (w + 1) // 2 ELSE w END, n, CASE WHEN phase = 1 THEN 2 ELSE 1 END, e, k + 1 FROM (
    SELECT *, CASE phase WHEN 0 THEN CASE WHEN h >= w AND h > 8 THEN false END WHEN 1 THEN CASE WHEN w > 8 THEN true END ELSE CASE WHEN h > 8 THEN false END END AS e FROM s WHERE w > 8 OR h > 8)),
l AS (SELECT image, k, 0 AS begin_, n, true AS in_place, horizontal FROM s WHERE horizontal IS NOT NULL UNION ALL SELECT image, -2, 1, 2, false, true FROM im WHERE n = 3 UNION ALL SELECT image, -1, 1, 2, false, false FROM im WHERE n = 3)
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY k) - 1 AS INT) AS step, begin_ AS "begin", n, in_place, horizontal FROM l""",
)
def _(spark, d):
    k = F.col("c_custkey")
    images = table(spark, d, "customer").select(k.alias("image"), (1 + k * 7 % 300).alias("height"), (1 + k * 13 % 200).alias("width"), F.explode(F.when(k % 2 == 0, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0)))).alias("position"))
    return Q.default_steps(images)


@query(
    "squeeze_there_and_back",
    "SELECT o_orderkey // 400 AS image, CAST(c AS INT) AS c, o_orderkey % 400 // 20 AS y, o_orderkey % 20 AS x, CASE c WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 256 WHEN 1 THEN o_custkey % 256 ELSE o_orderkey % 256 END AS v FROM orders, (SELECT unnest([0, 1, 2]) AS c)",
)
def _(spark, d):
    """400 orders are an image of three channels; all steps of the default schedule, and back."""
    k = F.col("o_orderkey")
    values = F.array((F.floor("o_totalprice") % 256).cast("long"), F.col("o_custkey") % 256, k % 256)
    samples = table(spark, d, "orders").select(div(k, 400).alias("image"), F.posexplode(values).alias("id", "v"), div(k % 400, 20).alias("y"), (k % 20).alias("x"))
    channels = samples.groupBy("image", F.col("id").alias("position")).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")).withColumns({"hshift": F.lit(0), "vshift": F.lit(0)})
    links, _, _ = Q.layout(channels, Q.default_steps(channels))
    sizes = channels.groupBy("image").agg(F.sum(F.col("height") * F.col("width")).alias("n"))
    return Q.unsqueezed(Q.squeezed(samples, links, sizes), links, sizes).withColumnRenamed("id", "c")
