"""Registered queries of the raster operators, each over whole tables, with DuckDB SQL that computes the same."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import bits, colour
from tessera.operators import blocks as B, samples as S, stencils as T, tiles
from tessera.plans.colourplan import BT2100, D65, SRGB, Encoding, Plan
from tessera.plans.region import Region, source_region
from tessera.sources.grids import blocks, div, events_grid, fixed, frames, orders_grid, rgb_grid, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# the grids in SQL
G1 = "g1 AS (SELECT o_orderkey // 125 AS y, o_orderkey % 125 AS x, CAST(floor(o_totalprice) AS BIGINT) % 256 AS v FROM orders)"
RGB = "rgb AS (SELECT o_orderkey // 125 AS y, o_orderkey % 125 AS x, CAST(floor(o_totalprice) AS BIGINT) % 256 AS a, o_custkey % 256 AS b, o_orderkey % 256 AS c FROM orders)"
EV = "ev AS (SELECT event_id // 40 AS y, event_id % 40 AS x, CAST(floor(value * 16) AS BIGINT) AS v, value / 560.25 AS u FROM events)"
BLK = "blk AS (SELECT vec_id AS block, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings)"
FRAMES = "fr AS (SELECT user_id AS image, event_id AS frame_idx, event_id % 4 AS slot, CAST(event_id % 5 = 0 AS INT) AS duration, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_last FROM events)"
NB = """nb0 AS (SELECT y, x, v, lag(v) OVER r AS w0, lag(v, 2) OVER r AS ww0, lag(v) OVER c AS n0, lag(v, 2) OVER c AS nn0 FROM g1 WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
nb1 AS (SELECT *, lag(n0) OVER r AS nw0, lead(n0) OVER r AS ne0, lead(n0, 2) OVER r AS nee0 FROM nb0 WINDOW r AS (PARTITION BY y ORDER BY x)),
nb2 AS (SELECT *, CASE WHEN x > 0 THEN w0 ELSE coalesce(n0, 0) END AS w FROM nb1),
nb3 AS (SELECT *, coalesce(n0, w) AS n, CASE WHEN x > 0 THEN coalesce(nw0, w) ELSE w END AS nw FROM nb2),
nb AS (SELECT *, coalesce(ne0, n) AS ne, coalesce(nn0, n) AS nn, CASE WHEN x > 1 THEN ww0 ELSE w END AS ww, coalesce(nee0, ne0, n) AS nee FROM nb3)"""


def fx(sql: str) -> str:
    return f"CAST(floor(({sql}) * 10000 + 0.5) AS BIGINT)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# ---- integers ----


@query("zigzag_unpack", f"WITH {G1} SELECT y, x, xor(v >> 1, -(v & 1)) AS v FROM g1")
def _(spark, d):
    return orders_grid(spark, d).withColumn("v", bits.zigzag(F.col("v")))


@query(
    "hybrid_uint",
    f"""WITH {EV}, t AS (SELECT y, x, v % 64 AS t, v AS rest FROM ev),
p AS (SELECT *, (1 + ((t - 16) >> 3)) & 31 AS n, t & 1 AS lo, ((t >> 1) & 3) | 4 AS hi FROM t)
SELECT y, x, CASE WHEN t < 16 THEN t ELSE (((hi << n) | (rest & ((1::BIGINT << n) - 1))) << 1) | lo END AS v FROM p""",
)
def _(spark, d):
    return events_grid(spark, d).select("y", "x", bits.hybrid_uint(F.col("v") % 64, F.col("v"), 4, 2, 1).alias("v"))


@query(
    "half_float",
    f"""WITH {G1}, b AS (SELECT y, x, (v * 257 + x * 311 + y) % 65536 AS b FROM g1), p AS (SELECT y, x, b, (b >> 10) & 31 AS e, b & 1023 AS m FROM b)
SELECT y, x, CASE WHEN e = 31 THEN NULL ELSE CAST(round((CASE WHEN b >= 32768 THEN -1 ELSE 1 END) * (CASE WHEN e = 0 THEN m ELSE (1024 + m) * pow(2, e - 1) END)) AS BIGINT) END AS v FROM p""",
)
def _(spark, d):
    raw = (F.col("v") * 257 + F.col("x") * 311 + F.col("y")) % 65536
    return orders_grid(spark, d).select("y", "x", F.round(bits.half_float(raw) * float(1 << 24)).cast("long").alias("v"))


@query(
    "ratio_width",
    "WITH p AS (SELECT p_partkey, p_partkey % 7 + 1 AS r, p_size * 8::BIGINT AS h FROM part) SELECT p_partkey, CASE r WHEN 1 THEN h WHEN 2 THEN h * 12 // 10 WHEN 3 THEN h * 4 // 3 WHEN 4 THEN h * 3 // 2 WHEN 5 THEN h * 16 // 9 WHEN 6 THEN h * 5 // 4 ELSE h * 2 END AS width FROM p",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", bits.ratio_width(F.col("p_partkey") % 7 + 1, F.col("p_size").cast("long") * 8).alias("width"))


@query(
    "lehmer_permutation",
    """WITH p AS (SELECT p_partkey, [p_partkey % 4, p_partkey // 4 % 3, p_partkey // 12 % 2, 0] AS c FROM part),
q AS (SELECT p_partkey, [0, 1, 2, 3] AS l0, c FROM p),
r AS (SELECT *, l0[c[1] + 1] AS a, list_filter(l0, lambda z: z <> l0[c[1] + 1]) AS l1 FROM q),
s AS (SELECT *, l1[c[2] + 1] AS b, list_filter(l1, lambda z: z <> l1[c[2] + 1]) AS l2 FROM r),
t AS (SELECT *, l2[c[3] + 1] AS e, list_filter(l2, lambda z: z <> l2[c[3] + 1]) AS l3 FROM s)
SELECT p_partkey, CAST(a * 1000 + b * 100 + e * 10 + l3[1] AS BIGINT) AS order_ FROM t""",
)
def _(spark, d):
    k = F.col("p_partkey")
    p = bits.lehmer(F.array(k % 4, div(k, 4) % 3, div(k, 12) % 2, F.lit(0).cast("long")))
    return table(spark, d, "part").withColumn("p", p).select("p_partkey", (F.get("p", F.lit(0)) * 1000 + F.get("p", F.lit(1)) * 100 + F.get("p", F.lit(2)) * 10 + F.get("p", F.lit(3))).alias("order_"))


SECTIONS = "sec AS (SELECT l_orderkey AS image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS place, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem)"


def sections(spark: SparkSession, d: str) -> DataFrame:
    """A section for each line of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.row_number().over(order) - 1).cast("long").alias("place"), F.floor("l_extendedprice").alias("size"))


@query("toc_offsets", f"WITH {SECTIONS} SELECT image, place, size, CAST(coalesce(sum(size) OVER (PARTITION BY image ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sec")
def _(spark, d):
    return S.offsets(sections(spark, d), "image", "place", "size")


@query(
    "toc_permute",
    f"""WITH {SECTIONS}, n AS (SELECT *, count(*) OVER (PARTITION BY image) AS n FROM sec), p AS (SELECT image, place, n - 1 - place AS stored, size FROM n)
SELECT image, place, stored, CAST(coalesce(sum(size) OVER (PARTITION BY image ORDER BY stored ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p""",
)
def _(spark, d):
    s = sections(spark, d).withColumn("stored", F.count(F.lit(1)).over(Window.partitionBy("image")) - 1 - F.col("place"))
    return S.offsets(s, "image", "stored", "size").select("image", "place", "stored", "offset")


@query("rle_expand", f"WITH {EV}, t AS (SELECT y, x, v % 17 AS v, v % 5 + 1 AS length FROM ev) SELECT y, x, v, unnest(range(length)) AS place FROM t")
def _(spark, d):
    return S.rle(events_grid(spark, d).select("y", "x", (F.col("v") % 17).alias("v"), (F.col("v") % 5 + 1).alias("length")))


@query("cluster_hole_check", f"WITH {EV} SELECT y, CAST(max(v % 16) + 1 AS BIGINT) AS clusters, count(DISTINCT v % 16) AS used, max(v % 16) + 1 = count(DISTINCT v % 16) AS valid FROM ev GROUP BY y")
def _(spark, d):
    c = F.col("v") % 16
    g = events_grid(spark, d).groupBy("y").agg((F.max(c) + 1).alias("clusters"), F.count_distinct(c).alias("used"))
    return g.withColumn("valid", F.col("clusters") == F.col("used"))


@query(
    "prefix_codes",
    """WITH s AS (SELECT p_brand, p_partkey, p_size % 12 + 1 AS length FROM part), c AS (SELECT p_brand, length AS shorter, count(*) AS n FROM s GROUP BY ALL),
f AS (SELECT l.p_brand, l.length, sum(n * CAST(pow(2, length - shorter) AS BIGINT)) AS first FROM (SELECT DISTINCT p_brand, length FROM s) l JOIN c ON l.p_brand = c.p_brand AND shorter < length GROUP BY ALL)
SELECT s.p_brand, p_partkey, CAST(s.length AS INT) AS length, CAST(coalesce(first, 0) + row_number() OVER (PARTITION BY s.p_brand, s.length ORDER BY p_partkey) - 1 AS BIGINT) AS code FROM s LEFT JOIN f USING (p_brand, length)""",
)
def _(spark, d):
    s = table(spark, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 12 + 1).alias("length"))
    return S.canonical_codes(s, "p_brand", "p_partkey", "length")


@query("pass_accumulate", f"WITH {EV} SELECT y, x % 8 AS k, CAST(sum((v % 32 - 16) * CAST(pow(2, x // 8) AS BIGINT)) AS BIGINT) AS v FROM ev GROUP BY ALL")
def _(spark, d):
    c = events_grid(spark, d).select("y", (F.col("x") % 8).alias("k"), bits.shift_left(F.col("v") % 32 - 16, div(F.col("x"), 8)).alias("c"))
    return c.groupBy("y", "k").agg(F.sum("c").alias("v"))


# ---- reversible transforms ----

RCT = {
    0: ("a", "b", "c"), 1: ("a", "b", "c + a"), 2: ("a", "b + a", "c"), 3: ("a", "b + a", "c + a"),
    4: ("a", "b + ((a + c) >> 1)", "c"), 5: ("a", "b + ((a + c + a) >> 1)", "c + a"),
    6: ("a - (c >> 1) - (b >> 1) + b", "c + a - (c >> 1)", "a - (c >> 1) - (b >> 1)"),
}
for _kind, (_d, _e, _f) in RCT.items():

    @query(f"rct_type{_kind}", f"WITH {RGB} SELECT y, x, {_d} AS d, {_e} AS e, {_f} AS f FROM rgb")
    def _(spark, d, kind=_kind):
        out = S.inverse_rct(kind, 0, *map(F.col, "abc"))
        return rgb_grid(spark, d).select("y", "x", *(c.alias(n) for c, n in zip(out, "def")))


_d, _e, _f = RCT[6]


@query("rct_orders", f"WITH {RGB}, t AS (SELECT y, x, {_d} AS d, {_e} AS e, {_f} AS f FROM rgb) SELECT y, x, CASE y % 6 WHEN 0 THEN d WHEN 1 THEN f WHEN 2 THEN e WHEN 3 THEN d WHEN 4 THEN e ELSE f END AS v FROM t")
def _(spark, d):
    firsts = [S.inverse_rct(6, k, *map(F.col, "abc"))[0] for k in range(6)]
    out = firsts[5]
    for k in range(5):
        out = F.when(F.col("y") % 6 == k, firsts[k]).otherwise(out)
    return rgb_grid(spark, d).select("y", "x", out.alias("v"))


@query("residual_samples", f"WITH {EV}, t AS (SELECT y, x, v * 1048576 AS u, v FROM ev) SELECT y, x, (((xor(u >> 1, -(u & 1)) * 3 + 7 + v) + 2147483648) & 4294967295) - 2147483648 AS v FROM t")
def _(spark, d):
    return events_grid(spark, d).select("y", "x", S.from_residual(F.col("v") * 1048576, F.col("v"), 3, 7).alias("v"))


@query("modular_to_float", f"WITH {G1} SELECT y, x, {fx('v / 255::DOUBLE')} AS v FROM g1")
def _(spark, d):
    return orders_grid(spark, d).select("y", "x", fixed(S.to_float(F.col("v"), 8)).alias("v"))


@query("modular_xyb", f"WITH {RGB} SELECT y, x, {fx('b / (32 * 128)::DOUBLE')} AS a, {fx('a / (4 * 128)::DOUBLE')} AS b, {fx('(c + a) / (2 * 128)::DOUBLE')} AS c FROM rgb")
def _(spark, d):
    out = S.modular_xyb(*map(F.col, "abc"), tuple(B.LF_FACTORS.values()))
    return rgb_grid(spark, d).select("y", "x", *(fixed(v).alias(n) for v, n in zip(out, "abc")))


@query("rct_roundtrip", f"WITH {RGB} SELECT y, x, a, b, c FROM rgb")
def _(spark, d):
    there = rgb_grid(spark, d).select("y", "x", *(c.alias(n) for c, n in zip(S.forward_ycocg(*map(F.col, "abc")), "abc")))
    return there.select("y", "x", *(c.alias(n) for c, n in zip(S.inverse_rct(6, 0, *map(F.col, "abc")), "abc")))


@query(
    "palette_lookup",
    f"""WITH {G1}, pal AS (SELECT n_nationkey AS idx, c, (n_nationkey * 37 + c * 91) % 256 AS v FROM nation, (SELECT unnest([0, 1, 2]) AS c)),
fixed(e, r, g, b) AS (VALUES {", ".join(str((k, *entry)) for k, entry in enumerate(S.DELTAS))}), deltas AS (SELECT e, 0 AS c, r AS v FROM fixed UNION ALL SELECT e, 1, g FROM fixed UNION ALL SELECT e, 2, b FROM fixed),
i AS (SELECT y, x, c, v - 40 AS i FROM g1, (SELECT unnest([0, 1, 2]) AS c)),
j AS (SELECT *, i - 25 AS k, (-i - 1) % 143 AS delta FROM i)
SELECT j.y, j.x, CAST(j.c AS INT) AS c, CAST(CASE WHEN i < 0 THEN CASE WHEN delta % 2 = 0 THEN -d.v ELSE d.v END WHEN i < 25 THEN p.v
WHEN k < 64 THEN (k // CAST(pow(4, j.c) AS BIGINT)) % 4 * 255 // 4 + 32 ELSE ((k - 64) // CAST(pow(5, j.c) AS BIGINT)) % 5 * 255 // 4 END AS BIGINT) AS v
FROM j LEFT JOIN pal p ON p.idx = i AND p.c = j.c LEFT JOIN deltas d ON i < 0 AND d.e = (delta + 1) // 2 AND d.c = j.c""",
)
def _(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
    return S.palette(orders_grid(spark, d).withColumn("v", F.col("v") - 40), nation.withColumn("v", (F.col("idx") * 37 + F.col("c") * 91) % 256), 25)


# ---- prediction ----

PREDICTED = {
    "west": "w", "north": "n", "avg_wn": "(w + n) // 2", "select": "CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END", "gradient": "least(greatest(n + w - nw, least(n, w)), greatest(n, w))",
    "ne": "ne", "nw": "nw", "ww": "ww", "avg_wnw": "(w + nw) // 2", "avg_nnw": "(n + nw) // 2", "avg_nne": "(n + ne) // 2", "avg_all": "(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) // 16",
}
for _name, _sql in PREDICTED.items():

    @query(f"pred_{_name}", f"WITH {G1}, {NB} SELECT y, x, v - ({_sql}) AS v FROM nb")
    def _(spark, d, name=_name):
        return T.residuals(orders_grid(spark, d), name)


TREE = ("abs_n", 128, ("w_nw", 16, 0, ("n_ne", 0, 1, 2)), ("flat", 60, ("abs_w", 40, 3, 4), 5))


@query(
    "ma_tree_contexts",
    f"WITH {G1}, {NB}, c AS (SELECT CASE WHEN abs(n) > 128 THEN CASE WHEN w - nw > 16 THEN 0 WHEN n - ne > 0 THEN 1 ELSE 2 END WHEN w + n - nw > 60 THEN CASE WHEN abs(w) > 40 THEN 3 ELSE 4 END ELSE 5 END AS context FROM nb) SELECT context, count(*) AS n FROM c GROUP BY context",
)
def _(spark, d):
    return T.properties(orders_grid(spark, d)).groupBy(T.tree(TREE, F.col).alias("context")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "previous_channel_properties",
    f"""WITH g1 AS (SELECT o_orderkey // 125 AS y, o_orderkey % 125 AS x, o_custkey % 256 AS v FROM orders), {NB}, p AS (SELECT y, x, v, least(greatest(n + w - nw, least(n, w)), greatest(n, w)) AS g FROM nb)
SELECT y, x, abs(v) AS p0, v AS p1, abs(v - g) AS p2, v - g AS p3 FROM p""",
)
def _(spark, d):
    before = T.around(rgb_grid(spark, d), 2, "b")
    rest = F.transform("r0", lambda v, i: v - T.PREDICTORS["gradient"](T.neighbours(i)))
    both = T.spread_out(before, v=F.col("r0"), r=rest)
    return both.select("y", "x", F.abs("v").alias("p0"), F.col("v").alias("p1"), F.abs("r").alias("p2"), F.col("r").alias("p3"))


@query("gradient_row_sums", f"WITH {G1} SELECT y, x, CAST(sum(xor(v >> 1, -(v & 1))) OVER (PARTITION BY y ORDER BY x) AS BIGINT) AS v FROM g1")
def _(spark, d):
    row = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return orders_grid(spark, d).select("y", "x", F.sum(bits.zigzag(F.col("v"))).over(row).alias("v"))


def tend(source: str) -> str:
    """Tables that add `t` = tendency(a, b, c) to a table: rising triples are negated to falling ones, whose slope is the least of its three bounds."""
    return f"""s1 AS (SELECT *, CASE WHEN a < c THEN -1 ELSE 1 END AS up FROM {source}), s2 AS (SELECT *, up * (a - b) AS drop1, up * (b - c) AS drop2 FROM s1),
s3 AS (SELECT *, CASE WHEN drop1 < 0 OR drop2 < 0 THEN 0 ELSE up * list_min([(4 * drop1 + 3 * drop2 + 6) // 12, 1 + 2 * drop1, 2 * drop2]) END AS t FROM s2)"""


@query("tendency", f"WITH {RGB}, {tend('rgb')} SELECT y, x, CAST(t AS BIGINT) AS v FROM s3")
def _(spark, d):
    return rgb_grid(spark, d).select("y", "x", T.tendency(*map(F.col, "abc")).cast("long").alias("v"))


def squeezed_sql(along: str, across: str) -> str:
    return f"""WITH {G1}, p AS (SELECT {across} AS o, {along} // 2 AS p, max(CASE WHEN {along} % 2 = 0 THEN v END) AS f, max(CASE WHEN {along} % 2 = 1 THEN v END) AS s FROM g1 GROUP BY ALL),
q AS (SELECT *, CASE WHEN s IS NULL THEN f ELSE f - (f - s) // 2 END AS b FROM p),
r AS (SELECT *, coalesce(lag(s) OVER w, b) AS a, coalesce(lead(b) OVER w, b) AS c FROM q WINDOW w AS (PARTITION BY o ORDER BY p)), {tend('r')}"""


@query("squeeze_rows", squeezed_sql("x", "y") + " SELECT o AS y, p AS x, b AS average, CASE WHEN s IS NOT NULL THEN f - s - t END AS residual FROM s3")
def _(spark, d):
    return T.squeeze_rows(orders_grid(spark, d))


@query("squeeze_columns", squeezed_sql("y", "x") + " SELECT p AS y, o AS x, b AS average, CASE WHEN s IS NOT NULL THEN f - s - t END AS residual FROM s3")
def _(spark, d):
    return T.squeeze_columns(orders_grid(spark, d))


@query("unsqueeze_rows", f"WITH {G1} SELECT y, x, v FROM g1")
def _(spark, d):
    return tiles.unsqueeze(T.squeeze_rows(orders_grid(spark, d)))


@query("unsqueeze_columns", f"WITH {G1} SELECT y, x, v FROM g1")
def _(spark, d):
    return tiles.unsqueeze(T.squeeze_columns(orders_grid(spark, d)), along="y")


# ---- stencils and resampling ----

AROUND = """size AS (SELECT max(x) AS mx, max(y) AS my FROM {g}), l0 AS (SELECT y, x, v, lag(v) OVER r AS w0, lead(v) OVER r AS e0 FROM {g} WINDOW r AS (PARTITION BY y ORDER BY x)),
l1 AS (SELECT y, x, v, coalesce(w0, v) AS w, coalesce(e0, v) AS e FROM l0), c AS (SELECT *, lag(v) OVER k AS n0, lag(w) OVER k AS nw0, lag(e) OVER k AS ne0, lead(v) OVER k AS s0, lead(w) OVER k AS sw0, lead(e) OVER k AS se0 FROM l1 WINDOW k AS (PARTITION BY x ORDER BY y)),
nine AS (SELECT y, x, v, w, e, coalesce(n0, v) AS n, coalesce(nw0, w) AS nw, coalesce(ne0, e) AS ne, coalesce(s0, v) AS s, coalesce(sw0, w) AS sw, coalesce(se0, e) AS se, mx, my FROM c, size)"""


@query("gabor", f"WITH {G1}, {AROUND.format(g="g1")} SELECT y, x, {fx('(v + 0.115169525::DOUBLE * (n + s + e + w) + 0.061248592::DOUBLE * (ne + nw + se + sw)) / (1 + 4 * 0.115169525::DOUBLE + 4 * 0.061248592::DOUBLE)')} AS v FROM nine")
def _(spark, d):
    return T.gabor(orders_grid(spark, d)).withColumn("v", fixed(F.col("v")))


@query(
    "lf_smoothing",
    f"""WITH {EV}, {AROUND.format(g="ev")}, m AS (SELECT *, 0.052262735::DOUBLE * v + 0.2034514::DOUBLE * (n + s + e + w) + 0.03348292::DOUBLE * (ne + nw + se + sw) AS wa FROM nine)
SELECT y, x, CASE WHEN x > 0 AND y > 0 AND x < mx AND y < my THEN {fx('(wa - v) * greatest(0.0::DOUBLE, 3 - 4 * greatest(0.5::DOUBLE, abs(wa - v) / 4000)) + v')} ELSE v * 10000 END AS v FROM m""",
)
def _(spark, d):
    return T.lf_smoothing(events_grid(spark, d), 4000.0).withColumn("v", fixed(F.col("v")))


@query(
    "chroma_upsample",
    f"""WITH {G1}, l AS (SELECT y, x, v, coalesce(lag(v) OVER r, v) AS p, coalesce(lead(v) OVER r, v) AS n FROM g1 WINDOW r AS (PARTITION BY y ORDER BY x))
SELECT y, 2 * x AS x, {fx('0.25::DOUBLE * p + 0.75::DOUBLE * v')} AS v FROM l UNION ALL SELECT y, 2 * x + 1, {fx('0.75::DOUBLE * v + 0.25::DOUBLE * n')} FROM l""",
)
def _(spark, d):
    return tiles.chroma_upsample(orders_grid(spark, d), ("v",), down=False).withColumn("v", fixed(F.col("v")))


@query(
    "chroma_upsample_both",
    f"""WITH {G1}, l AS (SELECT y, x, v, coalesce(lag(v) OVER r, v) AS p, coalesce(lead(v) OVER r, v) AS n FROM g1 WINDOW r AS (PARTITION BY y ORDER BY x)),
h AS (SELECT y, 2 * x AS x, 0.25::DOUBLE * p + 0.75::DOUBLE * v AS v FROM l UNION ALL SELECT y, 2 * x + 1, 0.75::DOUBLE * v + 0.25::DOUBLE * n FROM l),
d AS (SELECT y, x, v, coalesce(lag(v) OVER c, v) AS p, coalesce(lead(v) OVER c, v) AS n FROM h WINDOW c AS (PARTITION BY x ORDER BY y))
SELECT 2 * y AS y, x, {fx('0.25::DOUBLE * p + 0.75::DOUBLE * v')} AS v FROM d UNION ALL SELECT 2 * y + 1, x, {fx('0.75::DOUBLE * v + 0.25::DOUBLE * n')} FROM d""",
)
def _(spark, d):
    return tiles.chroma_upsample(orders_grid(spark, d), ("v",)).withColumn("v", fixed(F.col("v")))


# several images: every thirty rows of the grid are one
IMAGES = "im AS MATERIALIZED (SELECT o_orderkey // 125 // 30 AS image, o_orderkey // 125 % 30 AS y, o_orderkey % 125 AS x, CAST(floor(o_totalprice) AS BIGINT) AS v, o_custkey AS u, o_orderkey AS k FROM orders), dims AS MATERIALIZED (SELECT image, max(y) + 1 AS high, max(x) + 1 AS wide FROM im GROUP BY image)"
MIRROR = "CASE WHEN {0} < 0 THEN -{0} - 1 WHEN {0} >= {1} THEN 2 * {1} - 1 - {0} ELSE {0} END"
SOFT = f"""{IMAGES}, soft AS MATERIALIZED (SELECT image, y, x, v % 16 / 4096::DOUBLE AS a, u % 32 / 1024::DOUBLE AS b, k % 64 / 512::DOUBLE AS c, (image + y // 8 * 3 + x // 8) % 7 * 0.9::DOUBLE AS s FROM im)"""


def images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = table(spark, d, "orders").select(div(k, 125).alias("row"), (k % 125).alias("x"), F.floor("o_totalprice").alias("v"), F.col("o_custkey").alias("u"), k.alias("k"))
    return g.select(div(F.col("row"), 30).alias("image"), (F.col("row") % 30).alias("y"), "x", "v", "u", "k")


def soft(spark: SparkSession, d: str) -> DataFrame:
    """Channels of small differences, and a sigma for each 8 x 8 block, some below 0.3."""
    block = F.col("image") + div(F.col("y"), 8) * 3 + div(F.col("x"), 8)
    return images(spark, d).select("image", "y", "x", (F.col("v") % 16 / 4096).alias("a"), (F.col("u") % 32 / 1024).alias("b"), (F.col("k") % 64 / 512).alias("c"), (block % 7 * 0.9).alias("s"))


def _epf_step_sql(name: str, source: str, neighbours: list, compared: list, scale: float) -> str:
    """One step as a table: of every sample, neighbour and compared place the differences of all channels, added up and weighted."""
    values = lambda cells: "(VALUES " + ", ".join(f"({y}, {x})" for y, x in cells) + ")"
    at = lambda y, x: f"{MIRROR.format(f'({y})', 'high')} AS {{0}}y, {MIRROR.format(f'({x})', 'wide')} AS {{0}}x"
    return f"""{name}_c AS MATERIALIZED (SELECT p.image, p.y, p.x, k.y AS ky, k.x AS kx, {at("p.y + k.y + d.y", "p.x + k.x + d.x").format("n")}, {at("p.y + d.y", "p.x + d.x").format("m")}, {at("p.y + k.y", "p.x + k.x").format("k_")}
FROM {source} p JOIN dims USING (image), {values(neighbours)} k(y, x), {values(compared)} d(y, x)),
{name}_d AS MATERIALIZED (SELECT c.image, c.y, c.x, k_y, k_x, ky, kx, sum(40 * abs(n.a - m.a) + 5 * abs(n.b - m.b) + 3.5 * abs(n.c - m.c)) AS dist
FROM {name}_c c JOIN {source} n ON n.image = c.image AND n.y = c.ny AND n.x = c.nx JOIN {source} m ON m.image = c.image AND m.y = c.my AND m.x = c.mx GROUP BY ALL),
{name}_w AS MATERIALIZED (SELECT p.image, p.y, p.x, any_value(p.s) AS s, any_value(p.a) AS a, any_value(p.b) AS b, any_value(p.c) AS c, sum(w) AS w, sum(w * n.a) AS wa, sum(w * n.b) AS wb, sum(w * n.c) AS wc FROM
(SELECT p.*, k_y, k_x, greatest(0, 1 + dist * 6.6 * (sqrt(0.5::DOUBLE) - 1) / greatest(p.s, 0.3) * {scale} * CASE WHEN p.x % 8 IN (0, 7) OR p.y % 8 IN (0, 7) THEN 2 / 3::DOUBLE ELSE 1 END) AS w FROM {source} p JOIN {name}_d USING (image, y, x)) p
JOIN {source} n ON n.image = p.image AND n.y = p.k_y AND n.x = p.k_x GROUP BY p.image, p.y, p.x),
{name} AS MATERIALIZED (SELECT image, y, x, s, CASE WHEN s < 0.3 THEN a ELSE (a + wa) / (1 + w) END AS a, CASE WHEN s < 0.3 THEN b ELSE (b + wb) / (1 + w) END AS b, CASE WHEN s < 0.3 THEN c ELSE (c + wc) / (1 + w) END AS c FROM {name}_w)"""


_CROSS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
_EPF = {
    0: ([(-2, 0), (-1, -1), (-1, 0), (-1, 1), (0, -2), (0, -1), (0, 1), (0, 2), (1, -1), (1, 0), (1, 1), (2, 0)], [(0, 0), *_CROSS], 0.9),
    1: (_CROSS, [(0, 0), *_CROSS], 1.0),
    2: (_CROSS, [(0, 0)], 6.5),
}
for _iterations, _steps in {1: (1,), 2: (1, 2), 3: (0, 1, 2)}.items():
    _sources = ["soft", *(f"e{k}" for k in _steps)]
    _sql = ", ".join([f"WITH {SOFT}", *(_epf_step_sql(f"e{k}", source, *_EPF[k]) for k, source in zip(_steps, _sources))])

    @query("epf_step" if _iterations == 1 else f"epf_{_iterations}_steps", f"{_sql} SELECT image, y, x, {', '.join(f'CAST(floor({c} * 1e8 + 0.37) AS BIGINT) AS {c}' for c in 'abc')} FROM {_sources[-1]}")
    def _(spark, d, iterations=_iterations):
        out = tiles.epf(soft(spark, d), "s", ("a", "b", "c"), iterations, ("image",))
        return out.select("image", "y", "x", *(F.floor(F.col(c) * 1e8 + 0.37).alias(c) for c in "abc"))


@query(
    "upsample2",
    f"""WITH {IMAGES}, up(i, w) AS (SELECT unnest(range(15)), unnest({list(tiles.UP2)})), taps AS (SELECT py, px, dy, dx, CASE WHEN py = 0 THEN dy ELSE 4 - dy END AS i, CASE WHEN px = 0 THEN dx ELSE 4 - dx END AS j
FROM range(2) a(py), range(2) b(px), range(5) c(dy), range(5) e(dx)), kernel AS MATERIALIZED (SELECT py, px, dy, dx, w FROM taps JOIN up ON up.i = least(taps.i, j) * 5 - least(taps.i, j) * (least(taps.i, j) - 1) // 2 + greatest(taps.i, j) - least(taps.i, j)),
cells AS MATERIALIZED (SELECT p.image, 2 * p.y + py AS y, 2 * p.x + px AS x, w, {MIRROR.format("(p.y + dy - 2)", "high")} AS ny, {MIRROR.format("(p.x + dx - 2)", "wide")} AS nx FROM im p JOIN dims USING (image), kernel),
s AS (SELECT c.image, c.y, c.x, sum(w * n.v) AS v, min(n.v) AS least_v, max(n.v) AS most_v FROM cells c JOIN im n ON n.image = c.image AND n.y = c.ny AND n.x = c.nx GROUP BY c.image, c.y, c.x)
SELECT image, y, x, CAST(floor(greatest(least(v, most_v), least_v) * 100 + 0.5) AS BIGINT) AS v FROM s""",
)
def _(spark, d):
    # whole samples by weights of eight decimals: rounded exactly, as a decimal, since a double may fall on the other side of a half
    return tiles.upsample(images(spark, d), ("v",), keys=("image",)).withColumn("v", F.expr("CAST(floor(TRY_CAST(v AS DECIMAL(20, 8)) * 100 + 0.5BD) AS BIGINT)"))


@query(
    "lf_smoothing_three",
    f"""WITH {IMAGES}, cells AS (SELECT image, y, x, v % 4096 / 64::DOUBLE AS a, u % 256 / 16::DOUBLE AS b, k % 512 / 32::DOUBLE AS c FROM im),
ring AS (SELECT * FROM (VALUES (0, 0, 0.052262735::DOUBLE), (0, 1, 0.2034514), (0, -1, 0.2034514), (1, 0, 0.2034514), (-1, 0, 0.2034514), (1, 1, 0.03348292), (1, -1, 0.03348292), (-1, 1, 0.03348292), (-1, -1, 0.03348292)) r(dy, dx, w)),
m AS (SELECT p.image, p.y, p.x, sum(w * n.a) AS ma, sum(w * n.b) AS mb, sum(w * n.c) AS mc, count(*) AS places FROM cells p, ring JOIN cells n ON n.image = p.image AND n.y = p.y + dy AND n.x = p.x + dx GROUP BY ALL),
g AS (SELECT cells.*, ma - a AS da, mb - b AS db, mc - c AS dc, CASE WHEN places = 9 THEN greatest(0, 3 - 4 * greatest(0.5, abs(ma - a) / 30, abs(mb - b) / 20, abs(mc - c) / 25)) ELSE 0 END AS f FROM cells JOIN m USING (image, y, x))
SELECT image, y, x, {fx('a + f * da')} AS a, {fx('b + f * db')} AS b, {fx('c + f * dc')} AS c FROM g""",
)
def _(spark, d):
    cells = images(spark, d).select("image", "y", "x", (F.col("v") % 4096 / 64).alias("a"), (F.col("u") % 256 / 16).alias("b"), (F.col("k") % 512 / 32).alias("c"))
    out = tiles.lf_smoothing(cells, ("a", "b", "c"), (30.0, 20.0, 25.0), ("image",))
    return out.select("image", "y", "x", *(fixed(F.col(c)).alias(c) for c in "abc"))


@query("upsample_nearest", f"WITH {G1} SELECT y * 2 + dy AS y, x * 2 + dx AS x, v FROM g1, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)")
def _(spark, d):
    return S.upsample_nearest(orders_grid(spark, d), 2)


@query("mirror_pad", f"WITH {G1}, s AS (SELECT y, x + dx AS x FROM g1, (SELECT unnest([-3, 3]) AS dx) WHERE (x < 3 AND dx < 0) OR (x > 121 AND dx > 0)) SELECT s.y, s.x, g.v FROM s JOIN g1 g ON g.y = s.y AND g.x = CASE WHEN s.x < 0 THEN -s.x - 1 WHEN s.x >= 125 THEN 249 - s.x ELSE s.x END")
def _(spark, d):
    g = orders_grid(spark, d)
    shift = F.when(F.col("x") < 3, -3).when(F.col("x") > 121, 3)
    pad = g.select("y", (F.col("x") + shift).alias("px")).where("px IS NOT NULL")
    return pad.withColumn("x", bits.mirror(F.col("px"), F.lit(125))).join(g, ["y", "x"]).select("y", F.col("px").alias("x"), "v")


# ---- blocks ----

BASIS = "cosines AS (SELECT k, n, CASE WHEN k = 0 THEN 1.0 ELSE sqrt(2.0::DOUBLE) * cos(pi() * k * (2 * n + 1) / 16) END AS b FROM range(8) t(k), range(8) u(n))"


@query(
    "dct8_inverse",
    f"""WITH {BLK}, {BASIS}, r AS (SELECT block, blk.n // 8 AS i, c.n AS j, sum(v * b) AS v FROM blk JOIN cosines c ON c.k = blk.n % 8 GROUP BY ALL)
SELECT block, c.n AS i, j, {fx('sum(v * b)')} AS v FROM r JOIN cosines c ON c.k = r.i GROUP BY block, c.n, j""",
)
def _(spark, d):
    return B.exploded(blocks(spark, d).withColumn("v", B.inverse_dct(F.col("v")))).withColumn("v", fixed(F.col("v")))


@query(
    "dct8_forward",
    f"""WITH {BLK}, {BASIS}, r AS (SELECT block, blk.n // 8 AS i, c.k AS j, sum(v * b) / 8 AS v FROM blk JOIN cosines c ON c.n = blk.n % 8 GROUP BY ALL)
SELECT block, c.k AS i, j, {fx('sum(v * b) / 8')} AS v FROM r JOIN cosines c ON c.n = r.i GROUP BY block, c.k, j""",
)
def _(spark, d):
    return B.exploded(blocks(spark, d).withColumn("v", B.forward_dct(F.col("v")))).withColumn("v", fixed(F.col("v")))


def _haar_sql() -> str:
    cells = {(y, x): {(y, x): 1} for y in range(8) for x in range(8)}
    for size in (2, 4, 8):
        half, new = size // 2, dict(cells)
        for y in range(half):
            for x in range(half):
                q = [cells[y, x], cells[y, x + half], cells[y + half, x], cells[y + half, x + half]]
                for (dy, dx), signs in {(0, 0): (1, 1, 1, 1), (0, 1): (1, 1, -1, -1), (1, 0): (1, -1, 1, -1), (1, 1): (1, -1, -1, 1)}.items():
                    terms: dict = {}
                    for s, part in zip(signs, q):
                        for k, w in part.items():
                            terms[k] = terms.get(k, 0) + s * w
                    new[2 * y + dy, 2 * x + dx] = terms
        cells = new
    rows = ", ".join(f"({y},{x},{k[0] * 8 + k[1]},{w})" for (y, x), part in cells.items() for k, w in part.items() if w)
    return f"WITH {BLK}, m(i, j, n, w) AS (VALUES {rows}) SELECT block, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {fx('sum(v * w)')} AS v FROM blk JOIN m USING (n) GROUP BY block, i, j"


@query("dct2_special", _haar_sql())
def _(spark, d):
    return B.exploded(blocks(spark, d).withColumn("v", B.haar(F.col("v")))).withColumn("v", fixed(F.col("v")))


Q = "CAST(floor(v * 40) AS BIGINT)"


@query("lf_dequant", f"WITH {BLK} SELECT block, n // 8 AS i, n % 8 AS j, {fx(f'{Q} * (0.25::DOUBLE * 512) / (32 * 16)')} AS v FROM blk")
def _(spark, d):
    return B.exploded(blocks(spark, d)).withColumn("v", fixed(B.dequant_lf(F.floor(F.col("v") * 40), "y", 32, 16)))


@query(
    "hf_dequant",
    f"WITH {BLK}, q AS (SELECT block, n, {Q} AS q FROM blk) SELECT block, n // 8 AS i, n % 8 AS j, {fx('(CASE WHEN abs(q) <= 1 THEN q * (1 - 0.05465007330715401::DOUBLE) ELSE q - 0.145::DOUBLE / q END) * (1.0::DOUBLE / (1 + n)) * (65536.0::DOUBLE / (4096 * (block % 5 + 1))) * 0.8::DOUBLE')} AS v FROM q",
)
def _(spark, d):
    e = B.exploded(blocks(spark, d))
    value = B.dequant_hf(F.floor(F.col("v") * 40).cast("long"), "x", 1.0 / (1 + F.col("i") * 8 + F.col("j")), 4096, F.col("block") % 5 + 1, 3)
    return e.withColumn("v", fixed(value))


@query("chroma_from_luma", f"WITH {BLK} SELECT b.block, b.n // 8 AS i, b.n % 8 AS j, {fx('b.v + (1 + (b.block % 64 - 32)::DOUBLE / 84) * a.v')} AS v FROM blk b JOIN blk a ON a.block = b.block - 1 AND a.n = b.n")
def _(spark, d):
    b = blocks(spark, d)
    luma = b.select((F.col("block") + 1).alias("block"), F.col("v").alias("luma"))
    k = 1 + (F.col("block") % 64 - 32) / 84.0
    return B.exploded(b.join(luma, "block").select("block", F.zip_with("v", "luma", lambda x, y: x + k * y).alias("v"))).withColumn("v", fixed(F.col("v")))


@query(
    "natural_order",
    f"WITH {BLK}, o AS (SELECT n, row_number() OVER (ORDER BY n // 8 + n % 8, CASE WHEN (n // 8 + n % 8) % 2 = 1 THEN n // 8 ELSE n % 8 END) - 1 AS place FROM range(64) t(n)) SELECT block, place, {fx('v')} AS v FROM blk JOIN o USING (n)",
)
def _(spark, d):
    order = F.array(*(F.get("v", F.lit(y * 8 + x)) for y, x in B.natural_order()))
    return blocks(spark, d).select("block", F.posexplode(order).alias("place", "v")).select("block", F.col("place").cast("long").alias("place"), fixed(F.col("v")).alias("v"))


# ---- frames ----

BLENDS = {
    "replace": "n", "add": "b + n", "mul": "b * n", "blend_premultiplied": "n + b * (1 - an)", "blend": "CASE WHEN 1 - (1 - an) * (1 - ab) <= 0 THEN 0 ELSE (an * n + ab * b * (1 - an)) / (1 - (1 - an) * (1 - ab)) END",
    "muladd": "b + an * n", "mixalpha": "b + n * (1 - b)",
}
for _mode, _sql in BLENDS.items():

    @query(
        f"blend_{_mode}",
        f"WITH {G1}, {EV}, j AS (SELECT g1.y, g1.x, g1.v / 255.0::DOUBLE AS b, (g1.x % 5) / 4.0::DOUBLE AS ab, ev.u AS n, (ev.v % 8) / 7.0::DOUBLE AS an FROM g1 LEFT JOIN ev ON ev.y = g1.y AND ev.x = g1.x) SELECT y, x, {fx(f'CASE WHEN n IS NULL THEN b ELSE {_sql} END')} AS v FROM j",
    )
    def _(spark, d, mode=_mode):
        base = orders_grid(spark, d).select("y", "x", (F.col("v") / 255.0).alias("v"), (F.col("x") % 5 / 4.0).alias("alpha"))
        new = events_grid(spark, d).select("y", "x", F.col("u").alias("v"), (F.col("v") % 8 / 7.0).alias("alpha"))
        return S.blend_frames(mode, base, new).withColumn("v", fixed(F.col("v")))


@query(
    "ref_slot_asof",
    f"WITH {FRAMES} SELECT image, frame_idx, " + ", ".join(f"last_value(CASE WHEN slot = {k} THEN frame_idx END IGNORE NULLS) OVER w AS ref{k}" for k in range(4)) + " FROM fr WINDOW w AS (PARTITION BY image ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def _(spark, d):
    return S.slot_references(frames(spark, d))


@query(
    "keyframe_counters",
    f"""WITH {FRAMES}, k AS (SELECT image, frame_idx, is_last OR duration <> 0 AS keyframe FROM fr), v AS (SELECT *, count(*) FILTER (keyframe) OVER (PARTITION BY image ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visible FROM k)
SELECT image, frame_idx, keyframe, visible, count(*) FILTER (NOT keyframe) OVER (PARTITION BY image, visible ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS invisible FROM v""",
)
def _(spark, d):
    return S.keyframes(frames(spark, d))


@query(
    "patch_apply",
    f"""WITH {G1}, p AS (SELECT c_custkey % 110 AS x0, c_custkey // 110 * 7 AS y0, c_custkey % 5 + 1 AS h, c_custkey % 7 + 1 AS w, c_custkey % 31 AS a FROM customer),
t AS (SELECT g1.y, g1.x, sum(a) AS a FROM g1 JOIN p ON g1.y BETWEEN y0 AND y0 + h - 1 AND g1.x BETWEEN x0 AND x0 + w - 1 GROUP BY ALL) SELECT g1.y, g1.x, CAST(v + coalesce(a, 0) AS BIGINT) AS v FROM g1 LEFT JOIN t USING (y, x)""",
)
def _(spark, d):
    k = F.col("c_custkey")
    patches = table(spark, d, "customer").select((k % 110).alias("x0"), (div(k, 110) * 7).alias("y0"), (k % 5 + 1).alias("h"), (k % 7 + 1).alias("w"), (k % 31).alias("add"))
    return S.apply_patches(orders_grid(spark, d), patches)


@query(
    "spline_points",
    "WITH p AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 21 - 10 AS dd FROM events), q AS (SELECT *, sum(dd) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM p) SELECT user_id, event_id, CAST(sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS at FROM q",
)
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    p = table(spark, d, "events").select("user_id", "event_id", (F.floor("value") % 21 - 10).alias("dd"))
    return p.withColumn("d", F.sum("dd").over(w)).select("user_id", "event_id", F.sum("d").over(w).alias("at"))


@query("crop_region", f"WITH {G1} SELECT y, x, v FROM g1 WHERE x BETWEEN 10 AND 109 AND y BETWEEN 3 AND 52")
def _(spark, d):
    return Region(10, 3, 100, 50).where(orders_grid(spark, d))


@query("crop_gabor", ORACLE_SQL["gabor"] + " WHERE x BETWEEN 10 AND 109 AND y BETWEEN 3 AND 52")
def _(spark, d):
    crop = Region(10, 3, 100, 50)
    need = source_region(crop, gabor=True)
    local = need.where(orders_grid(spark, d)).withColumn("x", F.col("x") - need.left)  # packed rows count from the left edge
    return crop.where(T.gabor(local).withColumn("x", F.col("x") + need.left)).withColumn("v", fixed(F.col("v")))


@query("group_histogram", f"WITH {G1} SELECT (y // 32) * 4 + x // 32 AS \"group\", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM g1 GROUP BY ALL")
def _(spark, d):
    g = (div(F.col("y"), 32) * 4 + div(F.col("x"), 32)).alias("group")
    return orders_grid(spark, d).groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


ORIENTED = {1: ("x", "y"), 2: ("124 - x", "y"), 3: ("124 - x", "my - y"), 4: ("x", "my - y"), 5: ("y", "x"), 6: ("my - y", "x"), 7: ("my - y", "124 - x"), 8: ("y", "124 - x")}
for _code, (_x, _y) in ORIENTED.items():

    @query(f"orient_{_code}", f"WITH {G1}, s AS (SELECT max(y) AS my FROM g1) SELECT {_x} AS x, {_y} AS y, v FROM g1, s")
    def _(spark, d, code=_code):
        g = orders_grid(spark, d)
        size = g.agg(F.lit(0).alias("one_"), (F.max("y") + 1).alias("height_"))  # one row
        height = F.col("height_")
        return S.oriented(g.withColumn("one_", F.lit(0)).join(F.broadcast(size), "one_"), code, *((height, 125) if code > 4 else (125, height)))


@query("quantise", f"WITH {RGB} SELECT y, x, " + ", ".join(f"CAST(floor(least(greatest({c} / 200.0::DOUBLE * 255 + 0.5, 0), 255)) AS BIGINT) AS {c}" for c in "abc") + " FROM rgb")
def _(spark, d):
    return rgb_grid(spark, d).select("y", "x", *(colour.quantise(F.col(c) / 200.0).alias(c) for c in "abc"))


@query("peak_rmse", f"WITH {G1}, {EV}, j AS (SELECT g1.v - ev.v % 256 AS d FROM g1 JOIN ev USING (y, x)) SELECT CAST(max(abs(d)) AS BIGINT) AS peak, {fx('sqrt(avg(d * d))')} AS rmse FROM j")
def _(spark, d):
    e = S.peak_and_rmse(orders_grid(spark, d), events_grid(spark, d).withColumn("v", F.col("v") % 256))
    return e.withColumn("rmse", fixed(F.col("rmse")))


# ---- colour ----

UNIT = f"{RGB}, c3 AS (SELECT y, x, a / 255.0::DOUBLE AS a, b / 255.0::DOUBLE AS b, c / 255.0::DOUBLE AS c FROM rgb)"


def unit(spark: SparkSession, d: str) -> DataFrame:
    return rgb_grid(spark, d).select("y", "x", *((F.col(c) / 255.0).alias(c) for c in "abc"))


def three(rows: DataFrame, rgb: list) -> DataFrame:
    return rows.select("y", "x", *(fixed(c).alias(n) for c, n in zip(rgb, "abc")))


@query("spot_mix", f"WITH {UNIT} SELECT y, x, {fx('0.7::DOUBLE * (c * 0.8::DOUBLE) + (1 - c * 0.8::DOUBLE) * a')} AS v FROM c3")
def _(spark, d):
    m = F.col("c") * 0.8
    return unit(spark, d).select("y", "x", fixed(0.7 * m + (1 - m) * F.col("a")).alias("v"))


_O, _BI = colour.OPSIN, colour.OPSIN_BIAS
_root = -(abs(_BI) ** (1 / 3))
_cube = lambda e: f"pow({e} - ({_root!r}::DOUBLE), 3) + ({_BI!r}::DOUBLE)"
_rows = ", ".join(fx(" + ".join(f"({w!r}::DOUBLE) * {n}" for w, n in zip(row, "lms"))) + f" AS {c}" for row, c in zip(_O, "abc"))


@query("xyb_to_rgb", f"WITH {UNIT}, t AS (SELECT y, x, {_cube('(b + (a - 0.5) * 0.05)')} AS l, {_cube('(b - (a - 0.5) * 0.05)')} AS m, {_cube('c')} AS s FROM c3) SELECT y, x, {_rows} FROM t")
def _(spark, d):
    lms = colour.xyb_to_lms((F.col("a") - 0.5) * 0.05, F.col("b"), F.col("c"))
    rows = unit(spark, d).select("y", "x", *(c.alias(n) for c, n in zip(lms, "lms")))
    return three(rows, colour.matrix(colour.OPSIN, [F.col(n) for n in "lms"]))


@query(
    "ycbcr_to_rgb",
    f"WITH {UNIT}, t AS (SELECT y, x, a - 0.5 AS cb, b - 0.5 AS l, c - 0.5 AS cr FROM c3) SELECT y, x, {fx('l + 128.0::DOUBLE / 255 + 1.402::DOUBLE * cr')} AS a, {fx('l + 128.0::DOUBLE / 255 + (-0.114::DOUBLE * 1.772 / 0.587) * cb + (-0.299::DOUBLE * 1.402 / 0.587) * cr')} AS b, {fx('l + 128.0::DOUBLE / 255 + 1.772::DOUBLE * cb')} AS c FROM t",
)
def _(spark, d):
    return three(unit(spark, d), colour.ycbcr(F.col("a") - 0.5, F.col("b") - 0.5, F.col("c") - 0.5))


_PQ = "pow((0.8359375::DOUBLE + 18.8515625::DOUBLE * pow(u, 0.1593017578125::DOUBLE)) / (1 + 18.6875::DOUBLE * pow(u, 0.1593017578125::DOUBLE)), 78.84375::DOUBLE)"
_UNPQ = "pow(greatest(pow(u, 1 / 78.84375::DOUBLE) - 0.8359375::DOUBLE, 0) / (18.8515625::DOUBLE - 18.6875::DOUBLE * pow(u, 1 / 78.84375::DOUBLE)), 1 / 0.1593017578125::DOUBLE)"
TRANSFER = {
    "to_srgb": "CASE WHEN u <= 0.0031308::DOUBLE THEN 12.92::DOUBLE * u ELSE 1.055::DOUBLE * pow(u, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END", "from_srgb": "CASE WHEN u <= 0.04045::DOUBLE THEN u / 12.92::DOUBLE ELSE pow((u + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END",
    "to_bt709": "CASE WHEN u <= 0.018::DOUBLE THEN 4.5::DOUBLE * u ELSE 1.099::DOUBLE * pow(u, 0.45::DOUBLE) - 0.099::DOUBLE END", "from_bt709": "CASE WHEN u <= 0.081::DOUBLE THEN u / 4.5::DOUBLE ELSE pow((u + 0.099::DOUBLE) / 1.099::DOUBLE, 1 / 0.45::DOUBLE) END",
    "to_pq": f"CASE WHEN u = 0 THEN 0 ELSE {_PQ} END", "from_pq": f"CASE WHEN u = 0 THEN 0 ELSE {_UNPQ} END",
    "to_hlg": "CASE WHEN u <= 1 / 12.0::DOUBLE THEN sqrt(3 * u) ELSE 0.17883277::DOUBLE * ln(greatest(12 * u - 0.28466892::DOUBLE, 1e-9)) + 0.5599107::DOUBLE END", "from_hlg": "CASE WHEN u <= 0.5 THEN u * u / 3 ELSE (exp((u - 0.5599107::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END",
}
for _name, _sql in TRANSFER.items():

    @query(f"tf_{_name}", f"WITH {EV} SELECT y, x, {fx(_sql)} AS v FROM ev")
    def _(spark, d, name=_name):
        return events_grid(spark, d).select("y", "x", fixed(getattr(colour, name)(F.col("u"))).alias("v"))


for _name, _e in (("gamma22", 2.2), ("gamma_dci", 2.6)):

    @query(f"tf_{_name}", f"WITH {EV} SELECT y, x, {fx(f'CASE WHEN u <= 1e-7 THEN 0 ELSE pow(u, {_e}::DOUBLE) END')} AS v FROM ev")
    def _(spark, d, e=_e):
        return events_grid(spark, d).select("y", "x", fixed(colour.gamma(F.col("u"), e)).alias("v"))


_plan = Plan.convert(Encoding(D65, SRGB, "srgb"), Encoding(D65, BT2100, "linear")).fused()
_m = next(w for k, w in _plan.steps if k == "matrix")
_lin = lambda c: f"(CASE WHEN {c} <= 0.04045::DOUBLE THEN {c} / 12.92::DOUBLE ELSE pow(({c} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
_fused = ", ".join(fx(" + ".join(f"({float(w)!r}::DOUBLE) * {_lin(n)}" for w, n in zip(row, "abc"))) + f" AS {c}" for row, c in zip(_m, "abc"))


@query("colour_plan", f"WITH {UNIT} SELECT y, x, {_fused} FROM c3")
def _(spark, d):
    return three(unit(spark, d), _plan.apply([F.col(c) for c in "abc"]))


_LUMA = [0.2126, 0.7152, 0.0722]
_Y = "(a * 0.2126::DOUBLE + b * 0.7152::DOUBLE + c * 0.0722::DOUBLE)"


@query("peak_luminance", f"WITH {UNIT} SELECT y // 16 AS strip, {fx(f'max({_Y})')} AS peak FROM c3 GROUP BY ALL")
def _(spark, d):
    y = F.col("a") * _LUMA[0] + F.col("b") * _LUMA[1] + F.col("c") * _LUMA[2]
    return unit(spark, d).groupBy(div(F.col("y"), 16).alias("strip")).agg(fixed(F.max(y)).alias("peak"))


def _tone_map_sql() -> str:
    lb, lw, lmin, lmax = (colour._pq_number(v / 4000, 4000) for v in (0, 4000, 0, 250))
    span = lw - lb
    low, high = (lmin - lb) / span, (lmax - lb) / span
    k = 1.5 * high - 0.5
    return f"""WITH {UNIT}, a0 AS (SELECT y, x, a, b, c, {_Y} AS lum, {_Y} * 0.4::DOUBLE AS u FROM c3),
a1 AS (SELECT *, ((CASE WHEN u = 0 THEN 0 ELSE {_PQ} END) - {lb!r}::DOUBLE) / {span!r}::DOUBLE AS e FROM a0), a2 AS (SELECT *, (e - {k!r}::DOUBLE) / {1 - k!r}::DOUBLE AS t FROM a1),
a3 AS (SELECT * EXCLUDE (e), CASE WHEN e < {k!r}::DOUBLE THEN e ELSE (2 * pow(t, 3) - 3 * t * t + 1) * {k!r}::DOUBLE + (pow(t, 3) - 2 * t * t + t) * {1 - k!r}::DOUBLE + (-2 * pow(t, 3) + 3 * t * t) * {high!r}::DOUBLE END AS e FROM a2),
a4 AS (SELECT y, x, a, b, c, lum, greatest((e + pow(1 - e, 4) * {low!r}::DOUBLE) * {span!r}::DOUBLE + {lb!r}::DOUBLE, 0) AS u FROM a3),
a5 AS (SELECT y, x, a, b, c, {_UNPQ} * 2.5::DOUBLE * 16 / CASE WHEN abs(lum) <= 1e-7 THEN 1 ELSE lum END AS ratio FROM a4)
SELECT y, x, {", ".join(fx(f"{c} * ratio") + f" AS {c}" for c in "abc")} FROM a5"""


@query("tone_map", _tone_map_sql())
def _(spark, d):
    return three(unit(spark, d), colour.tone_map([F.col(c) for c in "abc"], _LUMA, 4000.0, 250.0))


def _eetf_sql() -> str:
    lb, lw, lmin, lmax = (colour._pq_number(v / 4000, 4000) for v in (0, 4000, 0, 250))
    span = lw - lb
    low, high = (lmin - lb) / span, (lmax - lb) / span
    k = 1.5 * high - 0.5
    return f"""WITH {EV}, e AS (SELECT y, x, (u - {lb!r}::DOUBLE) / {span!r}::DOUBLE AS e FROM ev), t AS (SELECT *, (e - {k!r}::DOUBLE) / {1 - k!r}::DOUBLE AS t FROM e),
s AS (SELECT y, x, CASE WHEN e < {k!r}::DOUBLE THEN e ELSE (2 * pow(t, 3) - 3 * t * t + 1) * {k!r}::DOUBLE + (pow(t, 3) - 2 * t * t + t) * {1 - k!r}::DOUBLE + (-2 * pow(t, 3) + 3 * t * t) * {high!r}::DOUBLE END AS e FROM t)
SELECT y, x, {fx(f'(e + pow(1 - e, 4) * {low!r}::DOUBLE) * {span!r}::DOUBLE + {lb!r}::DOUBLE')} AS v FROM s"""


@query("eetf", _eetf_sql())
def _(spark, d):
    return events_grid(spark, d).select("y", "x", fixed(colour.eetf(F.col("u"), 4000.0, (0.0, 4000.0), (0.0, 250.0))).alias("v"))


@query("hlg_system_gamma", f"WITH {UNIT} SELECT y, x, " + ", ".join(fx(f"{c} * pow({_Y}, 0.2::DOUBLE)") + f" AS {c}" for c in "abc") + " FROM c3")
def _(spark, d):
    return three(unit(spark, d), colour.hlg_system([F.col(c) for c in "abc"], _LUMA, 1000.0))


def _gamut_sql() -> str:
    """Channel after channel; the share of grey for zero is carried along, as is that for one."""
    sql, table_, names = f"WITH {UNIT}, q AS (SELECT y AS r, x AS k, a * 1.6 - 0.2 AS a, b * 1.6 - 0.2 AS b, c * 1.6 - 0.2 AS c FROM c3), p0 AS (SELECT *, {_Y} AS l, 0.0::DOUBLE AS g, 0.0::DOUBLE AS o FROM q)", "p0", "abc"
    for i, n in enumerate(names, 1):
        sql += f", p{i}a AS (SELECT * REPLACE (CASE WHEN {n} - l >= 0 THEN g ELSE greatest(g, {n} / ({n} - l)) END AS g) FROM {table_}), p{i} AS (SELECT * REPLACE (greatest(o, CASE WHEN {n} - l <= 0 THEN g ELSE ({n} - 1) / ({n} - l) END) AS o) FROM p{i}a)"
        table_ = f"p{i}"
    sql += ", m AS (SELECT *, greatest(least(0.3::DOUBLE * (g - o) + o, 1), 0) AS x_, greatest(1, a, b, c) AS top FROM p3)"
    return sql + " SELECT r AS y, k AS x, " + ", ".join(fx(f"(x_ * (l - {n}) + {n}) / top") + f" AS {n}" for n in names) + " FROM m"


@query("gamut_map", _gamut_sql())
def _(spark, d):
    return three(unit(spark, d), colour.gamut([F.col(c) * 1.6 - 0.2 for c in "abc"], _LUMA, 0.3))
