"""Registered queries of variable-size blocks, with DuckDB SQL that computes the same from the definitions."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import blockinfo as I, matrices as M, orders as O, varblocks as V
from tessera.queries import fx, query
from tessera.sources.grids import fixed, table

_KINDS = "kinds(kind, h, w) AS (VALUES " + ", ".join(f"({k}, {h}, {w})" for k, (h, w) in enumerate(V.CELLS)) + ")"
_SPECIAL = (V.HORNUSS, V.DCT2, V.DCT4, V.DCT4X8, V.DCT8X4, *V.AFV)


def blocks_sql(kind: str) -> str:
    """Samples of all embeddings as blocks of the kind (an expression of vec_id): block, kind, y, x, v."""
    basis = ", ".join(f"({k}, {p}, {x!r}::DOUBLE)" for k, row in enumerate(V.afv_basis().tolist()) for p, x in enumerate(row) if abs(x) > 1e-12)
    return f"""WITH {_KINDS}, ab(k, p, b) AS (VALUES {basis}),
b0 AS (SELECT vec_id AS block, kind, h, w, embedding::DOUBLE[] AS e FROM embeddings JOIN kinds ON kind = {kind}),
cs AS (SELECT n, k, i, CASE WHEN k = 0 THEN 1 ELSE sqrt(2) * cos(pi() * k * (2 * i + 1) / (2 * n)) END AS b FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256]) AS n) s, unnest(range(n)) a(k), unnest(range(n)) c(i)),
lf AS (SELECT block, h, w, i // w AS y, i % w AS x, e[(i * 5) % 64 + 1] AS v FROM b0, unnest(range(h * w)) t(i)),
l1 AS (SELECT block, h, w, y, k AS c, sum(v * b / w) AS v FROM lf JOIN cs ON n = w AND i = x GROUP BY ALL),
l2 AS (SELECT block, h, w, k AS r, c, sum(v * b / h) AS v FROM l1 JOIN cs ON n = h AND i = y GROUP BY ALL),
l3 AS (SELECT block, r, c, v / CASE WHEN r = 0 THEN 1 ELSE sin(pi() * r / (2 * h)) / (8 * sin(pi() * r / (16 * h))) END / CASE WHEN c = 0 THEN 1 ELSE sin(pi() * c / (2 * w)) / (8 * sin(pi() * c / (16 * w))) END AS v FROM l2),
c AS (SELECT block, kind, h, w, r, c, l3.v FROM l3 JOIN b0 USING (block) UNION ALL
  SELECT block, kind, h, w, n // (8 * w) AS r, n % (8 * w) AS c, e[n + 1] AS v FROM b0, unnest(range(64)) t(n) WHERE n // (8 * w) >= h OR n % (8 * w) >= w),
d1 AS (SELECT block, kind, h, r, i AS x, sum(v * b) AS v FROM c JOIN cs ON n = 8 * w AND k = c WHERE kind NOT IN {_SPECIAL} GROUP BY ALL),
d2 AS (SELECT block, kind, i AS y, x, sum(v * b) AS v FROM d1 JOIN cs ON n = 8 * h AND k = r GROUP BY ALL),
sp AS (SELECT *, max(CASE WHEN r = 0 AND c = 0 THEN v END) OVER q AS c00, max(CASE WHEN r = 0 AND c = 1 THEN v END) OVER q AS c01, max(CASE WHEN r = 1 AND c = 0 THEN v END) OVER q AS c10, max(CASE WHEN r = 1 AND c = 1 THEN v END) OVER q AS c11
  FROM c WHERE kind IN {_SPECIAL} WINDOW q AS (PARTITION BY block)),
s4 AS (SELECT block, kind, r, c, CASE WHEN r + c = 0 THEN c00 + c01 + c10 + c11 WHEN r = 0 AND c = 1 THEN c00 - c01 + c10 - c11 WHEN r = 1 AND c = 0 THEN c00 + c01 - c10 - c11 WHEN r = 1 AND c = 1 THEN c00 - c01 - c10 + c11 ELSE v END AS v FROM sp),
dct4 AS (SELECT block, kind, 4 * (r % 2) + a.i AS y, 4 * (c % 2) + z.i AS x, sum(v * a.b * z.b) AS v FROM s4 JOIN cs a ON a.n = 4 AND a.k = c // 2 JOIN cs z ON z.n = 4 AND z.k = r // 2 WHERE kind = {V.DCT4} GROUP BY ALL),
hq AS (SELECT *, max(CASE WHEN r < 2 AND c < 2 THEN v END) OVER q AS first, max(CASE WHEN r // 2 = 1 AND c // 2 = 1 THEN v END) OVER q AS inner_, sum(v) OVER q AS total FROM s4 WHERE kind = {V.HORNUSS} WINDOW q AS (PARTITION BY block, r % 2, c % 2)),
horn AS (SELECT block, kind, 4 * (r % 2) + r // 2 AS y, 4 * (c % 2) + c // 2 AS x, first - (total - first) / 16 + CASE WHEN r < 2 AND c < 2 THEN inner_ WHEN r // 2 = 1 AND c // 2 = 1 THEN 0 ELSE v END AS v FROM hq),
t1 AS (SELECT block, kind, r, c, CASE WHEN c = 0 AND r = 0 THEN c00 + c10 WHEN c = 0 AND r = 1 THEN c00 - c10 ELSE v END AS v FROM sp WHERE kind IN ({V.DCT4X8}, {V.DCT8X4})),
t2 AS (SELECT block, kind, 4 * (r % 2) + a.i AS y, z.i AS x, sum(v * a.b * z.b) AS v FROM t1 JOIN cs a ON a.n = 4 AND a.k = r // 2 JOIN cs z ON z.n = 8 AND z.k = c GROUP BY ALL),
halves AS (SELECT block, kind, CASE WHEN kind = {V.DCT8X4} THEN x ELSE y END AS y, CASE WHEN kind = {V.DCT8X4} THEN y ELSE x END AS x, v FROM t2),
fl AS (SELECT *, (kind - {V.AFV[0]}) // 2 AS fy, (kind - {V.AFV[0]}) % 2 AS fx FROM sp WHERE kind IN {V.AFV}),
a1 AS (SELECT block, kind, fy, fx, p // 4 AS i, p % 4 AS j, sum(CASE WHEN r + c = 0 THEN 4 * (c00 + c01 + c10) ELSE v END * b) AS v FROM fl JOIN ab ON k = 2 * r + c // 2 WHERE r % 2 = 0 AND c % 2 = 0 GROUP BY ALL),
a2 AS (SELECT block, kind, fy, fx, a.i AS i, z.i AS j, sum(CASE WHEN r = 0 AND c = 1 THEN c00 - c01 + c10 ELSE v END * a.b * z.b) AS v FROM fl JOIN cs a ON a.n = 4 AND a.k = c // 2 JOIN cs z ON z.n = 4 AND z.k = r // 2 WHERE r % 2 = 0 AND c % 2 = 1 GROUP BY ALL),
a3 AS (SELECT block, kind, fy, fx, a.i AS i, z.i AS j, sum(CASE WHEN r = 1 AND c = 0 THEN c00 - c10 ELSE v END * a.b * z.b) AS v FROM fl JOIN cs a ON a.n = 4 AND a.k = r // 2 JOIN cs z ON z.n = 8 AND z.k = c WHERE r % 2 = 1 GROUP BY ALL),
afv AS (SELECT block, kind, 4 * fy + CASE WHEN fy = 1 THEN 3 - i ELSE i END AS y, 4 * fx + CASE WHEN fx = 1 THEN 3 - j ELSE j END AS x, v FROM a1 UNION ALL
  SELECT block, kind, 4 * fy + i, 4 * (1 - fx) + j, v FROM a2 UNION ALL SELECT block, kind, 4 * (1 - fy) + i, j, v FROM a3),
m1 AS (SELECT block, kind, r, c, CASE WHEN r + c = 0 THEN c00 + c01 + c10 + c11 WHEN r = 0 AND c = 1 THEN c00 - c01 + c10 - c11 WHEN r = 1 AND c = 0 THEN c00 + c01 - c10 - c11 WHEN r = 1 AND c = 1 THEN c00 - c01 - c10 + c11 ELSE v END AS v FROM sp WHERE kind = {V.DCT2}),
{_haar_level("m1", "m2", 2)}, {_haar_level("m2", "m3", 4)},
allv AS (SELECT * FROM d2 UNION ALL SELECT * FROM dct4 UNION ALL SELECT * FROM horn UNION ALL SELECT * FROM halves UNION ALL SELECT * FROM afv UNION ALL SELECT block, kind, r AS y, c AS x, v FROM m3)
SELECT block, CAST(kind AS INT) AS kind, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {fx("v")} AS v FROM allv"""


def _haar_level(source: str, name: str, half: int) -> str:
    """Each sample of the corner of 2 half x 2 half is a signed sum of the four coefficients a half apart."""
    return f"""{name} AS (SELECT s.block, s.kind, s.r, s.c, CASE WHEN s.r < {2 * half} AND s.c < {2 * half}
  THEN sum(t.v * CASE WHEN (s.r % 2 = 1 AND t.r >= {half}) <> (s.c % 2 = 1 AND t.c >= {half}) THEN -1 ELSE 1 END) ELSE max(CASE WHEN t.r = s.r AND t.c = s.c THEN t.v END) END AS v
  FROM {source} s JOIN {source} t ON s.block = t.block AND CASE WHEN s.r < {2 * half} AND s.c < {2 * half} THEN t.r % {half} = s.r // 2 AND t.c % {half} = s.c // 2 AND t.r < {2 * half} AND t.c < {2 * half} ELSE t.r = s.r AND t.c = s.c END
  GROUP BY s.block, s.kind, s.r, s.c)"""


def block_samples(spark, d: str, kind) -> DataFrame:
    """Embeddings as the first coefficients of blocks, and again, shuffled, as the means of their cells."""
    cells = F.get(F.array(*(F.lit(h * w) for h, w in V.CELLS)), F.col("kind"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), kind.cast("int").alias("kind"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.withColumn("lf", F.transform(F.sequence(F.lit(0), cells - 1), lambda i: F.get("v", i * 5 % 64)))
    return V.placed(V.transformed(e, lf="lf")).select("block", "kind", "y", "x", fixed(F.col("v")).alias("v"))


#: All 27 kinds, those beyond 32 x 32 less often.
_MIXED = "CASE WHEN vec_id % 64 < 27 THEN vec_id % 64 ELSE vec_id % 18 END"

for _name, _kind in (("varblocks", _MIXED), ("dct4_special", str(V.DCT4)), ("hornuss_special", str(V.HORNUSS)), ("dct4x8_special", f"CASE WHEN vec_id % 2 = 0 THEN {V.DCT4X8} ELSE {V.DCT8X4} END"), ("afv_special", f"{V.AFV[0]} + vec_id % 4")):
    query(_name, blocks_sql(_kind))(lambda spark, d, k=_kind: block_samples(spark, d, F.expr(k)))

_LINES = [(1, 256), (256, 1), (2, 128), (128, 2), (4, 64), (64, 4), (8, 32), (32, 8), (16, 16)]


@query(
    "dct_sizes",
    f"""WITH sizes(k, h, w) AS (VALUES {", ".join(f"({k}, {h}, {w})" for k, (h, w) in enumerate(_LINES))}),
g AS (SELECT vec_id // 4 AS line, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS e FROM embeddings GROUP BY ALL HAVING count(*) = 4),
s AS (SELECT line, h, w, i // w AS y, i % w AS x, e[i + 1] AS v FROM g JOIN sizes ON k = line % {len(_LINES)}, unnest(range(256)) t(i)),
cs AS (SELECT n, k, i, CASE WHEN k = 0 THEN 1 ELSE sqrt(2) * cos(pi() * k * (2 * i + 1) / (2 * n)) END AS b FROM (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256]) AS n) s, unnest(range(n)) a(k), unnest(range(n)) c(i)),
r AS (SELECT line, h, w, y, k AS x, sum(v * b / w) AS v FROM s JOIN cs ON n = w AND i = x GROUP BY ALL),
c AS (SELECT line, h, w, k AS y, x, sum(v * b / h) AS v FROM r JOIN cs ON n = h AND i = y GROUP BY ALL)
SELECT line, CAST(y * w + x AS BIGINT) AS n, {fx("v")} AS v FROM c""",
)
def _(spark, d):
    """Forward transforms of 1 x 256 to 256 x 1, nine sizes in one plan."""
    e = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("line")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("four"))
    size = lambda k: F.get(F.array(*(F.lit(s[k]) for s in _LINES)), (F.col("line") % len(_LINES)).cast("int"))
    lines = e.where(F.size("four") == 4).select("line", size(0).alias("h"), size(1).alias("w"), F.flatten(F.transform("four", lambda x: x["e"])).alias("v"))
    found = V.line_transform(lines).select("line", F.posexplode("v").alias("n", "v"))
    return found.select("line", F.col("n").cast("long").alias("n"), fixed(F.col("v")).alias("v"))


# ---- block metadata: the lines of a supplier and one eighth of the orders are the blocks of a group ----

_MIXES = ((0, 1, 2, 3), (0, 6, 8, 12), (4, 4, 4, 4), (0, 7, 0, 0))  # one cell; one column; squares of 2 x 2, and rows of two, some of which do not fit
_LUT = tuple(k / 7 for k in range(8))
_LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
_PLACED = f"""WITH RECURSIVE {_KINDS},
li AS (SELECT *, l_suppkey * 8 + l_orderkey % 8 AS g FROM lineitem),
b AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY {", ".join(_LINE_ORDER)}) AS idx, [{", ".join(map(str, (list(m) for m in _MIXES)))}][g % 4 + 1][(l_orderkey + l_linenumber) % 4 + 1] AS kind, l_linenumber - CASE WHEN l_orderkey % 997 = 0 THEN 9 ELSE 0 END AS mul FROM li),
st AS (SELECT DISTINCT g, 3 + g % 3 AS bh, 6 + g % 5 * 8 AS bw, 0::BIGINT AS idx, 0 AS kind, 0::BIGINT AS hf_mul, 0::BIGINT AS y, 0::BIGINT AS x, NULL::VARCHAR AS error, list_transform(range(6 + g % 5 * 8), lambda k: 0::BIGINT) AS sky FROM li
  UNION ALL SELECT g, bh, bw, idx, kind, CASE WHEN e IS NULL THEN mul + 1 END, CASE WHEN e IS NULL THEN y END, CASE WHEN e IS NULL THEN x END, e, sky[:x] || list_transform(range(w), lambda k: y + h) || sky[x + w + 1:] FROM (
    SELECT *, CASE WHEN mul < 0 THEN 'multiplier' WHEN x % 32 + w > 32 OR y % 32 + h > 32 THEN 'border' WHEN len(list_filter(sky[x + 1:x + w], lambda t: t > y)) > 0 THEN 'overlap' WHEN x + w > bw OR y + h > bh THEN 'outside' END AS e FROM (
      SELECT st.g, bh, bw, b.idx, b.kind, b.mul, h, w, sky, list_min(sky) AS y, list_position(sky, list_min(sky)) - 1 AS x FROM st JOIN b ON st.g = b.g AND b.idx = st.idx + 1 JOIN kinds ON kinds.kind = b.kind WHERE error IS NULL AND list_min(sky) < bh))),
placed AS (SELECT g, idx - 1 AS idx, kind, hf_mul, y, x, error FROM st WHERE idx > 0 UNION ALL
  SELECT g, NULL, NULL, NULL, NULL, NULL, 'short' FROM (SELECT g, bh, arg_max(sky, idx) AS sky, count(error) AS wrong FROM st GROUP BY g, bh) WHERE wrong = 0 AND list_min(sky) < bh)"""


def placed_blocks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks laid on the groups' grids, and the groups."""
    lines, g = table(spark, d, "lineitem").withColumn("g", F.col("l_suppkey") * 8 + F.col("l_orderkey") % 8), F.col("g")
    at = Window.partitionBy("g").orderBy(*_LINE_ORDER)
    mix = F.get(F.array(*(F.array(*map(F.lit, m)) for m in _MIXES)), (g % 4).cast("int"))
    mul = F.col("l_linenumber") - F.when(F.col("l_orderkey") % 997 == 0, 9).otherwise(0)
    blocks = lines.select("g", (F.row_number().over(at) - 1).alias("idx"), F.get(mix, ((F.col("l_orderkey") + F.col("l_linenumber")) % 4).cast("int")).alias("kind"), mul.alias("mul"))
    groups = lines.select("g").distinct().select("g", (3 + g % 3).cast("int").alias("bh"), (6 + g % 5 * 8).cast("int").alias("bw"))
    return I.place(blocks, groups, ("g",)), groups


@query("block_places", f"{_PLACED} SELECT g, idx, CAST(kind AS INT) AS kind, CAST(hf_mul AS BIGINT) AS hf_mul, CAST(y AS INT) AS y, CAST(x AS INT) AS x, error FROM placed")
def _(spark, d):
    return placed_blocks(spark, d)[0].withColumnsRenamed({"by": "y", "bx": "x"})


@query(
    "block_sigma",
    f"""{_PLACED}, cells AS (SELECT g, y + dy AS cy, x + dx AS cx, idx, kind, hf_mul, dy = 0 AND dx = 0 AS first FROM placed JOIN kinds USING (kind), unnest(range(h)) a(dy), unnest(range(w)) c(dx) WHERE error IS NULL)
SELECT g, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, idx, CAST(kind AS INT) AS kind, first, {fx("0.46 * 65536.0 / (1000 + g) / hf_mul * ((cy * 7 + cx * 3 + g) % 8) / 7.0")} AS sigma FROM cells""",
)
def _(spark, d):
    placed, groups = placed_blocks(spark, d)
    sharp = groups.select("g", "bw", F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("cy")).select("g", "cy", F.explode(F.sequence(F.lit(0), F.col("bw") - 1)).alias("cx"))
    sharp = sharp.withColumn("sharpness", (F.col("cy") * 7 + F.col("cx") * 3 + F.col("g")) % 8)
    found = I.sigmas(I.cells(placed, ("g",)), sharp, ("g",), 0.46, F.col("g") + 1000, _LUT)
    return found.select("g", F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx"), "idx", "kind", "first", fixed(F.col("sigma")).alias("sigma"))


# ---- dequantisation matrices ----

_BAND_ROWS = ", ".join(f"({s}, {c}, {g}, {k}, {v!r}::DOUBLE)" for (s, g), channels in sorted(M.default_lists().items()) for c, values in enumerate(channels) for k, v in enumerate(values))
_PARAM_ROWS = ", ".join(f"({s}, {c}, {[float(v) for v in values]}::DOUBLE[])" for s, channels in M.PARAMS.items() for c, values in enumerate(channels))
_LOW, _HIGH = M.AFV_FREQUENCIES[2], M.AFV_FREQUENCIES[15]


def _banded(grid: str, distance: str, top: str) -> str:
    """The interpolated value of a grid's bands at a distance."""
    return f"(SELECT list_extract(l, 1 + CAST(floor(({distance}) / ({top}) * (len(l) - 1)) AS INT)) * pow(list_extract(l, 2 + CAST(floor(({distance}) / ({top}) * (len(l) - 1)) AS INT)) / list_extract(l, 1 + CAST(floor(({distance}) / ({top}) * (len(l) - 1)) AS INT)), ({distance}) / ({top}) * (len(l) - 1) - floor(({distance}) / ({top}) * (len(l) - 1))) FROM (SELECT l{grid} AS l))"


_DIAGONAL = "sqrt(2::DOUBLE) + 1e-6::DOUBLE"


@query(
    "dequant_matrices",
    f"""WITH {_KINDS}, bands(s, c, g, k, v) AS (VALUES {_BAND_ROWS}), params(s, c, p) AS (VALUES {_PARAM_ROWS}), sets(kind, s) AS (VALUES {", ".join(map(str, enumerate(M.SET_OF_KIND)))}),
shapes(s, mh, mw) AS (VALUES {", ".join(f"({s}, {h}, {w})" for s, (h, w) in enumerate(M.SHAPES))}),
lev AS (SELECT s, c, g, list(level ORDER BY k) AS l FROM (SELECT s, c, g, k, product(CASE WHEN k = 0 THEN v WHEN v > 0 THEN 1 + v ELSE 1 / (1 - v) END) OVER (PARTITION BY s, c, g ORDER BY k) AS level FROM bands) GROUP BY ALL),
b AS (SELECT vec_id AS block, kind, vec_id // 64 % 3 AS c, h, w, s, mh, mw, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings JOIN kinds ON kind = {_MIXED} JOIN sets USING (kind) JOIN shapes USING (s)),
pl AS (SELECT *, CASE WHEN h > w THEN n % (8 * w) ELSE n // (8 * w) END AS y, CASE WHEN h > w THEN n // (8 * w) ELSE n % (8 * w) END AS x FROM b),
j AS (SELECT pl.*, l0.l AS l0, l1.l AS l1, l2.l AS l2, p, list_extract([{", ".join(map(str, M.AFV_FREQUENCIES))}]::DOUBLE[], CAST(y // 2 * 4 + x // 2 + 1 AS INT)) AS f FROM pl LEFT JOIN lev l0 ON l0.s = pl.s AND l0.c = pl.c AND l0.g = 0 LEFT JOIN lev l1 ON l1.s = pl.s AND l1.c = pl.c AND l1.g = 1 LEFT JOIN lev l2 ON l2.s = pl.s AND l2.c = pl.c AND l2.g = 2 LEFT JOIN params ON params.s = pl.s AND params.c = pl.c),
m AS (SELECT block, kind, c, n, v, CASE
  WHEN y = 0 AND x = 0 AND s IN ({M.HORNUSS}, {M.DCT2}, {M.AFV}) THEN 1
  WHEN s = {M.HORNUSS} THEN CASE WHEN y + x = 1 THEN p[2] WHEN y = 1 AND x = 1 THEN p[3] ELSE p[1] END
  WHEN s = {M.DCT2} THEN p[1 + CASE WHEN greatest(y, x) < 2 THEN 0 WHEN greatest(y, x) < 4 THEN 2 ELSE 4 END + CASE WHEN least(y, x) >= CASE WHEN greatest(y, x) < 2 THEN 1 WHEN greatest(y, x) < 4 THEN 2 ELSE 4 END THEN 1 ELSE 0 END]
  WHEN s = {M.DCT4} THEN {_banded("0", "sqrt(pow(x // 2 / 3.0::DOUBLE, 2) + pow(y // 2 / 3.0::DOUBLE, 2))", _DIAGONAL)}
  WHEN s = {M.DCT4X8} THEN {_banded("0", "sqrt(pow(x / 7.0::DOUBLE, 2) + pow(y // 2 / 3.0::DOUBLE, 2))", _DIAGONAL)}
  WHEN s = {M.AFV} THEN CASE WHEN y = 1 AND x = 0 THEN p[1] WHEN y = 0 AND x = 1 THEN p[2] WHEN y = 2 AND x = 0 THEN p[3] WHEN y = 0 AND x = 2 THEN p[4] WHEN y = 2 AND x = 2 THEN p[5]
    WHEN y % 2 = 1 THEN {_banded("0", "sqrt(pow(x / 7.0::DOUBLE, 2) + pow(y // 2 / 3.0::DOUBLE, 2))", _DIAGONAL)} WHEN x % 2 = 1 THEN {_banded("1", "sqrt(pow(x // 2 / 3.0::DOUBLE, 2) + pow(y // 2 / 3.0::DOUBLE, 2))", _DIAGONAL)} ELSE {_banded("2", f"f - {_LOW}", f"{_HIGH} - {_LOW} + 1e-6::DOUBLE")} END
  ELSE {_banded("0", "sqrt(pow(x / (mw - 1.0::DOUBLE), 2) + pow(y / (mh - 1.0::DOUBLE), 2))", _DIAGONAL)} END AS weight FROM j)
SELECT block, CAST(kind AS INT) AS kind, c AS channel, n, {fx("floor(v * 1000000) * (1 / weight)")} AS v FROM m""",
)
def _(spark, d):
    """Embeddings as quantised coefficients of blocks of all kinds, and what the format's matrices make of them."""
    made = M.matrices(*M.default_tables(spark))
    coefficients = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * 1000000).cast("double"))
    blocks = table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), F.expr(_MIXED).cast("int").alias("kind"), F.floor(F.col("vec_id") / 64).alias("channel"), coefficients.alias("v")).withColumn("channel", F.col("channel") % 3)
    found = M.dequantised(blocks, made).select("block", "kind", "channel", F.posexplode("v").alias("n", "v"))
    return found.select("block", "kind", "channel", F.col("n").cast("long").alias("n"), fixed(F.col("v")).alias("v"))


_SHAPES = ", ".join(f"({k}, {h}, {w})" for k, (h, w) in enumerate(O.SHAPES))


@query(
    "coefficient_orders",
    f"""WITH shapes(order_id, h, w) AS (VALUES {_SHAPES}),
cells AS (SELECT order_id, h, w, n, n // w AS y, n % w AS x, n % w + (n // w) * (w // h) AS line FROM shapes, unnest(range(h * w)) t(n)),
o AS (SELECT order_id, y, x, row_number() OVER (PARTITION BY order_id ORDER BY CASE WHEN y < h // 8 AND x < w // 8 THEN n - 100000 ELSE line END, CASE WHEN line % 2 = 0 THEN x ELSE -x END) - 1 AS place FROM cells),
e AS (SELECT vec_id AS block, vec_id % 13 AS order_id, vec_id % 3 AS channel, place, embedding[place + 1]::DOUBLE AS v FROM embeddings, unnest(range(64)) t(place))
SELECT block, CAST(e.order_id AS INT) AS order_id, CAST(channel AS INT) AS channel, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {fx("v")} AS v
FROM e JOIN o ON o.order_id = e.order_id AND o.place = CASE WHEN channel = 1 THEN xor(e.place, 1) ELSE e.place END""",
)
def _(spark, d):
    """The first 64 coefficients of blocks of all shapes, laid out by coded orders: channel 1 swaps neighbours."""
    natural = O.natural_orders(spark)
    swapped = natural.select("order_id", F.lit(1).alias("channel"), "place", F.col("place").bitwiseXOR(F.lit(1)).alias("source"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("block"), (F.col("vec_id") % 13).cast("int").alias("order_id"), (F.col("vec_id") % 3).cast("int").alias("channel"), F.posexplode(F.slice(F.col("embedding").cast("array<double>"), 1, 64)).alias("place", "v"))
    found = O.placed(e.withColumn("place", F.col("place").cast("long")), O.coded_orders(natural, swapped))
    return found.select("block", "order_id", "channel", "y", "x", fixed(F.col("v")).alias("v"))
