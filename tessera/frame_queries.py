"""Registered queries of frames, patches and delta palettes: every user's events are the frames of an animation, or the patches of a frame."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.operators import compose as C, frontmove as M, noise as N, recurrence as R, samples as S, splines as P
from tessera.queries import PREDICTED, SECTIONS, fx, query, sections
from tessera.sources.grids import div, fixed, table

HEIGHT, WIDTH = 5, 6
_FRAME_MODES = (("replace", "add", "blend", "muladd", "mul"), ("replace", "mul", "blend", "muladd", "blend"))  # of the colour, of the alpha
_PATCH_MODES = (
    ("none", "replace", "add", "mul", "blend_above", "blend_below", "muladd_above", "muladd_below"),
    ("none", "replace", "mul", "replace", "blend_above", "blend_below", "muladd_above", "muladd_below"),
)


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def every_pixel(rows: DataFrame, height: int | str, width: int | str) -> DataFrame:
    """rows with c (two channels), y and x for each pixel."""
    for name, size in (("c", 2), ("y", height), ("x", width)):
        last = (F.col(size).cast("long") if isinstance(size, str) else F.lit(size).cast("long")) - 1
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows


_CLIP = "greatest(0.0, least(1.0, {0}))"
_OVER = "CASE WHEN pre THEN {h} + {l} * (1.0 - {ha}) WHEN 1.0 - (1.0 - {ha}) * (1.0 - {la}) > 0 THEN ({ha} * {h} + {la} * {l} * (1.0 - {ha})) / (1.0 - (1.0 - {ha}) * (1.0 - {la})) ELSE 0 END"


def images_of(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").select(F.col("user_id").alias("image")).distinct()
    return users.select("image", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"), F.lit(1).alias("colours"), F.array(F.col("image") % 2 == 0).alias("associated"))


@query(
    "canvas_compose",
    f"""WITH RECURSIVE f0 AS (SELECT user_id AS image, event_id AS e, row_number() OVER u AS k, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_last FROM events WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
fr AS (SELECT *, CASE WHEN e % 13 = 0 THEN 0 ELSE e % 4 - 1 END AS y0, CASE WHEN e % 13 = 0 THEN 0 ELSE e % 5 - 1 END AS x0, CASE WHEN e % 13 = 0 THEN {HEIGHT} ELSE 1 + e // 3 % 5 END AS h, CASE WHEN e % 13 = 0 THEN {WIDTH} ELSE 1 + e // 2 % 6 END AS w,
  CASE WHEN e % 13 = 0 THEN 'replace' ELSE {listed(_FRAME_MODES[0])}[e // 7 % 5 + 1] END AS mc, {listed(_FRAME_MODES[1])}[e // 5 % 5 + 1] AS ma, e % 3 + 1 AS sc, e // 4 % 4 + 1 AS sa_, e // 2 % 4 AS save, e % 3 = 0 AS shown, e % 11 <> 0 AS normal, e % 2 = 0 AS clamp, image % 2 = 0 AS pre FROM f0),
st AS (SELECT image, y, x, 0::BIGINT AS k, 0::BIGINT AS e, false AS out_, [0, 0, 0, 0]::DOUBLE[] AS sv, [0, 0, 0, 0]::DOUBLE[] AS sa, 0::DOUBLE AS v, 0::DOUBLE AS a FROM (SELECT DISTINCT user_id AS image FROM events), unnest(range({HEIGHT})) p(y), unnest(range({WIDTH})) q(x)
  UNION ALL SELECT image, y, x, k, e, out_, CASE WHEN saves THEN sv[:save] || [v] || sv[save + 2:] ELSE sv END, CASE WHEN saves THEN sa[:save] || [a] || sa[save + 2:] ELSE sa END, v, a FROM (
    SELECT *, CASE WHEN taken THEN CASE WHEN here THEN n ELSE 0 END WHEN NOT here THEN b ELSE CASE mc WHEN 'replace' THEN n WHEN 'add' THEN b + n WHEN 'mul' THEN b * CASE WHEN clamp THEN {_CLIP.format("n")} ELSE n END WHEN 'muladd' THEN b + ca * n ELSE {_OVER.format(h="n", l="b", ha="ca", la="ba")} END END AS v,
      CASE WHEN taken THEN CASE WHEN here THEN an ELSE 0 END WHEN NOT here THEN aa ELSE CASE ma WHEN 'replace' THEN an WHEN 'mul' THEN aa * ca WHEN 'blend' THEN aa + ca * (1.0 - aa) ELSE aa END END AS a FROM (
      SELECT st.image, st.y, st.x, fr.k, fr.e, normal AND (is_last OR shown) AS out_, sv, sa, mc, ma, save, clamp, pre, NOT is_last AND (NOT shown OR save <> 0) AS saves, sv[sc] AS b, sa[sc] AS ba, sa[sa_] AS aa,
        st.y >= y0 AND st.y < y0 + h AND st.x >= x0 AND st.x < x0 + w AS here, NOT normal OR mc = 'replace' AND y0 <= 0 AND x0 <= 0 AND y0 + h >= {HEIGHT} AND x0 + w >= {WIDTH} AS taken,
        ((fr.e * 7 + (st.y - y0) * 3 + (st.x - x0) * 5) % 17)::DOUBLE / 16 AS n, ((fr.e * 7 + (st.y - y0) * 3 + (st.x - x0) * 5 + 11) % 17)::DOUBLE / 16 AS an, CASE WHEN clamp THEN {_CLIP.format("an")} ELSE an END AS ca
      FROM st JOIN fr ON fr.image = st.image AND fr.k = st.k + 1)))
SELECT image, e AS frame_idx, CAST(c AS INT) AS c, y, x, {fx("CASE WHEN c = 0 THEN v ELSE a END")} AS v FROM st, unnest(range(2)) t(c) WHERE out_""",
)
def _(spark, d):
    e, frame = F.col("frame_idx"), F.struct
    whole = e % 13 == 0
    or_whole = lambda value, other: F.when(whole, F.lit(value)).otherwise(other)
    events = table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("frame_idx"))
    one = lambda mode, source: frame(mode.alias("mode"), source.cast("int").alias("source"), F.lit(0).alias("alpha"), (e % 2 == 0).alias("clamp"))
    frames = events.select(
        "image", "frame_idx", F.when(e % 11 == 0, "reference").otherwise("normal").alias("kind"),
        or_whole(0, e % 4 - 1).alias("y0"), or_whole(0, e % 5 - 1).alias("x0"), or_whole(HEIGHT, 1 + div(e, 3) % 5).alias("height"), or_whole(WIDTH, 1 + div(e, 2) % 6).alias("width"),
        F.when(e % 3 == 0, 1).otherwise(0).alias("duration"), (e == F.max(e).over(Window.partitionBy("image"))).alias("is_last"), (div(e, 2) % 4).cast("int").alias("save_as"),
        F.array(one(or_whole("replace", pick(_FRAME_MODES[0], div(e, 7) % 5)), e % 3), one(pick(_FRAME_MODES[1], div(e, 5) % 5), div(e, 4) % 4)).alias("blending"),
    )
    pixels = every_pixel(frames.select("image", "frame_idx", "height", "width"), "height", "width")
    samples = pixels.select("image", "frame_idx", "c", "y", "x", ((e * 7 + F.col("y") * 3 + F.col("x") * 5 + F.col("c") * 11) % 17 / 16.0).alias("v"))
    return C.compose(frames, samples, images_of(spark, d)).withColumn("v", fixed(F.col("v")))


@query(
    "patch_modes",
    f"""WITH RECURSIVE p0 AS (SELECT user_id AS image, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
pa AS (SELECT *, e % 2 AS ref, e // 2 % 4 AS ry, e // 3 % 4 AS rx, 1 + e // 5 % 4 AS h, 1 + e // 7 % 4 AS w, e // 11 % 6 - 1 AS ty, e // 13 % 7 - 1 AS tx, {listed(_PATCH_MODES[0])}[e // 2 % 8 + 1] AS mc, {listed(_PATCH_MODES[1])}[e // 16 % 8 + 1] AS ma, e % 4 < 2 AS clamp, image % 2 = 0 AS pre FROM p0),
st AS (SELECT image, y, x, 0::BIGINT AS k, ((image * 5 + y * 3 + x * 7) % 16)::DOUBLE / 16 AS v, ((image * 5 + y * 3 + x * 7 + 13) % 16)::DOUBLE / 16 AS a FROM (SELECT DISTINCT user_id AS image FROM events), unnest(range({HEIGHT})) p(y), unnest(range({WIDTH})) q(x)
  UNION ALL SELECT image, y, x, k, CASE WHEN NOT here THEN v ELSE CASE mc WHEN 'none' THEN v WHEN 'replace' THEN n WHEN 'add' THEN v + n WHEN 'mul' THEN v * CASE WHEN clamp THEN {_CLIP.format("n")} ELSE n END
      WHEN 'muladd_above' THEN v + ca * n WHEN 'muladd_below' THEN n + cb * v WHEN 'blend_above' THEN {_OVER.format(h="n", l="v", ha="ca", la="a")} ELSE {_OVER.format(h="v", l="n", ha="cb", la="an")} END END,
    CASE WHEN NOT here THEN a ELSE CASE ma WHEN 'replace' THEN an WHEN 'mul' THEN a * ca WHEN 'blend_above' THEN a + ca * (1.0 - a) WHEN 'blend_below' THEN an + cb * (1.0 - an) WHEN 'muladd_below' THEN an ELSE a END END FROM (
      SELECT st.image, st.y, st.x, pa.k, v, a, mc, ma, clamp, pre, st.y >= ty AND st.y < ty + h AND st.x >= tx AND st.x < tx + w AND st.y - ty + ry < 6 AND st.x - tx + rx < 6 AS here,
        ((st.image * 3 + ref * 5 + (st.y - ty + ry) * 7 + (st.x - tx + rx) * 11) % 16)::DOUBLE / 16 AS n, ((st.image * 3 + ref * 5 + (st.y - ty + ry) * 7 + (st.x - tx + rx) * 11 + 2) % 16)::DOUBLE / 16 AS an,
        CASE WHEN clamp THEN {_CLIP.format("an")} ELSE an END AS ca, CASE WHEN clamp THEN {_CLIP.format("a")} ELSE a END AS cb
      FROM st JOIN pa ON pa.image = st.image AND pa.k = st.k + 1))
SELECT image, CAST(c AS INT) AS c, y, x, {fx("CASE WHEN c = 0 THEN v ELSE a END")} AS v FROM (SELECT * FROM st QUALIFY k = max(k) OVER (PARTITION BY image)), unnest(range(2)) t(c)""",
)
def _(spark, d):
    e, images = F.col("idx"), images_of(spark, d)
    events = table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("idx"))
    one = lambda mode: F.struct(mode.alias("mode"), F.lit(0).alias("alpha"), (e % 4 < 2).alias("clamp"))
    patches = events.select(
        "image", "idx", (e % 2).cast("int").alias("ref"), (div(e, 2) % 4).cast("int").alias("y0"), (div(e, 3) % 4).cast("int").alias("x0"), (1 + div(e, 5) % 4).cast("int").alias("height"), (1 + div(e, 7) % 4).cast("int").alias("width"),
        (div(e, 11) % 6 - 1).alias("y"), (div(e, 13) % 7 - 1).alias("x"), F.array(one(pick(_PATCH_MODES[0], div(e, 2) % 8)), one(pick(_PATCH_MODES[1], div(e, 16) % 8))).alias("blending"),
    )
    at = lambda *weights: sum((F.col(c) * w for c, w in weights), F.lit(0)) % 16 / 16.0
    base = every_pixel(images.select("image"), HEIGHT, WIDTH).withColumn("v", at(("image", 5), ("y", 3), ("x", 7), ("c", 13)))
    references = every_pixel(images.select("image", F.explode(F.array(F.lit(0), F.lit(1))).alias("ref")), 6, 6).withColumn("v", at(("image", 3), ("ref", 5), ("y", 7), ("x", 11), ("c", 2)))
    return C.patched(base, patches, references, images).withColumns({"v": fixed(F.col("v")), "c": F.col("c").cast("int")})


@query(
    "patch_targets",
    f"""WITH {SECTIONS}, t AS (SELECT *, CASE WHEN place = 0 THEN size % 1000 ELSE xor((size % 64) >> 1, -(size % 64 & 1)) END AS dy, CASE WHEN place = 0 THEN size % 777 ELSE xor((size % 97) >> 1, -(size % 97 & 1)) END AS dx FROM sec)
SELECT image, place AS target, CAST(sum(dy) OVER o AS BIGINT) AS y, CAST(sum(dx) OVER o AS BIGINT) AS x FROM t WINDOW o AS (PARTITION BY image ORDER BY place)""",
)
def _(spark, d):
    first, size = F.col("place") == 0, F.col("size")
    tokens = sections(spark, d).select("image", F.lit(0).alias("patch"), F.col("place").alias("target"), F.when(first, size % 1000).otherwise(size % 64).alias("y"), F.when(first, size % 777).otherwise(size % 97).alias("x"))
    return C.patch_targets(tokens).drop("patch")


# ---- delta palettes: 120 orders are an image of 10 columns, with a palette of its own ----

_RESOLVED = f"""g AS (SELECT o_orderkey // 120 AS image, o_orderkey % 120 AS k, CAST(floor(o_totalprice) AS BIGINT) % 256 - 40 AS i FROM orders),
fixed(e, r, g, b) AS (VALUES {", ".join(str((k, *entry)) for k, entry in enumerate(S.DELTAS))}), deltas AS (SELECT e, 0 AS c, r AS v FROM fixed UNION ALL SELECT e, 1, g FROM fixed UNION ALL SELECT e, 2, b FROM fixed),
j AS (SELECT image, k, c, i, i - 25 AS beyond, (-i - 1) % 143 AS d FROM g, (SELECT unnest([0, 1, 2]) AS c)),
dv AS (SELECT image, k, j.c, i < 6 AS delta, CASE WHEN i < 0 THEN CASE WHEN d % 2 = 0 THEN -deltas.v ELSE deltas.v END WHEN i < 25 THEN (image * 13 + i * 37 + j.c * 91) % 256
  WHEN beyond < 64 THEN (beyond // CAST(pow(4, j.c) AS BIGINT)) % 4 * 255 // 4 + 32 ELSE ((beyond - 64) // CAST(pow(5, j.c) AS BIGINT)) % 5 * 255 // 4 END AS v FROM j LEFT JOIN deltas ON i < 0 AND e = (d + 1) // 2 AND deltas.c = j.c)"""


def delta_sql(predicted: str) -> str:
    return f"""WITH RECURSIVE {_RESOLVED},
st AS (SELECT DISTINCT image, c, -1::BIGINT AS k, []::BIGINT[] AS h FROM dv
  UNION ALL SELECT image, c, k, list_append(h, CASE WHEN delta THEN v + ({predicted}) ELSE v END) FROM (
    SELECT *, CASE WHEN y > 0 AND x < 9 THEN h[k - 8] ELSE n END AS ne, CASE WHEN y > 0 AND x < 8 THEN h[k - 7] WHEN y > 0 AND x < 9 THEN h[k - 8] ELSE n END AS nee, CASE WHEN x > 0 AND y > 0 THEN h[k - 10] ELSE w END AS nw, CASE WHEN y > 1 THEN h[k - 19] ELSE n END AS nn, CASE WHEN x > 1 THEN h[k - 1] ELSE w END AS ww FROM (
      SELECT *, CASE WHEN y > 0 THEN h[k - 9] ELSE w END AS n FROM (
        SELECT dv.image, dv.c, dv.k, h, delta, v, dv.k // 10 AS y, dv.k % 10 AS x, CASE WHEN dv.k % 10 > 0 THEN h[dv.k] WHEN dv.k >= 10 THEN h[dv.k - 9] ELSE 0 END AS w
        FROM st JOIN dv ON dv.image = st.image AND dv.c = st.c AND dv.k = st.k + 1))))
SELECT image, CAST(c AS INT) AS c, k // 10 AS y, k % 10 AS x, h[k + 1] AS v FROM st WHERE k >= 0"""


for _name in ("gradient", "avg_all", "select"):

    @query(f"delta_palette_{_name}", delta_sql(PREDICTED[_name]))
    def _(spark, d, predictor=_name):
        k = F.col("o_orderkey")
        grid = table(spark, d, "orders").select(div(k, 120).alias("image"), div(k % 120, 10).alias("y"), (k % 10).alias("x"), (F.floor("o_totalprice") % 256 - 40).alias("v"))
        entries = grid.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("idx")).select("image", "idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("c"))
        colours = entries.withColumn("v", (F.col("image") * 13 + F.col("idx") * 37 + F.col("c") * 91) % 256)
        return R.predicted_deltas(S.palette(grid, colours, 25, keys=("image",), n_deltas=6), predictor)


# ---- noise: 400 orders are a frame of 20 columns ----

_WORD = "18446744073709551616::UHUGEINT"


def _times(p: str, by: int) -> str:
    return f"CAST(CAST({p} AS UHUGEINT) * {by}::UHUGEINT % {_WORD} AS UBIGINT)"


def _scrambled(z: str) -> str:
    """The generator's mixing of 64 bits; each step binds its argument once."""
    first = f"list_transform([{z}], lambda u: {_times('xor(u, u >> 30)', int(N.MIX1))})"
    return f"list_transform(list_transform({first}, lambda u: {_times('xor(u, u >> 27)', int(N.MIX2))}), lambda u: xor(u, u >> 31))[1]"


def _seeded(high: str, low: str) -> str:
    return _scrambled(f"CAST((CAST({high} AS UHUGEINT) * 4294967296::UHUGEINT + CAST({low} AS UHUGEINT) + {int(N.GOLDEN)}::UHUGEINT) % {_WORD} AS UBIGINT)")


def _mirrored(at: str, size: str) -> str:
    return f"CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} >= {size} THEN 2 * {size} - 1 - ({at}) ELSE {at} END"


def _strength(v: str) -> str:
    scaled = f"greatest(({v}) * 3.0::DOUBLE, 0)"
    low = f"least(CAST(floor({scaled}) AS BIGINT), 7)"
    return f"((lut[least({low} + 1, 7) + 1] - lut[{low} + 1]) * ({scaled} - {low}) + lut[{low} + 1])"


@query(
    "noise_frames",
    f"""WITH RECURSIVE g AS (SELECT o_orderkey // 400 AS image, o_orderkey % 400 // 20 AS y, o_orderkey % 20 AS x, CAST(floor(o_totalprice) AS BIGINT) % 256 / 255.0::DOUBLE - 0.5 AS gx, o_custkey % 256 / 100.0::DOUBLE AS gy, o_orderkey % 256 / 255.0::DOUBLE AS gb FROM orders),
dims AS (SELECT image, max(y) + 1 AS h, max(x) + 1 AS w FROM g GROUP BY image),
grp AS (SELECT image, h, w, y0, x0, least(h - y0, 16) AS gh, least(w - x0, 16) AS gw FROM dims, unnest([0, 16]) a(y0), unnest([0, 16]) b(x0) WHERE y0 < h AND x0 < w),
ln AS (SELECT image, y0, x0, gh, gw, 0 AS lane, {_seeded("image * 3", "image % 2")} AS a, {_seeded("x0", "y0")} AS b FROM grp UNION ALL SELECT image, y0, x0, gh, gw, lane + 1, {_scrambled("a")}, {_scrambled("b")} FROM ln WHERE lane < 7),
st AS (SELECT image, y0, x0, gh, gw, lane, -1 AS k, a, b, 0::UBIGINT AS r FROM ln
  UNION ALL SELECT image, y0, x0, gh, gw, lane, k + 1, b, xor(xor(s, b), xor(s >> 18, b >> 5)), CAST((CAST(a AS UHUGEINT) + CAST(b AS UHUGEINT)) % {_WORD} AS UBIGINT) FROM (SELECT *, xor(a, {_times("a", 1 << 23)}) AS s FROM st WHERE k + 1 < 3 * gh)),
u AS (SELECT image, k // gh AS c, y0 + k % gh AS y, x0 + lane * 2 + part AS x, 1 + ((CASE WHEN part = 0 THEN r % 4294967296 ELSE r >> 32 END) >> 9)::DOUBLE / 8388608 AS n FROM st, unnest([0, 1]) t(part) WHERE k >= 0 AND lane * 2 + part < gw),
f AS (SELECT image, y, x, max(CASE WHEN c = 0 THEN n END) AS n0, max(CASE WHEN c = 1 THEN n END) AS n1, max(CASE WHEN c = 2 THEN n END) AS n2 FROM u GROUP BY ALL),
around AS (SELECT f.image, f.y, f.x, {_mirrored("f.y + dy", "h")} AS sy, {_mirrored("f.x + dx", "w")} AS sx FROM f JOIN dims USING (image), unnest(range(-2, 3)) a(dy), unnest(range(-2, 3)) b(dx)),
s AS (SELECT a.image, a.y, a.x, sum(0.16::DOUBLE * f.n0) AS s0, sum(0.16::DOUBLE * f.n1) AS s1, sum(0.16::DOUBLE * f.n2) AS s2 FROM around a JOIN f ON f.image = a.image AND f.y = a.sy AND f.x = a.sx GROUP BY ALL),
m AS (SELECT image, y, x, s0 - 4 * n0 AS n0, s1 - 4 * n1 AS n1, s2 - 4 * n2 AS n2 FROM s JOIN f USING (image, y, x)),
l AS (SELECT *, list_transform(range(8), lambda k: (image % 5 + k)::DOUBLE / 10) AS lut FROM g JOIN m USING (image, y, x)),
pq AS (SELECT *, 0.22::DOUBLE * {_strength("gy + gx")} * (0.0078125::DOUBLE * n0 + 0.9921875::DOUBLE * n2) AS p, 0.22::DOUBLE * {_strength("gy - gx")} * (0.0078125::DOUBLE * n1 + 0.9921875::DOUBLE * n2) AS q FROM l)
SELECT image, y, x, {fx("gx + 0.25 * (p + q) + p - q")} AS x_, {fx("gy + p + q")} AS y_, {fx("gb + 0.9 * (p + q)")} AS b_ FROM pq""",
)
def _(spark, d):
    k = F.col("o_orderkey")
    grid = table(spark, d, "orders").select(div(k, 400).alias("image"), div(k % 400, 20).alias("y"), (k % 20).alias("x"), (F.floor("o_totalprice") % 256 / 255.0 - 0.5).alias("x_"), (F.col("o_custkey") % 256 / 100.0).alias("y_"), (k % 256 / 255.0).alias("b_"))
    lut = F.array(*(((F.col("image") % 5 + i) / 10.0) for i in range(8)))
    frames = grid.groupBy("image").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")).withColumns({"visible": F.col("image") * 3, "invisible": F.col("image") % 2, "lut": lut})
    return N.with_noise(grid, frames, correlation=(0.25, 0.9), group=16).select("image", "y", "x", *(fixed(F.col(c)).alias(c) for c in ("x_", "y_", "b_")))


# ---- move to front ----


@query(
    "move_to_front_inverse",
    """WITH RECURSIVE t AS (SELECT user_id AS owner, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, CAST(floor(value * 100) AS BIGINT) % 7 * (event_id % 3) AS v FROM events),
st AS (SELECT DISTINCT owner, -1::BIGINT AS place, -1::BIGINT AS v, range(256) AS l FROM t
  UNION ALL SELECT st.owner, t.place, st.l[t.v + 1], [st.l[t.v + 1]] || st.l[:t.v] || st.l[t.v + 2:] FROM st JOIN t ON t.owner = st.owner AND t.place = st.place + 1)
SELECT owner, place, CAST(v AS INT) AS v FROM st WHERE place >= 0""",
)
def _(spark, d):
    """Every user's events are tokens; blocks of 16 and levels of 4 of them, so that all levels have work."""
    at = Window.partitionBy("user_id").orderBy("event_id")
    tokens = table(spark, d, "events").select(F.col("user_id").alias("owner"), (F.row_number().over(at) - 1).cast("long").alias("place"), (F.floor(F.col("value") * 100) % 7 * (F.col("event_id") % 3)).alias("v"))
    return M.undone(tokens, block=16, fan=4)


# ---- splines: one eighth of a user's events are the points of a curve on a canvas of 24 x 16 ----


def _lerp(a: str, b: str, start: str, stop: str) -> str:
    return f"({a} + ({b} - {a}) * ((t - {start}) / ({stop} - {start})))"


def _curve_sql(c: str) -> str:
    a = [_lerp(f"{c}{j}", f"{c}{j + 1}", f"t{j}", f"t{j + 1}") for j in range(3)]
    b = [_lerp(a[j], a[j + 1], f"t{j}", f"t{j + 2}") for j in range(2)]
    return f"CASE WHEN step = 0 THEN {c}1 ELSE {_lerp(b[0], b[1], 't1', 't2')} END AS {c}"


def _wave_sql(kind: int) -> str:
    """Coefficient k of a kind: ((spline * 7 + k * 3 + kind * 5) % 13 - 6) / (10 * (k + 1)), the sigma's first 0.6 more."""
    first = f"((image * 7 + spline * 3 + {kind} * 5) % 13 - 6) / 10.0::DOUBLE" if kind < 3 else "0.6::DOUBLE"
    return f"({first} + list_sum(list_transform(range(1, 32), lambda k: sqrt(2::DOUBLE) * (((image * 7 + spline * 3 + k * 3 + {kind} * 5) % 13 - 6) / ({10 if kind < 3 else 100}.0::DOUBLE * (k + 1))) * cos(k * (pi() / 32) * (spot + 0.5)))))"


_ERF = f"sign({{0}}) * (1 - 1 / pow(1 + abs({{0}}) * ({P.ERF[0]}::DOUBLE + abs({{0}}) * ({P.ERF[1]}::DOUBLE + abs({{0}}) * ({P.ERF[2]}::DOUBLE + abs({{0}}) * {P.ERF[3]}::DOUBLE))), 4))"


@query(
    "spline_drawn",
    f"""WITH e AS (SELECT user_id AS image, event_id % 8 AS spline, event_id AS k, (event_id * 11 % 16)::DOUBLE AS y, (event_id * 7 % 24)::DOUBLE AS x FROM events),
own AS (SELECT * FROM (SELECT *, coalesce(lag(y) OVER o = y AND lag(x) OVER o = x, false) AS again FROM e WINDOW o AS (PARTITION BY image, spline ORDER BY k)) WHERE NOT again),
p0 AS (SELECT image, spline, row_number() OVER o - 1 AS i, lag(y) OVER o AS ya, y AS y1, lead(y) OVER o AS y2, lead(y, 2) OVER o AS yd, lag(x) OVER o AS xa, x AS x1, lead(x) OVER o AS x2, lead(x, 2) OVER o AS xd FROM own WINDOW o AS (PARTITION BY image, spline ORDER BY k)),
p1 AS (SELECT *, coalesce(ya, 2 * y1 - y2) AS y0, coalesce(yd, 2 * y2 - y1) AS y3, coalesce(xa, 2 * x1 - x2) AS x0, coalesce(xd, 2 * x2 - x1) AS x3 FROM p0),
p2 AS (SELECT *, 0::DOUBLE AS t0, pow(pow(y1 - y0, 2) + pow(x1 - x0, 2), 0.25) AS t1, pow(pow(y2 - y1, 2) + pow(x2 - x1, 2), 0.25) AS g2, pow(pow(y3 - y2, 2) + pow(x3 - x2, 2), 0.25) AS g3 FROM p1),
p3 AS (SELECT *, t1 + g2 AS t2, t1 + g2 + g3 AS t3, unnest(CASE WHEN x2 IS NULL THEN [0] ELSE range(16) END) AS step FROM p2),
ln AS (SELECT image, spline, i * 16 + step AS n, {_curve_sql("y")}, {_curve_sql("x")} FROM (SELECT *, t1 + step / 16.0::DOUBLE * (t2 - t1) AS t FROM p3)),
pc AS (SELECT *, lag(y) OVER o AS yb, lag(x) OVER o AS xb, lead(n) OVER o IS NULL AS final, coalesce(sqrt(pow(y - lag(y) OVER o, 2) + pow(x - lag(x) OVER o, 2)), 0) AS size FROM ln WINDOW o AS (PARTITION BY image, spline ORDER BY n)),
l1 AS (SELECT *, sum(size) OVER (PARTITION BY image, spline ORDER BY n) AS stop FROM pc),
l2 AS (SELECT *, coalesce(lag(stop) OVER o, 0) AS start, max(stop) OVER (PARTITION BY image, spline) AS arc FROM l1 WINDOW o AS (PARTITION BY image, spline ORDER BY n)),
dots AS (SELECT image, spline, 0 AS dot, y, x, 1::DOUBLE AS length, arc FROM l2 WHERE yb IS NULL
  UNION ALL SELECT image, spline, k, yb + (y - yb) * ((k - start) / (stop - start)), xb + (x - xb) * ((k - start) / (stop - start)), 1, arc FROM (SELECT *, unnest(range(CAST(floor(start) AS BIGINT) + 1, CAST(floor(stop) AS BIGINT) + 1)) AS k FROM l2)
  UNION ALL SELECT image, spline, CAST(floor(stop) AS BIGINT) + 1, y, x, stop - floor(stop), arc FROM l2 WHERE final),
lit AS (SELECT *, {_wave_sql(0)} * length AS vx, {_wave_sql(1)} * length AS vy, {_wave_sql(2)} * length AS vb, {_wave_sql(3)} AS sigma FROM (SELECT *, 31.0::DOUBLE * CASE WHEN arc > 0 THEN least(1.0, dot / arc) ELSE 1.0 END AS spot FROM dots)),
re AS (SELECT *, sqrt(2 * (3 * ln(10::DOUBLE) + greatest(0.01, vx, vy, vb))) * abs(sigma) AS reach FROM lit WHERE sigma <> 0),
px AS (SELECT *, unnest(range(greatest(0, CAST(floor(x - reach + 0.5) AS BIGINT)), least(24, CAST(floor(x + reach + 1.5) AS BIGINT)))) AS qx FROM re), py AS (SELECT *, unnest(range(greatest(0, CAST(floor(y - reach + 0.5) AS BIGINT)), least(16, CAST(floor(y + reach + 1.5) AS BIGINT)))) AS qy FROM px),
s AS (SELECT *, 0.5 * sqrt(pow(qx - x, 2) + pow(qy - y, 2)) AS far FROM py),
f AS (SELECT image, qy AS y, qx AS x, sum(vx * soft) AS ax, sum(vy * soft) AS ay, sum(vb * soft) AS ab FROM (
  SELECT *, 0.25 * sigma * pow({_ERF.format("((far + sqrt(0.125::DOUBLE)) / sigma)")} - {_ERF.format("((far - sqrt(0.125::DOUBLE)) / sigma)")}, 2) AS soft FROM s) GROUP BY ALL),
g AS (SELECT image, y, x FROM (SELECT DISTINCT user_id AS image FROM events), unnest(range(16)) a(y), unnest(range(24)) b(x))
SELECT g.image, g.y, g.x, {fx("coalesce(ax, 0) + (g.y + g.x) / 40.0::DOUBLE")} AS x_, {fx("coalesce(ay, 0)")} AS y_, {fx("coalesce(ab, 0)")} AS b_ FROM g LEFT JOIN f USING (image, y, x)""",
)
def _(spark, d):
    e = F.col("event_id")
    points = table(spark, d, "events").select(F.col("user_id").alias("image"), (e % 8).alias("spline"), e.alias("k"), (e * 11 % 16).alias("y"), (e * 7 % 24).alias("x"))

    def coefficients(kind: int):
        value = lambda k: ((F.col("image") * 7 + F.col("spline") * 3 + k * 3 + kind * 5) % 13 - 6) / ((10.0 if kind < 3 else 100.0) * (k + 1))
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.when((k == 0) & F.lit(kind == 3), 0.6).otherwise(value(k)))

    splines = points.select("image", "spline").distinct().select("image", "spline", *(coefficients(k).alias(c) for k, c in enumerate(("x_dct", "y_dct", "b_dct", "sigma_dct"))))
    images = points.select("image").distinct()
    grid = images.select("image", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("x"))
    grid = grid.select("image", "y", "x", ((F.col("y") + F.col("x")) / 40.0).alias("x_"), F.lit(0.0).alias("y_"), F.lit(0.0).alias("b_"))
    found = P.drawn(grid, points, splines, images.select("image", F.lit(16).alias("height"), F.lit(24).alias("width")))
    return found.select("image", "y", "x", *(fixed(F.col(c)).alias(c) for c in ("x_", "y_", "b_")))
