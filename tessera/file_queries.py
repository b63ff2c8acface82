"""Registered queries of files: every customer has a small image file, made of its key's digest; and of rows and sections of files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import samples as S
from tessera.queries import RGB, SECTIONS, fx, query, sections
from tessera.sources import container, sinks
from tessera.sources.grids import div, fixed, rgb_grid, table
from tessera.streaming import progressive

#: Boxes of each kind of file: type, first bytes in hexadecimal, and which of the digest's characters follow (from 1 on; number).
FILES = {
    1: [("Exif", "00000004", 1, 8), ("jxlc", "FF0A", 1, 32)],
    2: [("jxlp", "00000000FF0A", 1, 10), ("xml ", "3C782F3E", 1, 0), ("jxlp", "80000001", 11, 22)],
    3: [("jxlp", "00000001", 1, 32), ("jxlp", "80000000FF0A", 1, 0)],
    4: [("brob", "45786966", 1, 32), ("jxlp", "00000000FF0A", 1, 32)],
}


def customer_files(spark: SparkSession, d: str) -> DataFrame:
    """image_id, bytes: bare codestreams and containers."""
    text = F.md5(F.col("c_custkey").cast("string"))
    raw = lambda hexes: F.unhex(F.lit(hexes))
    rest = lambda start, n: F.encode(F.substring(text, start, n), "utf-8")
    whole = F.concat(raw(container.BARE), rest(1, 32))
    for kind, listed in FILES.items():
        parts = [raw(container.CONTAINER)]
        for name, head, start, n in listed:
            parts += [raw(f"{8 + len(head) // 2 + n:08X}" + name.encode().hex()), raw(head), rest(start, n)]
        whole = F.when(F.col("c_custkey") % 5 == kind, F.concat(*parts)).otherwise(whole)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), whole.alias("bytes"))


_BOXES = "boxes(kind, box_seq, type, head, start, n) AS (VALUES " + ", ".join(f"({kind}, {k}, '{name}', '{head}', {start}, {n})" for kind, listed in FILES.items() for k, (name, head, start, n) in enumerate([("JXL ", container.CONTAINER[16:], 1, 0), *listed])) + ")"
_CUSTOMERS = f"{_BOXES}, cu AS (SELECT c_custkey AS image_id, c_custkey % 5 AS kind, md5(CAST(c_custkey AS VARCHAR)) AS text FROM customer), bx AS (SELECT image_id, CAST(box_seq AS INT) AS box_seq, type, head || hex(substr(text, start, n)) AS payload FROM cu JOIN boxes USING (kind))"


@query("container_boxes", f"WITH {_CUSTOMERS} SELECT * FROM bx")
def _(spark, d):
    return container.boxes(customer_files(spark, d)).withColumn("payload", F.hex("payload"))


@query(
    "container_codestreams",
    f"""WITH {_CUSTOMERS} SELECT image_id, CASE kind WHEN 3 THEN hex(text) || 'FF0A' ELSE 'FF0A' || hex(text) END AS codestream, CASE kind WHEN 3 THEN 'parts out of order' WHEN 4 THEN 'last part is missing or not the last' END AS problem FROM cu""",
)
def _(spark, d):
    return container.codestreams(customer_files(spark, d)).withColumn("codestream", F.hex("codestream"))


@query(
    "container_side_boxes",
    f"""WITH {_CUSTOMERS} SELECT image_id, box_seq, CASE type WHEN 'brob' THEN 'Exif' ELSE type END AS type, CASE type WHEN 'brob' THEN substr(payload, 9) ELSE payload END AS payload, CASE type WHEN 'brob' THEN 'compressed' END AS problem FROM bx WHERE type NOT IN ('jxlc', 'jxlp', 'JXL ')""",
)
def _(spark, d):
    return container.side_boxes(container.boxes(customer_files(spark, d))).withColumn("payload", F.hex("payload"))


@query("container_exif", f"WITH {_CUSTOMERS} SELECT image_id, 4::BIGINT AS tiff_offset, substr(payload, 9) AS tiff FROM bx WHERE type = 'Exif'")
def _(spark, d):
    return container.exif(container.boxes(customer_files(spark, d))).withColumn("tiff", F.hex("tiff"))


@query("interleaved_rows", f"WITH {RGB} SELECT y, string_agg(printf('%02X%02X%02X', a, b, c), '' ORDER BY x) AS row_ FROM rgb GROUP BY y")
def _(spark, d):
    rows = sinks.interleaved(rgb_grid(spark, d).withColumn("image_id", F.lit(0)), ["a", "b", "c"])
    return rows.select("y", F.hex("row").alias("row_"))


@query(
    "section_fill",
    f"""WITH {SECTIONS}, o AS (SELECT image, place, size, coalesce(sum(size) OVER (PARTITION BY image ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sec),
t AS (SELECT o_orderkey AS image, CAST(floor(o_totalprice / 3) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 7 <> 0)
SELECT CAST(image AS VARCHAR) AS image_id, place AS section, CAST(greatest(least(coalesce(bytes, 0) - start, size), 0) AS BIGINT) AS filled, greatest(least(coalesce(bytes, 0) - start, size), 0) = size AS complete FROM o LEFT JOIN t USING (image)""",
)
def _(spark, d):
    """Sections of which a third of an order's price has arrived, in two chunks; nothing of every seventh."""
    own = S.offsets(sections(spark, d), "image", "place", "size").select(F.col("image").cast("string").alias("image_id"), F.col("place").alias("section"), "offset", "size")
    whole = F.floor(F.col("o_totalprice") / 3)
    chunks = table(spark, d, "orders").where("o_orderkey % 7 != 0").select(F.col("o_orderkey").cast("string").alias("image_id"), F.explode(F.array(F.floor(whole / 2), whole - F.floor(whole / 2))).alias("size"))
    return progressive.section_states(own, progressive.received(chunks))


@query("image_peak", f"WITH {RGB} SELECT y, x, {fx('max(0.2126 * a + 0.7152 * b + 0.0722 * c) OVER (PARTITION BY y // 7)')} AS peak FROM rgb")
def _(spark, d):
    """Seven rows are an image: the largest luminance of each, on every sample."""
    grid = rgb_grid(spark, d).withColumn("image", div(F.col("y"), 7))
    lit = 0.2126 * F.col("a") + 0.7152 * F.col("b") + 0.0722 * F.col("c")
    return S.with_peak(grid, lit, ("image",)).select("y", "x", fixed(F.col("peak")).alias("peak"))
