"""Image files as tables: signature, boxes, codestream, side boxes.

Files come from Spark's binaryFile reader.  A small Python generator walks the box headers of
one file; everything else is column expressions.
"""

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: First bytes of a bare codestream and of a container (fixed values of the format).
BARE, CONTAINER = "FF0A", "0000000C4A584C200D0A870A"


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_id"), F.col("content").alias("bytes"))


def kind(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 12))
    return F.when(F.substring(head, 1, 4) == BARE, "bare").when(head == CONTAINER, "container").otherwise("invalid")


def boxes(images: DataFrame) -> DataFrame:
    """(image_id, box_seq, type, payload) of containers; a box cut short is left out."""

    def walk(data: bytes):
        at = 0
        while at + 8 <= len(data):
            size, name = struct.unpack(">I4s", data[at : at + 8])
            head = 8
            if size == 1:
                if at + 16 > len(data):
                    return
                size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
            end = len(data) if size == 0 else at + size
            if end > len(data) or end < at + head:
                return
            yield name.decode("latin-1"), data[at + head : end]
            at = end

    def run(batches):
        for batch in batches:
            rows = [(i, k, *b) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, b in enumerate(walk(data or b""))]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["image_id", "box_seq", "type", "payload"])

    key = images.schema["image_id"].dataType.simpleString()
    return images.where(kind(F.col("bytes")) == "container").select("image_id", "bytes").mapInArrow(run, f"image_id {key}, box_seq int, type string, payload binary")


def codestreams(images: DataFrame) -> DataFrame:
    """(image_id, codestream, problem): the bare file, the one `jxlc` box, or the `jxlp` parts in order;
    part numbers must count from 0 in file order, and the top bit marks the last part and no other."""
    bare = images.where(kind(F.col("bytes")) == "bare").select("image_id", F.col("bytes").alias("codestream"), F.lit(None).cast("string").alias("problem"))
    parts = boxes(images).where(F.col("type").isin("jxlc", "jxlp"))
    number = F.conv(F.hex(F.substring("payload", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    w = Window.partitionBy("image_id").orderBy("box_seq")
    top = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int") >= 128
    parts = parts.withColumns({"place": F.row_number().over(w) - 1, "number": F.when(F.col("type") == "jxlp", number).otherwise(0), "last": F.when(F.col("type") == "jxlp", top).otherwise(True), "final": F.lead("box_seq").over(w).isNull()})
    body = F.when(F.col("type") == "jxlp", F.expr("substring(payload, 5)")).otherwise(F.col("payload"))
    whole = parts.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", body.alias("body")))).alias("parts"), F.bool_and(F.col("place") == F.col("number")).alias("ordered"), F.bool_and(F.col("last") == F.col("final")).alias("ended"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["body"]))
    return bare.union(whole.select("image_id", joined.alias("codestream"), F.when(~F.coalesce("ordered", F.lit(False)), "parts out of order").when(~F.coalesce("ended", F.lit(False)), "last part is missing or not the last")))


def side_boxes(found: DataFrame) -> DataFrame:
    """(image_id, box_seq, type, payload, problem) of all boxes but the codestream's, the signature and the file type.  A `brob` box has the type that stands in
    its first four bytes; its payload stays as it is, and the problem says so: `compressed`, or for a type that must not be, `may not be compressed`."""
    packed, inner = F.col("type") == "brob", F.decode(F.substring("payload", 1, 4), "iso-8859-1")
    barred = inner.startswith("jxl") | inner.isin("brob", "jbrd")
    problem = F.when(packed, F.when(F.length("payload") < 4, "cut short").when(barred, "may not be compressed").otherwise("compressed"))
    rows = found.where(~F.col("type").isin("jxlc", "jxlp", "JXL ", "ftyp"))
    return rows.select("image_id", "box_seq", F.when(packed, inner).otherwise(F.col("type")).alias("type"), F.when(packed, F.expr("substring(payload, 5)")).otherwise(F.col("payload")).alias("payload"), problem.alias("problem"))


def first_box(found: DataFrame, name: str) -> DataFrame:
    """The first box of a type of each image (Exif, xml)."""
    w = Window.partitionBy("image_id").orderBy("box_seq")
    return found.where(F.col("type") == name).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def exif(found: DataFrame) -> DataFrame:
    """Offset of the TIFF header, and the payload behind the four bytes that say so."""
    offset = F.conv(F.hex(F.substring("payload", 1, 4)), 16, 10).cast("long")
    return first_box(found, "Exif").select("image_id", offset.alias("tiff_offset"), F.expr("substring(payload, 5)").alias("tiff"))


def bits(data: Column, at: int, n: int) -> Column:
    """n bits from bit `at` on, least significant first; a fixed place needs no cursor."""
    first, last = at // 8, (at + n - 1) // 8
    byte = lambda k: F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("long")
    total = byte(first)
    for k in range(first + 1, last + 1):
        total = total + byte(k) * (1 << (8 * (k - first)))
    return F.shiftright(total, at % 8).bitwiseAND(F.lit((1 << n) - 1))


def sizes(streams: DataFrame) -> DataFrame:
    """(image_id, width, height) of codestreams whose header has the short form or one of the four long forms."""
    from tessera.functions.bits import ratio_width

    data = F.col("codestream")
    small = bits(data, 16, 1) == 1
    # after the flag: five bits of height / 8 - 1, or a selector of 9, 13, 18 or 30 bits of height - 1
    forms = [(small, (bits(data, 17, 5) + 1) * 8, 22, 5, 8)] + [(~small & (bits(data, 17, 2) == s), bits(data, 19, n) + 1, 19 + n, n, 1) for s, n in enumerate((9, 13, 18, 30))]
    height, width = F.lit(None).cast("long"), F.lit(None).cast("long")
    for test, h, at, n, unit in forms:
        ratio = bits(data, at, 3)
        if unit == 8:
            own = (bits(data, at + 3, 5) + 1) * 8
        else:
            selector = bits(data, at + 3, 2)
            own = F.lit(None).cast("long")
            for s, m in enumerate((9, 13, 18, 30)):
                own = F.when(selector == s, bits(data, at + 5, m) + 1).otherwise(own)
        width = F.when(test, F.when(ratio == 0, own).otherwise(ratio_width(ratio, h))).otherwise(width)
        height = F.when(test, h).otherwise(height)
    return streams.select("image_id", width.alias("width"), height.alias("height"))
