"""Progressive input: chunks of files arrive as a stream; sections become complete as bytes come in."""

from pyspark.sql import DataFrame, functions as F

CHUNKS = "image_id string, offset long, size long"


def received(chunks: DataFrame) -> DataFrame:
    """(image_id, bytes): the running total of each image.  Works on a batch and on a stream (update or complete mode)."""
    return chunks.groupBy("image_id").agg(F.sum("size").alias("bytes"))


def section_states(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """sections (image_id, section, offset, size) with the bytes filled so far and whether that is all."""
    filled = F.greatest(F.least(F.coalesce("bytes", F.lit(0)) - F.col("offset"), F.col("size")), F.lit(0))
    return sections.join(totals, "image_id", "left").select("image_id", "section", filled.alias("filled"), (filled == F.col("size")).alias("complete"))


def follow(chunks: DataFrame, sections: DataFrame, table: str, checkpoint: str):
    """Start a query that keeps the state of every section of the images that got bytes in the last batch."""

    def write(totals: DataFrame, batch: int) -> None:
        section_states(sections.join(totals.select("image_id"), "image_id", "left_semi"), totals).withColumn("batch", F.lit(batch)).write.mode("append").parquet(table)

    return received(chunks).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
