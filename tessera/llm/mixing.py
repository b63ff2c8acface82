"""Mixing sources to target weights by Poisson replication (operator 7).

A source's mean repetition rate is its target share of the corpus over its present share.
Each document draws its number of copies from the Poisson distribution of that mean: the
distribution function is inverted at a uniform number from a hash of the seed and the
document's id, so the draw does not depend on order or partitioning.  Copies are dealt to
partitions by a hash and sorted by it: a global shuffle with one exchange.

A null source is a source of its own.  Documents without text have size 0; a source of
size 0 has rate 0.  A null id is replaced by a hash of the text.  Repeated rows draw alike.
Other columns are kept; `copy`, `n_copies` and `shuffle_key` replace columns of that name.
An empty table gives no rows.  Sources beside those named in `weights` get weight 0.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from .columns import slices, written


LARGE = 400  #: rates from here on start at LARGE_SPAN standard deviations below the mean; what lies before is below double precision
LARGE_SPAN = 12


def first_count(rate: Column) -> Column:
    """The count of the first threshold."""
    return F.when(rate > LARGE, F.floor(rate - LARGE_SPAN * F.sqrt(rate)).cast("int")).otherwise(0)


def poisson_thresholds(rate: Column) -> Column:
    """P(X <= j) for j = first_count(rate) and on, up to where the rest is below double precision: as many numbers as
    the distribution is wide, not as its mean is large."""
    low = first_count(rate)
    k = low.cast("double")
    log_factorial = F.when(low > 0, k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k) + 1 / (12 * k) - 1 / (360 * k * k * k)).otherwise(0.0)
    log_first = k * F.log(rate) - rate - log_factorial
    steps = F.sequence(low + 1, F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(log_first.alias("log_p"), F.array(F.exp(log_first)).alias("cdf"))

    def add(acc: Column, j: Column) -> Column:
        log_p = acc["log_p"] + F.log(rate / j)
        return F.struct(log_p.alias("log_p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + F.exp(log_p))).alias("cdf"))

    return F.when(rate > 0, F.aggregate(steps, start, add, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(source, rate): from given weights, or from sizes to the power of the temperature."""
    sizes = written(docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size")), "sizes")
    if weights is None:
        weight = F.sqrt("size") if temperature == 0.5 else F.pow("size", F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    total = sizes.where("size > 0").agg(F.sum("size"), F.sum(weight)).first()
    rate = weight / F.lit(total[1] or 1.0) * F.lit((total[0] or 0.0) * epochs) / F.col("size")
    return sizes.select(F.col("source").alias("source_"), F.when(F.col("size") > 0, rate).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with each row repeated as drawn, and `copy` (from 1), `n_copies`, `shuffle_key`, in shuffled order."""
    thresholds = written(rates(docs, weights, temperature, epochs).select("source_", first_count(F.col("rate")).alias("low_"), poisson_thresholds(F.col("rate")).alias("cdf_")), "thresholds")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    docs = docs.drop("copy", "n_copies", "shuffle_key").withColumn("u_", uniform(F.lit(str(seed)), id_))
    drawn = docs.join(thresholds, F.col("source").eqNullSafe(F.col("source_")))
    drawn = drawn.withColumn("n_copies", F.col("low_") + F.size(F.filter("cdf_", lambda c: c <= F.col("u_")))).where("n_copies > 0").drop("u_", "cdf_", "low_", "source_")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(str(seed)), id_, F.col("copy").cast("string"))))
    return copies.repartition(slices(docs), "shuffle_key").sortWithinPartitions("shuffle_key")
