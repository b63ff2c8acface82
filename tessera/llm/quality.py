"""Quality rules (operator 10; DataFrame functions only).

The verdict is a log-likelihood ratio: words and word pairs are hashed into BUCKETS bins;
the bins' relative frequencies in trusted texts and in all texts are two multinomials, and
a text's score is the mean log ratio of its n-grams' bins.  Every text whose score is below
THRESHOLD (nats an n-gram) goes, and every text that fails the base rules.

The raw multinomial counts every text.  The trusted one counts the texts of at most TRUSTED
labelled documents (those of smallest id hash): a bounded sample, so its ids can be sent to
all tasks.  The model is BUCKETS numbers, whatever the size of the corpus.

Null and empty texts have no words: all statistics 0, base_failed true, score 0.  Rows are
judged one by one, so repeated rows and ties do not matter; other columns are kept, but those
of the results' names replaced.  Without trusted
texts both multinomials are flat to each other and every score is 0.  Windows of words are
compared by a 64-bit hash of their words' 64-bit hashes within one text.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .columns import let

BLANKS = "\t\n\x0b\x0c\r"  #: white space, beside the blank
BUCKETS, TRUSTED, THRESHOLD = 1 << 14, 20_000, -0.1  #: BUCKETS: a power of two


def in_bin(gram: Column, buckets: int) -> Column:
    return gram.bitwiseAND(F.lit(buckets - 1))


def spaced(text: Column) -> Column:
    """The text with every white-space character as a blank: it splits at one character, without a regular expression."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def words(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def pairs(h: Column) -> Column:
    """A hash of each word's hash and the next one's."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + 1]))


def repeated_window_words(h: Column, p: Column, width: int = 5) -> Column:
    """Words in windows of five words that occur twice or more in the array; h: hashes of the words, p: of pairs of neighbours."""

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("at"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["g"] == x["g"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["g"] == x["g"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["at"]))

        # each window covers its words up to the next repeated window, the last one all of its words
        gaps = lambda at: F.aggregate(
            F.transform(at, lambda x, i: F.when(i < F.size(at) - 1, F.least(F.lit(width), at[F.least(i + 1, F.size(at) - 1)] - x)).otherwise(F.lit(width))), F.lit(0), lambda a, b: a + b
        )
        return let(let(placed, twice), gaps)

    windows = F.transform(F.slice(h, width, F.size(h)), lambda x, i: F.xxhash64(p[i], p[i + 2], x))
    return F.when(F.size(h) < width, F.lit(0)).otherwise(let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))


def statistics(df: DataFrame, text: str = "text", model: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and (with a model: the bins' log ratios) `llr`.

    Words are hashed once.  All comes out of a generator of one row, so that filters on the results stay above it
    and nothing is computed twice."""

    def of_hashes(t: Column, s: Column, h: Column, p: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" " + BLANKS))) > 0)
        columns = {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(F.replace(s, F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_window_words(h, p).cast("long"),
        }
        if model is not None:
            total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + model[in_bin(x, buckets)])
            columns["llr"] = F.when(F.size(h) == 0, F.lit(0.0)).otherwise((total(h) + total(p)) / (F.size(h) + F.size(p)))
        return F.struct(*(c.alias(n) for n, c in columns.items()))

    hashed = lambda s: F.transform(F.array_remove(F.split(s, " "), ""), lambda w: F.xxhash64(w))
    found = let(F.coalesce(F.col(text), F.lit("")), lambda t: let(spaced(t), lambda s: let(hashed(s), lambda h: let(pairs(h), lambda p: of_hashes(t, s, h, p)))))
    df = df.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr").select("*", F.inline(F.array(found)))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED) -> list[float]:
    """The model: the log ratio of each bin, from one pass over all texts."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(trusted)  # at most `trusted` ids
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), words(F.coalesce(F.col("text"), F.lit(""))).alias("own"))
    rows = rows.join(F.broadcast(good), F.col("id") == F.col("good_id"), "left").select(F.inline(F.arrays_zip(F.col("own").alias("one"), F.slice("own", 2, F.size("own")).alias("next"))), F.col("good_id").isNotNull().alias("good"))
    rows = rows.select(F.xxhash64("one").alias("h"), F.when(F.col("next").isNotNull(), F.xxhash64("next")).alias("then"), "good")
    rows = rows.select(F.explode(F.array("h", F.when(F.col("then").isNotNull(), F.xxhash64("h", "then")))).alias("gram"), "good").where("gram IS NOT NULL")
    counts = rows.groupBy(in_bin(F.col("gram"), buckets).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    table = counts.toPandas().set_index("bin").reindex(range(buckets), fill_value=0)  # one row for each bin
    smooth = lambda x: (x + 1.0) / (x.sum() + buckets)
    if not table["target"].sum():
        return [0.0] * buckets
    import numpy as np

    return np.log(smooth(table["target"].to_numpy()) / smooth(table["raw"].to_numpy())).round(6).tolist()


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted: int = TRUSTED) -> DataFrame:
    """docs with the statistics, `llr` (the score) and `kept`."""
    model = F.split(F.lit(",".join(map(str, log_ratios(docs, labels, buckets, trusted)))), ",").cast("array<double>")  # folded into one constant
    df = statistics(docs, model=model, buckets=buckets)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
