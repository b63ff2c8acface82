"""Line dedup over repeated runs of lines (operator 5; DataFrame functions only).

The corpus is one sequence of line ids (blank lines left out, documents apart, in order of
document).  Prefix doubling names every suffix by its first 2**k lines: level k + 1 pairs
the names at i and i + 2**k, and a name is the position of its first occurrence.  Suffixes
whose name is theirs alone drop out, so the levels shrink to what repeats.  A name's
suffixes are an interval of the suffix array whose longest common prefix is 2**k or more;
two overlapping names give the interval of any length.

A run of lines counts as a passage from MIN_WORDS words on.  A line goes if a passage that
covers it occurred before: it is covered then by the shortest passage that starts at some
line or the shortest that ends at some line, so only these windows are looked up.  Since a
line in the sequence has a word, a window has MIN_WORDS lines at most.

Lines are compared without the white space at their ends.  Null texts stay null.  Documents
are told apart by id and text; rows repeated in full share their fate, and the copy that
counts as the first is that with the smaller (id, text hash), null ids first.  Other
columns are kept; `n_removed` replaces a column of that name.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .columns import let, running_sums, written

MIN_WORDS = 50
DOC = ["d", "v"]


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """d, v, q (place in the sequence), line (place in the text), h1, h2, ahead and back: lines of
    the shortest passage that starts, or ends, here (null if there is none)."""

    def described(text: Column) -> Column:
        one = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), F.size(F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), "")).alias("n"))
        trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
        return F.filter(F.transform(trimmed, one), lambda s: s["n"] > 0)

    def spans(lines: Column) -> Column:
        sums = running_sums(F.transform(lines, lambda s: s["n"]))  # words before each line, and all
        return let(sums, lambda c: F.transform(lines, lambda s, i: F.struct(s["line"].alias("line"), s["h1"].alias("h1"), s["h2"].alias("h2"), forward(c, i).alias("ahead"), backward(c, i).alias("back"))))

    def forward(c: Column, i: Column) -> Column:
        short = F.filter(F.sequence(i + 1, F.least(i + min_words, F.size(c) - 1)), lambda j: c[j] - c[i] < min_words)
        return F.when(F.element_at(c, -1) - c[i] >= min_words, F.size(short) + 1)

    def backward(c: Column, i: Column) -> Column:
        short = F.filter(F.sequence(F.greatest(i + 1 - min_words, F.lit(0)), i), lambda j: c[i + 1] - c[j] < min_words)
        return F.when(c[i + 1] >= min_words, F.size(short) + 1)

    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("v"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("d", "v", F.posexplode(let(described(F.col("text")), spans)).alias("q", "s")).select("d", "v", "q", "s.*")


def renamed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of names that more than one suffix has: d, v, q and the name, the first position."""
    position = F.struct("d", "v", "q")
    names = rows.groupBy(keys).agg(F.min(position).alias("low"), F.max(position).alias("high")).where("low != high")
    named = names.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("low").alias("name"))
    same = F.col(keys[0]) == F.col(f"{keys[0]}_")
    for k in keys[1:]:
        same = same & (F.col(k) == F.col(f"{k}_"))
    return rows.join(named, same).select("d", "v", "q", "name")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, v, line): lines of later copies of passages."""
    lines = written(lines_of(docs, min_words).distinct(), "lines")
    level = written(renamed(lines, ["h1", "h2"]), "names-0")
    names, width, k = level.withColumn("k", F.lit(0)), 1, 0
    while 2 * width <= min_words and not level.isEmpty():
        right = level.select(F.col("d").alias("rd"), F.col("v").alias("rv"), (F.col("q") - width).alias("rq"), F.col("name").alias("then"))
        pairs = level.join(right, F.col("d").eqNullSafe(F.col("rd")) & (F.col("v") == F.col("rv")) & (F.col("q") == F.col("rq"))).select("d", "v", "q", "name", "then")
        width, k = 2 * width, k + 1
        level = written(renamed(pairs.withColumnRenamed("name", "now"), ["now", "then"]), f"names-{k}")
        names = names.union(level.withColumn("k", F.lit(k)))
    log2 = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")  # noqa: E731  exact for small powers of two
    starts = lines.where("ahead IS NOT NULL").select("d", "v", "q", F.col("ahead").alias("n"))
    ends = lines.where("back IS NOT NULL").select("d", "v", (F.col("q") + 1 - F.col("back")).alias("q"), F.col("back").alias("n"))
    windows = starts.union(ends).distinct().withColumn("k", log2(F.col("n")))
    windows = windows.withColumn("q2", F.col("q") + F.col("n") - F.pow(F.lit(2.0), F.col("k")).cast("int"))
    for place, name in (("q", "a"), ("q2", "b")):
        side = names.select(F.col("d").alias("nd"), F.col("v").alias("nv"), F.col("q").alias("nq"), F.col("k").alias("nk"), F.col("name").alias(name))
        same = F.col("d").eqNullSafe(F.col("nd")) & (F.col("v") == F.col("nv")) & (F.col(place) == F.col("nq")) & (F.col("k") == F.col("nk"))
        windows = windows.join(side, same).drop("nd", "nv", "nq", "nk")
    windows = written(windows, "windows")
    first = windows.groupBy("a", "b", "n").agg(F.min(F.struct("d", "v", "q")).alias("first")).select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("n").alias("fn"), "first")
    later = windows.join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")) & (F.col("n") == F.col("fn"))).where(~F.struct("d", "v", "q").eqNullSafe(F.col("first")))
    covered = later.select("d", "v", F.explode(F.sequence(F.col("q"), F.col("q") + F.col("n") - 1)).alias("q")).distinct()
    at = lines.select(F.col("d").alias("ld"), F.col("v").alias("lv"), F.col("q").alias("lq"), "line")
    return covered.join(at, F.col("d").eqNullSafe(F.col("ld")) & (F.col("v") == F.col("lv")) & (F.col("q") == F.col("lq"))).select("d", "v", "line")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs without the lines of later copies, and `n_removed`; with drop_emptied, texts of which no word is left go."""
    gone = passages(docs.select("doc_id", "text"), min_words).groupBy("d", "v").agg(F.collect_set("line").alias("lines_"))  # lines of one document
    docs = docs.drop("n_removed")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("v"))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("lines_", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("lines_").isNull(), F.col("text")).otherwise(left)).withColumn("n_removed", F.coalesce(F.size("lines_"), F.lit(0)).cast("long"))
    if drop_emptied:
        out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns, "n_removed")
