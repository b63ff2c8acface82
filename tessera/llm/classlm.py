"""Language-model scoring with Brown class-based n-grams (operator 4).

Every word that the training texts hold LEAST times or more is put into one of CLASSES classes by
exchange clustering: in turns, each word moves to the class that raises the likelihood of the class
bigrams most.  Words seen less often (with LEAST = 2: once) are one class, whose share estimates
words never seen; the end of a text is another.  A text's probability is the product over its tokens of

    P(class | class before) * P(word | class)

The first factor mixes class bigrams with class unigrams; the second is the word's share of
its class, and (c + 0.5) / (N_rest + 0.5 (V_rest + 1)) in the class of the rarer words.  Every
probability counts all training texts, and nothing depends on how the rows are cut.

Vocabulary, word bigrams and classes are Spark tables that grow with the texts; only the table of
classes x classes goes to tasks.  Texts are packed in chunks; each chunk sends each of
its distinct words once, by hash, to be counted, and gets the counts back.  Words are numbered within
buckets (by hash, about BUCKET words each, the frequent ones first), so that a bucket's classes are one short row; each
chunk packs its word bigrams by pair of buckets, and they are added up in pieces.  In each turn a piece meets the classes of
its two buckets and sends its words' neighbour-class counts to their buckets, where they are added and the words move.
A turn that lowers the likelihood (words move at once) is taken back and is the last.

Null and empty texts are one end token.  Null ids train (their remainder is unknown).
Repeated rows are separate texts, scored and counted each; columns beside the id and the
text are not read.  An empty table, or one without training texts, gives counts of 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columns import binary_array, discard, free_shuffles, row_chunks, slices, small_batches, text_buffer, written
from .textkernel import mix, words

LEAST, CLASSES, ROUNDS, BIGRAM_WEIGHT = 2, 64, 6, 0.9  #: CLASSES: 254 at most, so that a class is one byte
OFTEN, LATE = 16, ROUNDS  #: words of fewer occurrences than OFTEN move in the LATE last turns only: in all, since two would cost nearly half of the gain in perplexity
BUCKET, PLACES, PIECE, CHUNK = 60_000, 20, 1 << 17, 8 << 20  #: words of a bucket (on average), bits of a place in it, word bigrams of a piece, bytes of a chunk
END = np.uint64(0x5851F42D4C957F2D)  #: stands for the end token, which no word is


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and its end, and the n+1 offsets of the texts."""
    data, offsets = text_buffer(texts)
    parts, counts = [np.zeros(0, np.uint64)], [0]
    for a, b in row_chunks(offsets):
        hashes, ends = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(hashes)
        counts.extend(np.diff(ends).tolist())
    own, rows = np.concatenate(parts), np.cumsum(counts)
    n = len(rows) - 1
    out = np.full(len(own) + n, END, np.uint64)
    out[np.arange(len(own)) + np.repeat(np.arange(n), np.diff(rows))] = own
    return out, rows + np.arange(n + 1)


def with_parts(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return docs.select("doc_id", "text", held_out.alias("held_out"))


def one(values) -> pa.Array:
    """A list column of one row."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def chunks(docs: DataFrame) -> DataFrame:
    """A row per chunk (an Arrow batch, or CHUNK bytes of it): its texts' sizes, its distinct words with their training counts, and each token's word (-1: the end)."""

    def pieces_of(batches):
        for batch in batches:
            for a, b in row_chunks(text_buffer(batch.column(1))[1], CHUNK):
                yield batch.slice(a, b - a)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(pieces_of(batches)):
            own, rows = tokens(batch.column(1))
            word = own != END
            values, where, count = np.unique(own[word], return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")  # frequent words first: their places are small numbers
            values, where = values[order], np.argsort(order)[where]
            places = np.full(len(own), -1, "<i4")
            places[word] = where
            train = np.repeat(~batch.column(2).to_numpy(zero_copy_only=False), np.diff(rows))[word]
            seen = np.bincount(where[train], minlength=len(values))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), *map(one, (batch.column(0).cast(pa.int64()), batch.column(2), np.diff(rows), values.view(np.int64), seen)), binary_array([places.view(np.uint8).reshape(-1, 4).T.tobytes()])],  # bytes of one rank together: they compress
                ["chunk", "doc_id", "held_out", "n_tokens", "h", "seen", "places"],
            )

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, h array<long>, seen array<long>, places binary")


def unpacked(left: pa.Table, right: pa.Table, names: tuple) -> tuple[dict, list]:
    """A chunk's arrays, and columns of its distinct words in their order."""
    row = {n: left.column(n).combine_chunks()[0] for n in left.column_names}
    values = {n: row[n].values for n in row if n not in ("chunk", "places")} | {"places": np.frombuffer(row["places"].as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<i4").reshape(-1)}
    order = np.argsort(right.column("place").to_numpy())
    return values, [right.column(n).to_numpy()[order] for n in names]


def planes(x: np.ndarray) -> bytes:
    """Bytes of one rank together: they compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(data, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


PACKED = "left long, right long, part long, a binary, b binary, n binary"


def packed_bigrams(at: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, buckets: int, split: int) -> pa.Table:
    """Rows of bigrams a, b with counts n, one for each of the ascending values of at: (left * (buckets + 1) + right) * split + part."""
    edge = np.flatnonzero(np.diff(at, prepend=-1))
    cuts = list(zip(edge.tolist(), np.append(edge[1:], len(at)).tolist()))
    pair, low = at[edge] // split, (1 << PLACES) - 1
    binary = [binary_array([planes(x[c:d]) for c, d in cuts]) for x in ((a & low).astype("<i4"), (b & low).astype("<i4"), n.astype("<i4"))]
    return pa.table([pa.array(pair // (buckets + 1)), pa.array(pair % (buckets + 1)), pa.array(at[edge] % split), *binary], ["left", "right", "part", "a", "b", "n"])


def bigrams(texts: DataFrame, own_words: DataFrame, buckets: int, split: int) -> DataFrame:
    """Each chunk's training bigrams of word ids, packed by pair of buckets (and by hash in `split` parts), the end standing
    before each text; the bucket after the last has the rarer words (0) and the end (1)."""
    rest, end = buckets << PLACES, buckets << PLACES | 1

    def run(key, left, right):
        none = np.zeros(0, np.int64)
        if not left.num_rows:
            return packed_bigrams(none, none, none, none, buckets, split)
        values, (ids,) = unpacked(left, right, ("id",))
        known, token = np.unique(np.append(ids, [rest, end]), return_inverse=True)
        kind = np.append(token[: len(ids)], np.searchsorted(known, end))[values["places"]]
        before = np.concatenate([[np.searchsorted(known, end)], kind[:-1]])[: len(kind)]  # each text ends in the end
        train = np.repeat(~values["held_out"].to_numpy(zero_copy_only=False), values["n_tokens"].to_numpy())
        pair, n = np.unique((before * len(known) + kind)[train], return_counts=True)
        a, b = known[pair // len(known)], known[pair % len(known)]
        part = (mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) % np.uint64(split)).astype(np.int64)
        at = ((a >> PLACES) * (buckets + 1) + (b >> PLACES)) * split + part
        order = np.argsort(at, kind="stable")
        return packed_bigrams(at[order], a[order], b[order], n[order], buckets, split)

    words_ = own_words.select("chunk", "place", F.coalesce("id", F.lit(rest)).alias("id"))
    return texts.select("chunk", "held_out", "n_tokens", "places").groupBy("chunk").cogroup(words_.groupBy("chunk")).applyInArrow(run, PACKED)


def pieces(packed: DataFrame) -> DataFrame:
    """The chunks' bigrams added up, a row for each pair of buckets and part."""

    def run(key, table):
        a, b, n = (np.concatenate([from_planes(x.as_buffer(), "<i4") for x in table.column(c)]) for c in "abn")
        pair, where = np.unique(a.astype(np.int64) << PLACES | b, return_inverse=True)
        sums = (pair >> PLACES).astype("<i4"), (pair & ((1 << PLACES) - 1)).astype("<i4"), np.bincount(where, n).astype("<i8")
        return pa.table([*(pa.array([k.as_py()]) for k in key[:2]), *(binary_array([planes(x)]) for x in sums)], ["left", "right", "a", "b", "n"])

    return packed.groupBy("left", "right", "part").applyInArrow(run, "left long, right long, a binary, b binary, n binary")


def xlogx(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0).astype(float)
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(before: np.ndarray, after: np.ndarray, itself: np.ndarray, own: np.ndarray, table: np.ndarray, movable: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word (row) the class to which moving it alone raises the likelihood most, and by how much.

    before, after: counts of its neighbours' classes, without itself; own: its class."""
    w, d = np.arange(len(own)), np.arange(movable)
    gain = np.zeros((len(own), movable))
    for counts, others, n in ((after, before, table[:movable]), (before, after, table[:, :movable].T)):
        word, c = np.nonzero(counts)
        if len(word):
            more, now, at = counts[word, c][:, None], n.T[c].astype(float), own[word]
            inner = c == at
            now[inner] -= others[word[inner], :movable]
            now[np.arange(len(word)), at] -= counts[word, c] + inner * itself[word]
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[starts]] += np.add.reduceat(xlogx(now + more) - xlogx(now), starts)
    corner = np.repeat(table[d, d][None].astype(float), len(own), 0)
    corner[w, own] -= after[w, own] + before[w, own] + itself
    x, y = after[:, :movable], before[:, :movable]
    gain += xlogx(corner + x + y + itself[:, None]) - xlogx(corner + x) - xlogx(corner + y) + xlogx(corner)
    for counts, margin in ((after, table.sum(1)), (before, table.sum(0))):  # its neighbours' own margins do not depend on its class
        total = counts.sum(1) + itself
        n = np.repeat(margin[:movable][None].astype(float), len(own), 0)
        n[w, own] -= total
        gain -= xlogx(n + total[:, None]) - xlogx(n)
    best = gain.argmax(1)
    return best, gain[w, best] - gain[w, own]


def best_class(word: int, before: np.ndarray, after: np.ndarray, itself: int, of: np.ndarray, table: np.ndarray, movable: int) -> tuple[int, float]:
    best, gain = best_classes(before[None], after[None], np.array([itself]), np.array([of[word]]), table, movable)
    return int(best[0]), float(gain[0])


def turns(bucket: int, places: np.ndarray, turn: int) -> np.ndarray:
    """Whether words may move: in each turn half of them (by hash), in the next the others."""
    return mix((np.uint64(bucket << PLACES) + places.astype(np.uint64)) * np.uint64(2654435761) + np.uint64(turn // 2)) % np.uint64(2) == turn % 2


def movers(bucket: int, places: np.ndarray, turn: int, rounds: int, often: int) -> np.ndarray:
    """Those whose turn it is; of the words after the first `often` of a bucket (the rarer ones) only in the last turns."""
    return turns(bucket, places, turn) & ((places < often) | (turn >= rounds - LATE))


def votes(packed: DataFrame, classes: DataFrame, total: int, turn: int | None, rounds: int = 0) -> DataFrame:
    """(bucket, side, at, n): counts of the neighbours' classes of the words that may move (side 0 before, 1 after, 2 the word
    itself; at: place * total + class), and, as bucket -1, class bigrams."""

    def run(batches):
        table = np.zeros(total * total, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                left, right, often_a, often_b = (batch.column(i)[k].as_py() for i in (0, 1, 7, 8))
                a, b, n = (from_planes(batch.column(i)[k].as_buffer(), t) for i, t in ((2, "<i4"), (3, "<i4"), (4, "<i8")))
                of_a, of_b = (np.frombuffer(batch.column(i)[k].as_buffer(), "u1") for i in (5, 6))
                ca, cb = of_a[a].astype(np.int64), of_b[b].astype(np.int64)
                table += np.bincount(ca * total + cb, n, total * total).astype(np.int64)
                if turn is None:
                    continue
                itself = (a == b) & (left == right)
                for bucket, side, word, c, which, of, often in ((right, 0, b, ca, ~itself, of_b, often_b), (left, 1, a, cb, ~itself, of_a, often_a), (left, 2, a, ca * 0, itself, of_a, often_a)):
                    which = which & movers(bucket, np.arange(len(of)), turn, rounds, often)[word] & (of[word] < total - 2)
                    if which.any():
                        at, where = np.unique(word[which].astype(np.int64) * total + c[which], return_inverse=True)
                        sums = np.bincount(where, n[which]).astype("<i8")
                        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([side]), binary_array([planes(at.astype("<i4"))]), binary_array([planes(sums)])], ["bucket", "side", "at", "n"])
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([3]), binary_array([planes(at.astype("<i4"))]), binary_array([planes(table[at].astype("<i8"))])], ["bucket", "side", "at", "n"])

    pairs = packed.select("left", "right").distinct()  # both sides' classes meet by pair, so that the bigrams move once
    for name, side in (("left", "a"), ("right", "b")):
        pairs = pairs.join(classes.select(F.col("bucket").alias(name), F.col("of").alias(f"of_{side}"), F.col("often").alias(f"often_{side}")), name)
    return packed.join(pairs, ["left", "right"]).select("left", "right", "a", "b", "n", "of_a", "of_b", "often_a", "often_b").mapInArrow(run, "bucket long, side long, at binary, n binary")


def class_table(found: DataFrame, total: int) -> np.ndarray:
    """Class bigrams: total**2 numbers."""

    def run(batches):
        table = np.zeros(total * total, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1)):
                table[from_planes(at.as_buffer(), "<i4")] += from_planes(n.as_buffer(), "<i8")
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["at", "n"])

    rows = found.where("bucket = -1").select("at", "n").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(total * total, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(total, total)


def moved(found: DataFrame, classes: DataFrame, table: np.ndarray, turn: int, rounds: int) -> DataFrame:
    """(bucket, often, of) after the words that may move have moved."""
    total = len(table)

    def settle(bucket, often, of, counts):
        of = of.copy()
        mine = np.flatnonzero(movers(bucket, np.arange(len(of)), turn, rounds, often) & (of < total - 2))
        for k in range(0, len(mine), 256):
            w = mine[k : k + 256]
            best, gain = best_classes(*(dense(x, w) for x in counts[:2]), dense(counts[2], w)[:, 0], of[w].astype(np.int64), table, total - 2)
            of[w[gain > 1e-6]] = best[gain > 1e-6]
        return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([often]), binary_array([of.astype("u1").tobytes()])], ["bucket", "often", "of"])

    def dense(counts, w):
        """Rows of w (ascending) from the ascending places * total + class and their counts."""
        at, n = counts
        a, b = np.searchsorted(at, [w[0] * total, (w[-1] + 1) * total])
        out = np.zeros((w[-1] + 1 - w[0], total), np.int64)
        out.reshape(-1)[at[a:b] - w[0] * total] = n[a:b]
        return out[w - w[0]]

    def added(parts):
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, n = map(np.concatenate, zip(*parts))
        at, where = np.unique(at, return_inverse=True)
        return at.astype(np.int64), np.bincount(where, n).astype(np.int64)

    def run(batches):
        bucket = None
        for batch in batches:
            for key, side, at, n, often in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                if side < 0:  # a bucket's classes come before its counts
                    if bucket is not None:
                        yield settle(bucket, many, of, [added(x) for x in parts])
                    bucket, of, many, parts = key, np.frombuffer(at.as_buffer(), "u1"), often, [[], [], []]
                else:
                    parts[side].append((from_planes(at.as_buffer(), "<i4"), from_planes(n.as_buffer(), "<i8")))
        if bucket is not None:
            yield settle(bucket, many, of, [added(x) for x in parts])

    rows = found.where("bucket >= 0").withColumn("often", F.lit(0).cast("long")).unionByName(classes.select("bucket", F.lit(-1).cast("long").alias("side"), F.col("of").alias("at"), F.lit(b"").alias("n"), "often"))
    return rows.repartition(slices(found), "bucket").sortWithinPartitions("bucket", "side").mapInArrow(run, "bucket long, often long, of binary")


def numbered(kinds: DataFrame, least: int, size: int) -> tuple[DataFrame, int]:
    """(h, c, id) of the words seen `least` times or more, and the number of buckets; ids depend on nothing but the words."""
    words_ = kinds.where(F.col("c") >= least)
    buckets = -(-words_.count() // size)
    bucket = F.pmod(F.xxhash64("h"), F.lit(max(1, buckets)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("c"), "h")) - 1
    return words_.withColumn("bucket", bucket).withColumn("place", place).select("h", "c", (F.shiftleft(F.col("bucket").cast("long"), PLACES) + F.col("place")).alias("id")), buckets


def first_classes(vocabulary: DataFrame, buckets: int, movable: int) -> DataFrame:
    """(bucket, often, of): the most frequent words a class each, all others by frequency; then the bucket of the rarer words and
    the end.  often: how many words of the bucket, which come first, occur OFTEN or more."""
    spark = vocabulary.sparkSession
    top = {r.id: k for k, r in enumerate(vocabulary.orderBy(F.desc("c"), "h").limit(movable).collect())}  # a row per class

    def run(key, table):
        table = table.sort_by("id")
        ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
        of = (np.floor(4 * np.log2(c)).astype(np.int64) % movable).astype("u1")
        for word, k in top.items():
            of[ids == word] = k
        return pa.table([pa.array([int(ids[0]) >> PLACES]), pa.array([int((c >= OFTEN).sum())]), binary_array([of.tobytes()])], ["bucket", "often", "of"])

    own = vocabulary.withColumn("bucket", F.shiftright("id", PLACES)).groupBy("bucket").applyInArrow(run, "bucket long, often long, of binary")
    return own.unionByName(spark.createDataFrame([(buckets, 0, np.array([movable, movable + 1], "u1").tobytes())], "bucket long, often long, of binary"))


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to a constant."""
    return xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum()


def exchange(packed: DataFrame, classes: DataFrame, total: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(bucket, often, of) and the class bigrams after `rounds` turns, or before the turn that lowers the likelihood."""
    before, table = None, None
    for turn in range(rounds if total > 3 else 0):
        found = written(votes(packed, classes, total, turn, rounds), "votes")
        now = class_table(found, total)
        if before is not None and likelihood(now) < likelihood(table):
            return before, table
        after = written(moved(found, classes, now, turn, rounds), "classes")
        discard(found, *([before] if before is not None else []))
        free_shuffles(packed.sparkSession)
        before, table, classes = classes, now, after
    now = class_table(votes(packed, classes, total, None), total)
    return (before, table) if before is not None and likelihood(now) < likelihood(table) else (classes, now)


def score(docs: DataFrame, least: int = LEAST, classes: int = CLASSES, rounds: int = ROUNDS, weight: float = BIGRAM_WEIGHT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for each row of docs."""
    packed = written(chunks(with_parts(small_batches(docs))), "chunks")
    own_words = packed.select("chunk", F.posexplode(F.arrays_zip("h", "seen")).alias("place", "x")).select("chunk", "place", F.col("x.h").alias("h"), F.col("x.seen").alias("seen"))
    kinds = written(own_words.groupBy("h").agg(F.sum("seen").alias("c")).where("c > 0"), "counts")
    vocabulary, buckets = numbered(kinds, least, bucket)
    vocabulary = written(vocabulary, "vocabulary")
    texts = docs.sparkSession.read.schema(packed.schema).parquet(packed.written_to_).drop("h", "seen")  # read anew: it meets its own words
    named = own_words.join(vocabulary.select("h", "id"), "h", "left")
    most = packed.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    free_shuffles(docs.sparkSession)
    grouped = written(pieces(bigrams(texts, named, buckets, 1 + most // (PIECE * (buckets + 1) ** 2))), "pieces")
    free_shuffles(docs.sparkSession)
    movable = max(1, min(classes, vocabulary.count()))
    of, table = exchange(grouped, written(first_classes(vocabulary, buckets, movable), "classes"), movable + 2, rounds)
    discard(grouped)

    stats = kinds.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c"), F.coalesce(F.sum(F.when(F.col("c") < least, F.col("c"))), F.lit(0)), F.count_if(F.col("c") < least)).first()
    ends = int(table[:, -1].sum())
    total, distinct, rest, rest_kinds = stats[0] + ends, stats[1] + (ends > 0), stats[2], stats[3]
    base_norm, rest_norm = np.log10(total + 0.5 * (distinct + 1)), np.log10(rest + 0.5 * (rest_kinds + 1))
    shares = (table.sum(0) / max(1, table.sum()) + 1e-9) / (table.sum(0) / max(1, table.sum()) + 1e-9).sum()
    history = table.sum(1, keepdims=True)
    transition = np.log10(np.where(history > 0, weight * table / np.maximum(history, 1) + (1 - weight) * shares, shares))
    of_class = np.log10(np.maximum(table.sum(0), 1))

    def spread(batches):
        for batch in batches:
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(own.as_buffer(), "u1")
                yield pa.RecordBatch.from_arrays([pa.array((key << PLACES) + np.arange(len(own))), pa.array(own.astype(np.int64))], ["id", "class"])

    of_word = vocabulary.join(of.select("bucket", "of").mapInArrow(spread, "id long, class long"), "id").select("h", "class")
    final = written(kinds.join(of_word, "h", "left"), "final")
    named = own_words.join(final, "h", "left").select("chunk", "place", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", F.lit(movable)).alias("class"))

    def finish(key, left, right):
        values, (c, own) = unpacked(left, right, ("c", "class"))
        places, n = values["places"], values["n_tokens"].to_numpy()
        own, c = np.append(own, movable + 1).astype(np.int64), np.append(c, ends)  # place -1: the end
        emission = np.log10(np.where(own == movable, c + 0.5, np.maximum(c, 1))) - np.where(own == movable, rest_norm, of_class[own])
        emission[-1] = 0.0
        kind = own[places]
        each = transition[np.concatenate([[movable + 1], kind[:-1]])[: len(kind)], kind] + emission[places]
        starts = np.cumsum(n) - n
        sums = lambda x: np.add.reduceat(x, starts) if len(n) else x[:0]
        base = sums(np.log10(c + 0.5)[places]) - n * base_norm
        return pa.table([values["doc_id"], values["held_out"], values["n_tokens"], pa.array(sums((c > 0).astype(np.int64)[places])), pa.array(np.full(len(n), total)), pa.array(base), pa.array(sums(each))], RESULT)

    RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return texts.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
