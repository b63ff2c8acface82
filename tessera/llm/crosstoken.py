"""Cross-tokenizer alignment (operator 13).

Tokenizer A is a byte-level BPE file of the tokenizers library, tokenizer B a sentencepiece model that
puts a space before the text; A gets that space too, so both cut the same bytes.  Byte offsets at
which tokens of both end cut them into groups; the last tokens of a group are a link.  A link's
count is the number of links of the same two ids in all texts.

An array maps each id of A to the id of B with the same bytes.  A group of one token of each, of these two ids,
is counted in a vector as long as A's vocabulary.  Only the links of other groups are counted by a shuffle, after
each task has added up its own.

* `align` encodes each text once and keeps its links, packed: per distinct link its number.
* The vector (A's vocabulary), the highest count of each id of B (B's vocabulary) and the MOST_HOT most frequent other
  links have a bound, whatever the corpus; tasks get them whole and look up most links there.
* Links beyond those meet their counts in a join by link, which Spark may split, and are added up by text.

Where neither tokenizer joins a character and the space behind it, texts are cut there before
encoding: every distinct piece is encoded once in a while and remembered (CACHED pieces).  The model of B is asked whether that holds (no normalisation, no token with a space behind another
character); if it does not, texts are encoded whole.

Null and empty texts, and those whose bytes B does not give back (a U+2581 in the text), have no tokens:
zeros and an empty `groups`.  Special tokens in a text are plain text.  Repeated rows and ids and null ids are rows
of their own, each counts.  Other columns are not read.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import binary_array, row_chunks, small_batches, text_buffer, written
from .pretokenize import SliceCache, encode_rows
from .tokenfile import LibraryTokenizer

CHUNK, CACHED = 1 << 19, 400_000
SMALL, MOST_HELD = 32, 64 << 20  #: longer pieces count; beyond so many bytes of them the memory is emptied
MOST_HOT = 1 << 17  #: links that all tasks get with their counts (two megabytes)
FLUSH = 1 << 20  #: different links that a task adds up at a time
IDENTITY, OTHER = 0, 1

#: Bytes behind which a space is no cut: ASCII white space, and the last bytes of the UTF-8 forms of U+0085, U+00A0,
#: U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+2581 and U+3000 (unless 0xC3 precedes them).
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


class Aligner:
    """Both tokenizers, the map of equal ids and the pieces seen lately."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece

        self.a = LibraryTokenizer(a_file, CACHED // 4)
        shown = {v: k for k, v in self.a.spelled.items()} | {c: c for c in range(256) if c not in self.a.spelled}
        a_bytes = [b""] * self.a.vocabulary
        for token, i in self.a.library.get_vocab(with_added_tokens=False).items():
            a_bytes[i] = bytes(shown[ord(c)] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        of_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(self.b_bytes)), key=self.b.is_byte):  # a piece before the byte of the same value
            if self.b_bytes[i]:
                of_bytes.setdefault(self.b_bytes[i], i)
        self.identity = np.array([of_bytes.get(x, -1) for x in a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, self.b_bytes))
        #: how ids are written: of A inside and at the end of a group, then of B
        self.spelled = [b"%d%s" % (i, mark) for ids, marks in ((a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";"))) for mark in marks for i in range(len(ids))]
        self.cuts = self._independent()
        self.cache, self.held = SliceCache(self._encode_many, CACHED), 0

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def _independent(self) -> bool:
        """B neither changes a text nor has a token with a space behind another character."""
        probe = "ﬁ ０  xé é\t 　."
        same = b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == b" " + probe.encode()
        return same and not any(re.search(rb"[^ ] ", x) for x in self.b_bytes) and not any(self.b.is_unused(i) for i in range(len(self.b_bytes)))

    def _encode_many(self, pieces: list[bytes]):
        """For each piece the number of its ids and the ids: of A, then of B, which count from the end of A's vocabulary."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
        a, rows, _, _ = encode_rows(np.frombuffer(b"".join(pieces), np.uint8), offsets, self.a.cache)
        found = self.b.encode([x[1:].decode() for x in pieces], num_threads=1)  # B puts the first space itself
        found = [[self.b.piece_to_id("▁")] if x == b" " else ids for x, ids in zip(pieces, found)]
        a_sizes, b_sizes = np.diff(rows), np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(a_sizes + b_sizes)
        flat = np.empty(int(ends[-1]), np.uint32)
        of_b = np.zeros(len(flat), bool)
        of_b[np.repeat(ends - np.cumsum(b_sizes), b_sizes) + np.arange(int(b_sizes.sum()))] = True
        flat[~of_b] = a
        flat[of_b] = np.fromiter((i for ids in found for i in ids), np.uint32, int(b_sizes.sum())) + np.uint32(len(self.a_sizes))
        return (a_sizes + b_sizes).astype(np.int32), flat

    def _ids(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of A and their offsets in rows laid end to end, each with its first space; then those of B."""
        starts = offsets[:-1][np.diff(offsets) > 0]
        if self.cuts and len(data):
            space = np.flatnonzero(data == 0x20)
            space = space[space > 1]
            before = data[space - 1]
            space = space[~_NO_CUT[before] | (data[space - 2] == 0xC3) & (before >= 0x80)]
            starts = np.union1d(starts, space)
        raw, edges = data.tobytes(), [*starts.tolist(), len(data)]
        pieces = [raw[x:y] for x, y in zip(edges, edges[1:])]
        sizes = np.diff(edges)
        self.held += int(sizes[sizes > SMALL].sum())
        if self.held > MOST_HELD:
            self.cache._clear()
            self.held = 0
        ids, lengths = self.cache.encode(pieces)
        ids = ids.astype(np.int64)
        of_b = ids >= len(self.a_sizes)
        rows = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets)]
        b_rows = np.concatenate([[0], np.cumsum(of_b)])[rows]
        return ids[~of_b], rows - b_rows, ids[of_b] - len(self.a_sizes), b_rows

    def aligned(self, texts: pa.Array):
        """Chunk by chunk, for each text: tokens of A, tokens of B, groups as written; all links a << 32 | b, and their offsets."""
        text, ends = text_buffer(texts)
        for low, high in row_chunks(ends, CHUNK):
            own = ends[low : high + 1] - ends[low]
            offsets = own + np.concatenate([[0], np.cumsum(np.diff(own) > 0)])
            data = np.full(offsets[-1], 0x20, np.uint8)
            rest = np.ones(len(data), bool)
            rest[offsets[:-1][np.diff(own) > 0]] = False
            data[rest] = text[ends[low] : ends[high]]
            yield self._groups(*self._agreeing(data.tobytes(), offsets, *self._ids(data, offsets)))

    def _agreeing(self, raw: bytes, offsets, a, a_rows, b, b_rows):
        """Without the tokens of rows whose bytes B does not give back."""
        spell = self.b_bytes.__getitem__
        if b"".join(map(spell, b.tolist())) == raw:
            return a, a_rows, b, b_rows
        good = np.array([b"".join(map(spell, b[p:q].tolist())) == raw[x:y] for p, q, x, y in zip(b_rows, b_rows[1:], offsets, offsets[1:])], bool)
        out = []
        for ids, rows in ((a, a_rows), (b, b_rows)):
            sizes = np.diff(rows)
            out += [ids[np.repeat(good, sizes)], np.concatenate([[0], np.cumsum(sizes * good)])]
        return out

    def _groups(self, a, a_rows, b, b_rows):
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        ends = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, bool)
        ends[a_ends] = True
        j = np.flatnonzero(ends[b_ends])  # tokens of B, then of A, that end a group
        i = np.searchsorted(a_ends, b_ends[j])
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[i], last_b[j] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        written_out = np.empty(len(a) + len(b), np.int64)  # a group's tokens of A, then its tokens of B
        written_out[np.arange(len(a)) + np.concatenate([[0], j + 1])[group_a]] = a + last_a * len(self.a_sizes)
        written_out[np.arange(len(b)) + (i + 1)[group_b]] = 2 * len(self.a_sizes) + b + last_b * len(self.b_sizes)
        spell, rows = self.spelled.__getitem__, (a_rows + b_rows).tolist()
        groups = [b"".join(map(spell, written_out[x:y].tolist()))[:-1] for x, y in zip(rows, rows[1:])]
        return np.diff(a_rows), np.diff(b_rows), groups, (a[i] << 32) | b[j], np.searchsorted(i, a_rows)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process."""
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links binary, times binary, kind int, link long, hits long"
NAMES = [x.split()[0] for x in ALIGNED.split(", ")]


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """docs (doc_id, text) -> a row for each text, with its distinct links (int64) and how often it has each (uint32),
    and rows (kind, link, hits): the links of each task, added up; of kind IDENTITY, the link is A's id."""

    def run(batches):
        from pyspark import TaskContext

        both, row = aligner(a_file, b_file), TaskContext.get().partitionId() << 40
        same, others, waiting = np.zeros(len(both.identity), np.int64), [], 0
        for batch in batches:
            made = []
            for n_a, n_b, groups, links, stops in both.aligned(batch.column(1)):
                for k, (x, y) in enumerate(zip(stops.tolist(), stops[1:].tolist())):
                    found, times = np.unique(links[x:y], return_counts=True)
                    ident = both.identity[found >> 32] == (found & 0xFFFFFFFF)
                    same[found[ident] >> 32] += times[ident]
                    others.append((found[~ident], times[~ident]))
                    waiting += len(others[-1][0])
                    digest = hashlib.sha256(groups[k]).hexdigest() if groups[k] else ""
                    made.append((int(n_a[k]), int(n_b[k]), y - x, digest, found.tobytes(), times.astype("<u4").tobytes()))
            if waiting > FLUSH:
                others = [summed(others)]
                waiting = len(others[0][0])
                if waiting > FLUSH:
                    yield counts(OTHER, *others[0])
                    others, waiting = [], 0
            columns = list(zip(*made)) or [[]] * 6
            rows = [pa.array(np.arange(row, row + len(made))), batch.column(0).cast(pa.int64()), *(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array(columns[3], pa.string()), binary_array(list(columns[4])), binary_array(list(columns[5]))]
            row += len(made)
            yield table(rows + [None] * 3, len(made))
        at = np.flatnonzero(same)
        yield counts(IDENTITY, at, same[at])
        yield counts(OTHER, *summed(others))

    def summed(parts):
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        links, times = map(np.concatenate, zip(*parts))
        found, at = np.unique(links, return_inverse=True)
        return found, np.bincount(at, times, len(found)).astype(np.int64)

    def counts(kind, links, times):
        return table([None] * 8 + [pa.array(np.full(len(links), kind, np.int32)), pa.array(links.astype(np.int64)), pa.array(times.astype(np.int64))], len(links))

    kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]

    def table(columns, n):
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c for c, t in zip(columns, kinds)], NAMES)

    return small_batches(docs).mapInArrow(run, ALIGNED)


def resolve(aligned: DataFrame, a_file: str, b_file: str, same: np.ndarray, best: np.ndarray, hot: np.ndarray, hot_hits: np.ndarray) -> DataFrame:
    """Texts with n_best and count_sum over the links that the arrays tell, and `cold`: the others, each with the highest count of its id of B.

    same: counts by A's id, best: highest counts by B's id, hot (ascending) and hot_hits: other links."""
    context = aligned.sparkSession.sparkContext
    sent = context.broadcast((same, best, hot, hot_hits))

    def run(batches):
        same, best, hot, hot_hits = sent.value
        identity = aligner(a_file, b_file).identity
        for batch in batches:
            good, total, cold, stops = [], [], [np.zeros((0, 3), np.int64)], [0]
            for k in range(batch.num_rows):
                links, times = np.frombuffer(batch.column(6)[k].as_buffer(), np.int64), np.frombuffer(batch.column(7)[k].as_buffer(), "<u4").astype(np.int64)
                a, b = links >> 32, links & 0xFFFFFFFF
                ident = identity[a] == b
                where = np.minimum(np.searchsorted(hot, links), max(len(hot) - 1, 0))
                warm = ~ident & (hot[where] == links) if len(hot) else np.zeros(len(links), bool)
                hits = np.zeros(len(links), np.int64)
                hits[ident] = same[a[ident]]
                hits[warm] = hot_hits[where[warm]]
                known = ident | warm
                good.append(int(times[known & (hits == best[b])].sum()))
                total.append(int((times * hits)[known].sum()))
                cold.append(np.stack([links, times, best[b]], 1)[~known])
                stops.append(stops[-1] + len(cold[-1]))
            flat = np.concatenate(cold)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["link", "times", "top"])
            lists = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(good, pa.int64()), pa.array(total, pa.int64()), lists], [*NAMES[:6], "n_best", "count_sum", "cold"])

    kept = "row long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string"
    return aligned.mapInArrow(run, f"{kept}, n_best long, count_sum long, cold array<struct<link: long, times: long, top: long>>")


def counted(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", most_hot: int = MOST_HOT) -> DataFrame:
    """For each row of docs: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the
    highest of their id of B), count_sum (over links), groups_sha256."""
    aligned = written(align(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), a_file, b_file), "aligned")
    hits = written(aligned.where("kind IS NOT NULL").groupBy("kind", "link").agg(F.sum("hits").alias("hits")), "link-counts")

    both = aligner(a_file, b_file)
    same, best = np.zeros(len(both.identity), np.int64), np.zeros(len(both.b_bytes), np.int64)
    for a, n in hits.where(f"kind = {IDENTITY}").select("link", "hits").collect():  # a row for each id of A at most
        same[a] = n
        best[both.identity[a]] = max(best[both.identity[a]], n)
    others = hits.where(f"kind = {OTHER}").select("link", "hits")
    for b, n in others.groupBy(F.col("link").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")).agg(F.max("hits")).collect():  # a row for each id of B at most
        best[b] = max(best[b], n)
    hot = others.orderBy(F.desc("hits"), "link").limit(most_hot).toArrow().sort_by("link")  # most_hot rows at most

    texts = aligned.where("row IS NOT NULL").select(*NAMES[:8])
    found = written(resolve(texts, a_file, b_file, same, best, hot["link"].to_numpy(), hot["hits"].to_numpy()), "links-resolved")
    cold = found.select("row", F.explode("cold").alias("c")).select("row", "c.*").join(others, "link")
    more = cold.groupBy("row").agg(F.sum(F.when(F.col("hits") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("hits")).alias("more_sum"))
    out = found.drop("cold").join(more, "row", "left")
    added = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
