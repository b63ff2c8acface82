"""Byte-level BPE encoding and decoding (operator 1).

Vectorised pre-tokenisation (pretokenize.py) cuts the texts; each distinct slice goes
through pair merging once and is then remembered; slices of equal length merge together,
one merge each at a time, as rows of a matrix.  Every id's length in bytes follows from
the vocabulary, so the byte offsets of all ids are a running sum, kept for decoding slices.

Nulls and empty texts give no ids.  Rows are independent: repeated rows, ties and extra
columns (kept as they are, but for columns named like the new ones, which are replaced) do
not matter.  Texts are encoded whole; only a chunk of about a megabyte is in memory at once.
"""

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .columns import binary_array, row_chunks, small_batches, text_buffer
from .pretokenize import SliceCache, encode_rows

NONE = 1 << 40  #: more than any rank


class ByteBPE:
    """A rank file: one line per token, base64 of its bytes and its rank."""

    def __init__(self, path: str, most_cached: int = 250_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.widths = np.array([len(x) for x in self.tokens], np.int64)
        self.most_cached = most_cached

    @cached_property
    def cache(self) -> SliceCache:
        self.of_byte = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self._hash_pairs()
        return SliceCache(self.merge_all, self.most_cached)

    def _hash_pairs(self) -> None:
        """Open addressing: pair of ids -> rank of the merged token."""
        ranks, pairs = self.ranks, {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(10, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.pair, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):  # each free place takes one of its keys, the others move on
            free = left[self.pair[at[left]] < 0]
            self.pair[at[free]] = keys[free]
            self.merged[at[free]] = values[free]
            left = left[self.pair[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE if it has none."""
        shape, keys = a.shape, (a << 32 | b).reshape(-1)
        at = self._home(keys)
        there = self.pair[at]
        out = np.where(there == keys, self.merged[at], NONE)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.pair[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.merged[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out.reshape(shape)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each piece, and the ids laid end to end."""
        by_length: dict[int, list[int]] = {}
        done: list[tuple[np.ndarray, np.ndarray]] = []
        whole = [(i, r) for i, x in enumerate(pieces) if (r := self.ranks.get(x)) is not None]
        if whole:
            done.append((np.array([i for i, _ in whole]), np.array([[r] for _, r in whole])))
        known = {i for i, _ in whole}
        for i, x in enumerate(pieces):
            if i not in known:
                if len(x) > 64:
                    done.append((np.array([i]), np.array([self._merge_long(x)])))
                else:
                    by_length.setdefault(len(x), []).append(i)
        for length, own in by_length.items():
            at = np.array(own)
            ids = self.of_byte[np.frombuffer(b"".join([pieces[i] for i in own]), np.uint8).reshape(-1, length)]
            rank = self._rank(ids[:, :-1], ids[:, 1:])
            while len(at):
                width = ids.shape[1]
                where = rank.argmin(1) if width > 1 else np.zeros(len(at), np.int64)
                least = rank[np.arange(len(at)), where] if width > 1 else np.full(len(at), NONE)
                go = least < NONE
                if not go.all():
                    done.append((at[~go], ids[~go]))
                    at, ids, rank, where, least = at[go], ids[go], rank[go], where[go], least[go]
                if len(at):
                    rows, columns = np.arange(len(at)), np.arange(width)
                    ids[rows, where] = least
                    ids = ids[columns != where[:, None] + 1].reshape(len(at), width - 1)
                    rank = rank[columns[:-1] != where[:, None]].reshape(len(at), width - 2)
                    for left in (where - 1, where):
                        own_rows = np.flatnonzero((left >= 0) & (left < width - 2))
                        if len(own_rows):
                            x = left[own_rows]
                            rank[own_rows, x] = self._rank(ids[own_rows, x], ids[own_rows, x + 1])
        lengths = np.zeros(len(pieces), np.int32)
        for at, ids in done:
            lengths[at] = ids.shape[1]
        begin = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        for at, ids in done:
            flat[begin[at][:, None] + np.arange(ids.shape[1])] = ids
        return lengths, flat

    def _merge_long(self, piece: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, with a heap over a linked list: n log n for long slices."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # part at i: piece[i:end[i]]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids and row offsets, chunk by chunk."""
        data, offsets = text_buffer(texts)
        for a, b in row_chunks(offsets, 1 << 19):
            own = offsets[a : b + 1] - offsets[a]
            ids, rows, _, _ = encode_rows(data[offsets[a] : offsets[b]], own, self.cache)
            yield ids, rows

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id's bytes end."""
        return np.cumsum(self.widths[ids])


_models: dict[str, ByteBPE] = {}


def model(path: str) -> ByteBPE:
    """One model for each worker process."""
    if path not in _models:
        _models[path] = ByteBPE(path)
    return _models[path]


def _append(df: DataFrame, new: list[tuple[str, T.DataType]], drop: tuple[str, ...], make) -> DataFrame:
    """df without `drop` and with the new columns, which make(batch) returns as arrays."""
    names = {x.lower() for x, _ in new} | {x.lower() for x in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in new)])
    kept = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *make(batch)], [*kept, *(n for n, _ in new)])

    return small_batches(df).mapInArrow(run, schema)


def encode(df: DataFrame, vocabulary: str, text: str = "text", offsets: bool = True, keep_text: bool = False, decoded: str | None = None) -> DataFrame:
    """df with `n_tokens` and `ids` (little-endian unsigned 32-bit integers), and with offsets
    `ends`: the byte offset in the text at which each id ends, packed the same way.  With
    `decoded`, the ids are decoded again into that column by the same worker: a round trip
    that needs one vocabulary in memory instead of two."""
    new = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), *([("ends", T.BinaryType())] if offsets else []), *([(decoded, T.BinaryType())] if decoded else [])]

    def make(batch):
        bpe, counts, ids_out, ends_out, back = model(vocabulary), [], [], [], []
        for ids, rows in bpe.encode(batch.column(batch.schema.get_field_index(text))):
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                own = ids[a:b]
                counts.append(b - a)
                ids_out.append(own.astype("<u4").tobytes())
                if offsets:
                    ends_out.append(bpe.offsets(own).astype("<u4").tobytes())
                if decoded:
                    back.append(bpe.decode(own))
        return [pa.array(counts, pa.int64()), binary_array(ids_out), *([binary_array(ends_out)] if offsets else []), *([binary_array(back)] if decoded else [])]

    return _append(df, new, () if keep_text else (text,), make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded", first: str | None = None, last: str | None = None) -> DataFrame:
    """df with the bytes of the ids; with `first` and `last` (columns of token positions, last
    excluded) only of that slice, for which no other id is touched.  Null ids give null."""

    def make(batch):
        bpe, out = model(vocabulary), []
        lows, highs = (batch.column(batch.schema.get_field_index(c)).to_pylist() if c else None for c in (first, last))
        for i, packed in enumerate(batch.column(batch.schema.get_field_index(ids))):
            raw = packed.as_buffer()
            own = None if raw is None else np.frombuffer(raw, "<u4")[(lows and lows[i]) or 0 : highs[i] if highs else None]
            out.append(None if own is None else bpe.decode(own))
        return [binary_array(out)]

    return _append(df, [(into, T.BinaryType())], (), make)
