"""Token-id files: fixed-width bit packing with block offsets (operator 3).

A file holds the ids of consecutive documents.  Each id takes the minimum number of bits
for the vocabulary; ids are packed in blocks of BLOCK ids, each of which starts at a byte
of its own, so any id is found without reading what comes before it:

    magic, version, bits per id, ids per block            (16 bytes)
    packed blocks
    document ids (int64, null: the smallest), first id of each document (uint64, n + 1 of
    them), byte offset of each block (uint64, m + 1 of them)
    number of documents, number of blocks, offset of the index, magic   (32 bytes)

Files are written by Spark tasks below the shared folder through pyarrow.fs, each under a
name of its own attempt and then moved, so that a task that runs again does no harm.

Documents keep repeated ids (each row is a document of its own, equal ids in the order of
their contents); a null id comes first and reads back as null; null and empty texts are
the end id alone.  Only the columns named are read, so extra columns do not matter.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .columns import row_chunks, shared_dir, slices, small_batches, store_of, text_buffer
from .pretokenize import SliceCache, encode_rows

MAGIC, VERSION, BLOCK = b"TIDS", 1, 1 << 16
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing: id i takes the bits from i * bits on."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    raw = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(raw[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class Writer:
    def __init__(self, sink, vocabulary: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits_for(vocabulary), block
        self.docs, self.firsts, self.at, self.n = [], [0], [16], 0
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        sink.write(MAGIC + struct.pack("<III", VERSION, self.bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.n += len(ids)
        self.firsts.append(self.n)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting // self.block)

    def _flush(self, blocks: int) -> None:
        flat = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        for k in range(blocks):
            raw = pack(flat[k * self.block : (k + 1) * self.block], self.bits)
            self.sink.write(raw)
            self.at.append(self.at[-1] + len(raw))
        self.pending = [flat[blocks * self.block :]]
        self.waiting = len(self.pending[0])

    def close(self) -> None:
        if self.waiting:
            self._flush(-(-self.waiting // self.block))
        for values, kind in ((self.docs, "<i8"), (self.firsts, "<u8"), (self.at, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(struct.pack("<QQQ", len(self.docs), len(self.at) - 1, self.at[-1]) + b"\0" * 4 + MAGIC)


class Reader:
    """Random access: the index, then only the blocks that hold the ids asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(0)
        head = source.read(16)
        source.seek(size - 32)
        tail = source.read(32)
        if head[:4] != MAGIC or tail[28:] != MAGIC:
            raise ValueError("not a token-id file")
        _, self.bits, self.block = struct.unpack("<III", head[4:])
        docs, blocks, index = struct.unpack("<QQQ", tail[:24])
        source.seek(index)
        raw = source.read(8 * (docs + docs + 1 + blocks + 1))
        self.docs = np.frombuffer(raw, "<i8", docs)
        self.firsts = np.frombuffer(raw, "<u8", docs + 1, 8 * docs).astype(np.int64)
        self.at = np.frombuffer(raw, "<u8", blocks + 1, 8 * (2 * docs + 1)).astype(np.int64)
        self.n = int(self.firsts[-1])

    def ids(self, low: int, high: int) -> np.ndarray:
        """ids low to high - 1 of the file."""
        if high <= low:
            return np.zeros(0, np.uint32)
        a, b = low // self.block, (high - 1) // self.block + 1
        self.source.seek(int(self.at[a]))
        raw = self.source.read(int(self.at[b] - self.at[a]))
        parts = [unpack(raw[self.at[k] - self.at[a] : self.at[k + 1] - self.at[a]], self.bits, min(self.block, self.n - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[low - a * self.block : high - a * self.block]

    def documents(self, step: int = 1 << 20):
        """(document id, its ids), one after the other; about `step` ids in memory."""
        k = 0
        while k < len(self.docs):
            end = max(k + 1, int(np.searchsorted(self.firsts, self.firsts[k] + step, "right")) - 1)
            flat = self.ids(int(self.firsts[k]), int(self.firsts[end]))
            for d in range(k, end):
                yield (None if self.docs[d] == NO_ID else int(self.docs[d])), flat[self.firsts[d] - self.firsts[k] : self.firsts[d + 1] - self.firsts[k]]
            k = end


class LibraryTokenizer:
    """The tokenizers library with a memory.

    Its byte-level BPE encodes each match of the cutting pattern separately, so every
    distinct match passes through the library's model once.  Texts in which the library would see
    an added token (like an end-of-text mark) go through it whole.
    """

    def __init__(self, path: str, most_cached: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        # printable bytes stand for themselves, the others for the code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelled = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.cache = SliceCache(self._encode_many, most_cached)

    def _encode_many(self, keys: list[bytes]):
        """The library's BPE model on each slice, its bytes spelled as the byte-level alphabet spells them."""
        model, spelled = self.library.model.tokenize, self.spelled
        found = [[x.id for x in model(k.decode("latin-1").translate(spelled))] for k in keys]
        lengths = np.fromiter(map(len, found), np.int32, len(found))
        return lengths, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))

    def encode(self, texts: pa.Array):
        """The ids of each text, as numpy arrays."""
        data, offsets = text_buffer(texts)
        for a, b in row_chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            raw, own = part.tobytes(), offsets[a : b + 1] - offsets[a]
            ids, rows, _, _ = encode_rows(part, own, self.cache)
            whole = any(x in raw for x in self.added)
            for i in range(b - a):
                if whole and any(x in raw[own[i] : own[i + 1]] for x in self.added):
                    yield np.array(self.library.encode(raw[own[i] : own[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[rows[i] : rows[i + 1]]


_tokenizers: dict[str, LibraryTokenizer] = {}


def tokenizer(path: str) -> LibraryTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = LibraryTokenizer(path)
    return _tokenizers[path]


def library_ids(vocabulary: str, end_id: int | None):
    """For `write`: (doc_id, ids and the end id) of a batch of doc_id, text."""

    def ids_of(batch):
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        for doc, ids in zip(batch.column(0).to_pylist(), tokenizer(vocabulary).encode(batch.column(1))):
            yield doc, np.concatenate([ids, tail])

    return ids_of


def write(docs: DataFrame, ids_of, vocabulary_size: int, folder: str, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Write token-id files in ascending doc_id order; returns the manifest (a row per file, also
    kept as a table in the folder): path, size, documents, tokens, start (tokens in all files
    before it).

    The texts are dealt out by ranges of ids first and encoded behind that shuffle: the
    sampling of the ranges then reads the table only, and nothing is encoded twice."""
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        writer = None
        for batch in batches:
            if writer is None:
                store, base = store_of(folder)
                store.create_dir(base, recursive=True)
                part = TaskContext.get().partitionId()
                mine, name = f"{base}/.{uuid.uuid4().hex}", f"{base}/{part:06d}.tids"
                writer = Writer(store.open_output_stream(mine), vocabulary_size)
            for doc, ids in ids_of(batch):
                writer.add(doc, ids)
        if writer is not None:
            writer.close()
            writer.sink.close()
            store.move(mine, name)
            yield pa.RecordBatch.from_pylist([{"part": part, "path": name, "documents": len(writer.docs), "tokens": writer.n, "size": store.get_file_info(name).size}])

    schema = "part long, path string, documents long, tokens long, size long"
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = docs.repartitionByRange(files or slices(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    files_in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(files_in_order), F.lit(0)))


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and `ids` (little-endian unsigned 32-bit) if asked for."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = store_of(folder)
                with store.open_input_file(row["path"]) as source:
                    reader, at, out = Reader(source, row["size"]), row["start"], []
                    for doc, ids in reader.documents():
                        raw = ids.astype("<u4").tobytes()
                        out.append((doc, at, len(ids), zlib.crc32(raw), raw if with_ids else None))
                        at += len(ids)
                        if len(out) == 4096:
                            yield table(out)
                            out = []
                    yield table(out)

    def table(rows):
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)][: 5 if with_ids else 4], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return manifest.select("path", "size", "start").repartition(slices(manifest), "path").mapInArrow(run, schema)


def token_files(spark: SparkSession, df: DataFrame, vocabulary: str, end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encode with the tokenizers library, write the files, read them back (see `read`)."""
    folder = folder or shared_dir(spark, "token-files")
    manifest = write(df, library_ids(vocabulary, end_id), tokenizer(vocabulary).vocabulary, folder)
    return read(manifest, folder)
