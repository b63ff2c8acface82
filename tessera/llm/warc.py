"""WARC archives with a globally ordered capture index (operator 9).

write: each task of the join that finds the revisits writes one archive (gzip, a member
for each record) in the order of URL
key and time, and beside it an index run in the same order.  merge_index: the runs are
merged by a loser tree into capture histories ordered over all archives; a task merges one
range of keys, finding its place in each run by the run's sparse index; more than FAN_IN
runs are first merged in groups.  replay: reads the records back by the merged index.

A record is a revisit if its payload has REVISIT bytes or more and equals that of a page of
larger id.  Null html is an empty payload, a null URL an empty one.  Null page ids are
kept; they count as smaller than any other.  Repeated rows are records of their own; of
rows with the response's id all are responses.  Other columns are not read.
"""

import gzip
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import slices, small_batches, store_of, written

REVISIT, FAN_IN, SPARSE, SAMPLES = 1000, 64, 256, 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort-friendly form: the host's labels reversed, then the path, in lower case."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]", ""))
    host = F.regexp_extract(plain, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(plain, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*|#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), url_key, stamp, digest, size, refers_to."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), "captured")
    pages = pages.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long"), "check": F.xxhash64("html")})
    thin = pages.where(f"size >= {REVISIT}").select("page_id", "digest", "size", "check")
    same = ["digest", "size", "check"]
    responses = thin.groupBy(same).agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    revisits = thin.join(responses, same).where("NOT page_id <=> refers_to").select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), "refers_to").distinct()
    pages = pages.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("own_digest")), "left")
    return pages.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), url_key(F.col("url")).alias("url_key"), F.date_format("captured", "yyyyMMddHHmmss").alias("stamp"), "digest", "size", "refers_to"
    )


def record(page_id, url: str, stamp: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """Headers, type and payload of one record."""
    raw = zlib.decompress(raw, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in http.decode().split("\r\n") if x.lower().startswith("content-length:"))
    number = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:N>
    found = {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": None, "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"][5:]}
    if found["record_type"] == "revisit":
        return found | {"refers_to": number(fields["WARC-Refers-To"])}
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != found["payload_digest"]:
        raise ValueError(f"record {found['page_id']}: the payload is not what the headers say")
    return found


class Run:
    """A sorted index run: lines of tab-separated fields, then a sparse index of line positions."""

    FIELDS = ["url_key", "stamp", "page_id", "archive", "offset", "length"]

    def __init__(self, sink):
        self.sink, self.at, self.n, self.sparse = sink, 0, 0, []

    def add(self, entry: tuple) -> None:
        if self.n % SPARSE == 0:
            self.sparse.append((Run.order(entry), self.at))
        line = ("\t".join("" if x is None else str(x) for x in entry) + "\n").encode()
        self.sink.write(line)
        self.at, self.n = self.at + len(line), self.n + 1

    def close(self) -> list[tuple]:
        """Ends the run; keys evenly spaced in it, SAMPLES at most."""
        index = "".join(f"{'	'.join(map(str, k))}	{at}\n" for k, at in self.sparse).encode()
        self.sink.write(index + struct.pack("<QQ", self.at, len(index)))
        self.sink.close()
        step = max(1, -(-len(self.sparse) // SAMPLES))
        return [k for k, _ in self.sparse[::step]]

    @staticmethod
    def order(entry: tuple) -> tuple:
        return entry[0], entry[1], -(1 << 63) if entry[2] is None else entry[2]

    @staticmethod
    def read(store, path: str, low: tuple | None, high: tuple | None):
        """Entries from low on, before high."""
        with store.open_input_file(path) as source:
            size = source.size()
            source.seek(size - 16)
            end, length = struct.unpack("<QQ", source.read(16))
            source.seek(end)
            sparse = [x.rsplit("\t", 1) for x in source.read(length).decode().split("\n")[:-1]]
            keys = [(lambda k: (k[0], k[1], int(k[2])))(x[0].split("\t")) for x in sparse]
            at = int(sparse[max(0, bisect_left(keys, low) - 1)][1]) if low and sparse else 0
            source.seek(at)
            rest = b""
            while at < end or rest:
                block = source.read(min(1 << 16, end - at))
                at += len(block)
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    key, stamp, page, archive, offset, length = line.decode().split("\t")
                    entry = key, stamp, int(page) if page else None, archive, int(offset), int(length)
                    if high is not None and Run.order(entry) >= high:
                        return
                    if low is None or Run.order(entry) >= low:
                        yield entry


def loser_tree(runs: list):
    """Merges sorted iterators: inner nodes hold the loser of their match, so that after each
    winner only the matches on its path are played again."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    order = [None if h is None else Run.order(h) for h in heads]
    beats = lambda a, b: order[b] is None or order[a] is not None and (order[a], a) < (order[b], b)
    tree = [-1] * k  # tree[0]: the winner

    def play(i: int) -> None:
        node, winner = (i + k) // 2, i
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner

    for i in range(k):
        play(i)
    while order[w := tree[0]] is not None:
        yield heads[w]
        heads[w] = next(runs[w], None)
        order[w] = None if heads[w] is None else Run.order(heads[w])
        node, winner = (w + k) // 2, w
        while node:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives and index runs below the folder; a row for each run: path, entries, samples."""

    def run(batches):
        out = archive = None
        for batch in batches:
            if out is None:
                store, base = store_of(folder)
                store.create_dir(base, recursive=True)
                name = uuid.uuid4().hex  # of this attempt: a task that runs again leaves another file, which no index names
                archive = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None)
                out, at = Run(store.open_output_stream(f"{base}/{name}.run")), 0
            for row in batch.to_pylist():
                url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"] or "")
                raw = record(row["page_id"], url, row["stamp"], row["digest"], row["size"], row["refers_to"], (row["html"] or "").encode())
                archive.write(raw)
                out.add((row["url_key"], row["stamp"], row["page_id"], f"{name}.warc.gz", at, len(raw)))
                at += len(raw)
        if out is not None:
            archive.close()
            yield runs_table([(f"{name}.run", out)])

    ordered = plan(small_batches(pages)).sortWithinPartitions("url_key", "stamp", F.col("page_id").asc_nulls_first())
    return written(ordered.mapInArrow(run, RUNS), "runs")


RUNS = "path string, entries long, samples array<struct<url_key:string,stamp:string,page_id:long>>"


def runs_table(runs: list) -> pa.RecordBatch:
    rows = [{"path": path, "samples": [dict(zip(("url_key", "stamp", "page_id"), k)) for k in run.close()], "entries": run.n} for path, run in runs]
    kind = pa.list_(pa.struct([("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows]), pa.array([r["entries"] for r in rows]), pa.array([r["samples"] for r in rows], kind)], ["path", "entries", "samples"])


def merge_index(runs: DataFrame, folder: str, ranges: int | None = None) -> DataFrame:
    """Capture histories: a row for each entry, in global order over `part` and `place`; `capture` counts a URL's captures from 1."""
    spark = runs.sparkSession

    def group(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, base = store_of(folder)
                name = f"{uuid.uuid4().hex}.run"
                out = Run(store.open_output_stream(f"{base}/{name}"))
                for entry in loser_tree([Run.read(store, f"{base}/{p}", None, None) for p in row["paths"]]):
                    out.add(entry)
                yield runs_table([(name, out)])

    while (count := runs.count()) > FAN_IN:
        numbered = runs.select("path", (F.row_number().over(Window.orderBy("path")) % -(-count // FAN_IN)).alias("g"))  # a row per run
        runs = written(numbered.groupBy("g").agg(F.collect_list("path").alias("paths")).select("paths").repartition(-(-count // FAN_IN)).mapInArrow(group, RUNS), "runs")
    found = runs.collect()  # FAN_IN rows at most, SAMPLES keys each
    keys = sorted({(s["url_key"], "", -(1 << 63)) for r in found for s in r["samples"]})  # a URL's history stays in one range
    parts = max(1, min(ranges or slices(runs), len(keys)))
    edges = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    bounds = [(i, a, b) for i, (a, b) in enumerate(zip([None, *edges], [*edges, None]))]
    paths = sorted(r["path"] for r in found)

    def merge(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                _, low, high = bounds[part]
                store, base = store_of(folder)
                rows, place, last, capture = [], 0, None, 0
                for entry in loser_tree([Run.read(store, f"{base}/{p}", low, high) for p in paths]):
                    capture = capture + 1 if entry[0] == last else 1
                    last = entry[0]
                    rows.append((part, place, capture, *entry))
                    place += 1
                    if len(rows) == 4096:
                        yield entries(rows)
                        rows = []
                yield entries(rows)

    def entries(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 9, kinds)], ["part", "place", "capture", *Run.FIELDS])

    schema = "part long, place long, capture long, url_key string, stamp string, page_id long, archive string, offset long, length long"
    return written(spark.range(0, parts, 1, parts).mapInArrow(merge, schema), "histories")


def replay(histories: DataFrame, folder: str) -> DataFrame:
    """The records of the archives, found by the merged index and checked against their digests."""

    def run(batches):
        store, base = store_of(folder)
        opened = {}
        for batch in batches:
            rows = batch.to_pylist()
            for row in sorted(rows, key=lambda r: (r["archive"], r["offset"])):
                if row["archive"] not in opened:
                    if len(opened) >= FAN_IN:
                        opened.pop(next(iter(opened))).close()
                    opened[row["archive"]] = store.open_input_file(f"{base}/{row['archive']}")
                source = opened[row["archive"]]
                source.seek(row["offset"])
                row |= parse(source.read(row["length"]))
            columns = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url_key": pa.string(), "stamp": pa.string(), "capture": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in columns.items()], list(columns))

    return histories.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, stamp string, capture long")
