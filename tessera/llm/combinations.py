"""Pairs that could link, by token combinations that grow where lists stay long (part of operator 8).

Shingles that exactly the same sets have are one bundle: two sets share all of it or nothing.  The
bundles of a set have one global order, those of fewer sets first.  Two sets of n and m shingles that link
share bundles of at least 0.75 max(n, m) shingles; the first k bundles that they share, whatever k, are a
combination from which each of the two can still reach its 0.75 n with the bundles behind.  So

* a set's combinations of one bundle are those from which it can reach 0.75 n;
* a list of sets with the same combination is paired where at most LONG of its sets are outside its largest
  component (or where longer combinations would be more rows than pairs are saved), between components only,
  and only where what is behind the combination suffices in both sets;
* the sets of a longer list get combinations of one more bundle.  Sets that share no further bundle link only if
  the combination alone suffices; each of them then links with the smallest set of the list, too, so that
  pairs with that one set keep the components right.

Lists of one component are dropped.  Nothing is capped: k grows until no list is long.  Two bundles taken for one
(64-bit names) could only add pairs, which are verified like all others.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .columns import binary_array, discard, giving_back, row_chunks, written
from .textkernel import mix

LONG, SAVING = 32, 4  #: longer lists are extended if that makes SAVING times fewer rows than pairs
LEVEL = "key long, node long, n long, comp long, at long, got long, left long, more long, full boolean"


def tokens_of(sets: DataFrame) -> DataFrame:
    """(token, node) for each shingle of sets (node, own)."""

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), "<i8") for v in batch.column(1)]
            sizes, nodes = np.array([len(x) for x in own], np.int64), batch.column(0).to_numpy()
            for a, b in row_chunks(np.concatenate([[0], np.cumsum(sizes)]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own[a:b])), pa.array(np.repeat(nodes[a:b], sizes[a:b]))], ["token", "node"])

    return sets.select("node", "own").mapInArrow(lambda batches: giving_back(run(batches)), "token long, node long")


def bundles(sets: DataFrame, members: DataFrame) -> DataFrame:
    """members (node, n, comp) with the names of their shared bundles in order and the running sums of their sizes, packed."""
    tokens = tokens_of(sets.join(members.select("node"), "node", "left_semi"))
    who = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"who{seed}") for seed in (1, 2)]
    names = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *who).where("df > 1").select("token", "df", F.xxhash64("df", "who1", "who2").alias("name"))
    named = tokens.join(names, "token").select("node", "df", "name").repartition("node")
    own = named.groupBy("node", "df", "name").agg(F.count(F.lit(1)).alias("size")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "name", "size"))).alias("own"))

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            stops = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            name, size = flat.field("name").to_numpy().astype("<i8"), flat.field("size").to_numpy().astype("<i8")
            cuts = list(zip(stops[:-1], stops[1:]))
            sums = [np.concatenate([[0], np.cumsum(size[a:b])]).astype("<i8").tobytes() for a, b in cuts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], binary_array([name[a:b].tobytes() for a, b in cuts]), binary_array(sums)], ["node", "n", "comp", "names", "sums"])

    rows = members.join(own, "node").select("node", "n", "comp", "own")
    return rows.mapInArrow(lambda batches: giving_back(run(batches)), "node long, n long, comp long, names binary, sums binary")


def extended(rows: DataFrame) -> DataFrame:
    """Combinations of one more bundle: of rows (node, n, comp, names, sums, key, at, got), where `at` is the place of
    the last bundle (from 1) and `got` the shingles so far; `left` are those behind, `more` the ways to go on."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            head = [batch.column(i).to_numpy() for i in (0, 1, 2, 5, 6, 7)]
            counts = []
            for k, (node, n, comp, key, at, got) in enumerate(zip(*head)):
                names, sums = (np.frombuffer(batch.column(i)[k].as_buffer(), "<i8") for i in (3, 4))
                spare = sums[-1] - (-(-3 * n // 4))  # what may be missed of all shared shingles
                reach = min(int(np.searchsorted(sums, spare + got, "right")), len(names))
                i = np.arange(at + 1, reach + 1)
                now = got + sums[i] - sums[i - 1]
                ways = np.minimum(np.searchsorted(sums, spare + now, "right"), len(names)) - i
                counts.append(len(i))
                keys = mix(np.full(len(i), key).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(names[i - 1].view(np.uint64)))
                for column, part in zip(out, (keys.view(np.int64), i, now, sums[-1] - sums[i], np.maximum(ways, 0), now >= sums[-1] - spare)):
                    column.append(part)
            if not counts:
                continue
            key, at, got, left, more, full = (np.concatenate(c) for c in out[:6])
            node, n, comp = (np.repeat(x, counts) for x in head[:3])
            arrays = [pa.array(x.astype(np.int64)) for x in (key, node, n, comp, at, got, left, more)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(full)], ["key", "node", "n", "comp", "at", "got", "left", "more", "full"])

    return rows.mapInArrow(lambda batches: giving_back(run(batches)), LEVEL)


def lists_of(level: DataFrame) -> DataFrame:
    """(key, top, short) of lists with several components: top is the component of most members."""
    parts = level.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("more").alias("more"))
    lists = parts.groupBy("key").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("most"), F.sum("more").alias("more"), F.count(F.lit(1)).alias("comps"))
    others = F.col("c") - F.col("most.c")
    return lists.where("comps > 1").select("key", F.col("most.comp").alias("top"), ((others <= LONG) | (SAVING * F.col("more") >= others * F.col("c"))).alias("short"))


def list_pairs(short: DataFrame) -> DataFrame:
    """(a, b) of one list and different components that could link by what is behind the combination."""
    x, y = (short.select("key", *(F.col(c).alias(c + side) for c in ("node", "n", "comp", "got", "left")), (F.col("comp") != F.col("top")).alias("out" + side)) for side in ("x", "y"))
    most = F.least("gotx", "goty") + F.least("leftx", "lefty")
    fits = (F.col("compx") != F.col("compy")) & (~F.col("outy") | (F.col("nodex") < F.col("nodey"))) & (7 * most >= 3 * (F.col("nx") + F.col("ny")))
    return x.where("outx").join(y, "key").where(fits).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b"))


def smallest_pairs(full: DataFrame) -> DataFrame:
    """(a, b): sets that the combination alone could link with the smallest set of their list."""
    hubs = full.groupBy("key").agg(F.min(F.struct("n", "node", "comp")).alias("hub"))
    able = (F.col("comp") != F.col("hub.comp")) & (7 * F.col("got") >= 3 * (F.col("n") + F.col("hub.n")))
    return full.join(hubs, "key").where(able).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def combined_pairs(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), each once, of members (node, n, comp; each node once) in different components: whatever links of these is
    connected by those pairs that link.  `sets` has (node, own) of them at least.  Written."""
    nodes = written(bundles(sets, members), "bundles")
    first = F.lit(0).cast("long")
    rows, found, spent = nodes.select(first.alias("key"), "node", first.alias("at"), first.alias("got")), [], []
    while True:
        ready = rows.join(nodes, "node").select("node", "n", "comp", "names", "sums", "key", "at", "got")
        level = written(extended(ready), "combinations")
        lists = written(lists_of(level), "lists")
        discard(*spent)
        marked = level.join(lists, "key")
        found.append(written(list_pairs(marked.where("short")).union(smallest_pairs(marked.where("full AND NOT short"))).distinct(), "pairs"))
        spent = [level, lists]
        if lists.where("NOT short").isEmpty():
            break
        rows = marked.where("NOT short AND more > 0").select("key", "node", "at", "got")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    pairs = written(every.distinct(), "pairs")
    discard(nodes, *spent, *found)
    return pairs
