"""N-gram Jaccard join (operator 8): token-combination prefixes, then verification.

A text's set has its distinct five-word shingles; two texts link if their Jaccard
similarity is 0.75 or more.  Shingles have one global order: the rarer first (by the number of
different sets that have them), then frequent ones, called heavy, by hash.  Two sets that link share a
shingle among the first n - ceil(0.75 n) + 1 of each.  Shingles of one set alone stand first and
need no key: a set of which more than a quarter is its own links with nothing and drops out.
The other light shingles of a prefix are indexed singly.  If the first shared shingle is heavy, so
are all others; the prefix is then extended by B and both share B + 1 heavy shingles in it.
Heavy shingles fall into B classes by hash, so two of them are in one class: pairs of heavy shingles
of one class are indexed.  B follows the binary order of magnitude of the set's size; a set
whose partners may be of the next smaller order is indexed under both.

Heavy shingles are the most frequent of those that stand out among the LOCAL_TOKENS that a task sees
in a row, MOST_HEAVY at most (two megabytes, so they may be sent to all tasks); which shingles are
heavy changes the cost only, never the result.  All others are counted exactly: they go to buckets by
hash, packed by bucket, and those that several sets have come back to their sets, packed by group of sets.

Equal sets are one node.  The hub of a posting list is the member with the smallest share of shingles of its own.
A hub's star has the members of all its lists, each verified against the hub; links are contracted to
components.  What is left are pairs of one star in different components, and two bounds
drop most before they are made: sets share no more shingles than either shares with any other set, and
no more than they share of the hub's and beside the hub's.  Each member has two masks, bits by hash: of the hub's shingles
that it lacks, and of its own that the hub lacks.  Of what one shares with the hub, the other lacks one at least for each bit that
only its mask has, and likewise of what one has beside the hub, so that near copies with different edits are told apart without being paired.
All other pairs are verified, so the components are exact.  While too many pairs would have to be compared with the
bounds (PAIRS_A_NODE for each node), rounds with other hubs come first as long as they find links (HUB_ROUNDS at most).
If there are still too many, as where many texts share fragments without linking, pairs of a star give way to pairs that
share a token combination, of as many tokens as make its list short (combinations.py); these are verified likewise.

Null and empty texts and texts without words have empty sets and link with nothing.
Repeated rows are nodes of equal sets.  A null id counts as larger than any other.
Columns beside the id and the text are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import binary_array, discard, free_shuffles, giving_back, row_chunks, slices, small_batches, text_buffer, written
from .combinations import combined_pairs
from .components import connected_components
from .textkernel import mix, shingle_sets, words

MOST_HEAVY, LOCAL_HEAVY, LOCAL_TOKENS, PACK_TOKENS = 1 << 18, 3, 1_000_000, 250_000
HUB_ROUNDS, PAIRS_A_NODE, FEW_LINKS = 16, 512, 0.02
MASK = 16  #: words of 64 bits of a mask; a member of a star has one of its hub's shingles that it lacks and one of its own that the hub lacks
FAR_HUB = 4  #: members are held against a hub of at most so many times their shingles (4/3 at least)
STAR_SALTS = 16  #: a large star's members are dealt to so many tasks; the few outside the hub's component go to all of them


def sets_of(texts: pa.Array):
    data, offsets = text_buffer(texts)
    for a, b in row_chunks(offsets):
        yield from shingle_sets(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def flat_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sets end to end, their sizes, and each set's node: a hash of the set, independent of order."""
    own = list(sets_of(texts))
    flat, sizes = np.concatenate([np.zeros(0, np.uint64), *own]), np.array([len(x) for x in own], np.int64)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat * np.uint64(0xC2B2AE3D27D4EB4F)), out=sums[1:])
    ends = np.cumsum(sizes)
    nodes = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return flat, sizes, nodes.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """A row (doc_id, version, n, node) for each text, and rows (token, hits) for shingles that stand out."""

    def run(batches):
        waiting, count = [], 0
        for batch in batches:
            flat, sizes, nodes = flat_sets(batch.column(1))
            yield table([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes), pa.array(nodes), None, None], len(nodes))
            waiting.append(flat)
            count += len(flat)
            if count >= LOCAL_TOKENS:
                yield stand_out(waiting)
                waiting, count = [], 0
        if waiting:
            yield stand_out(waiting)

    def stand_out(waiting):
        flat = np.sort(np.concatenate(waiting))
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        hits = np.diff(np.append(edge, len(flat)))
        top = hits >= LOCAL_HEAVY
        return table([None] * 4 + [pa.array(flat[edge[top]].view(np.int64)), pa.array(hits[top], pa.int64())], int(top.sum()))

    def table(columns, n):
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else c for c in columns], ["doc_id", "version", "n", "node", "token", "hits"])

    return docs.mapInArrow(lambda batches: giving_back(run(batches)), "doc_id long, version long, n long, node long, token long, hits long")


def least_overlap(n: int) -> int:
    return -(-3 * n // 4)


def signatures(n: int, light: np.ndarray, dark: np.ndarray) -> np.ndarray:
    """Keys of a set of n shingles: its light ones that other sets share, the rarer first, and its heavy ones (ascending)."""
    left = n - least_overlap(n) + 1 - (n - len(light) - len(dark))  # of the prefix, after the shingles of this set alone
    if left <= len(light):
        return light[: max(left, 0)]
    keys = [light]
    for band in {n.bit_length(), least_overlap(n).bit_length()}:
        classes = (1 << band) // 32  # a sixteenth of the size, at least
        taken = dark[: left + classes - len(light)]
        if not classes:
            keys.append(mix(taken ^ np.uint64(band)))
            continue
        kind = (taken >> np.uint64(7)) % np.uint64(classes)
        order = np.argsort(kind, kind="stable")
        taken, kind = taken[order], kind[order]
        for gap in range(1, len(taken)):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            keys.append(mix(taken[:-gap][same] * np.uint64(0x9E3779B97F4A7C15) + mix(taken[gap:][same]) + np.uint64(band)))
    return np.concatenate(keys)


PACKED = "place int, side int, nodes binary, sizes binary, tokens binary, hits binary"
RAW, LIGHT, HEAD = 0, 1, 2  #: light shingles in a bucket; light shingles that nodes share; nodes with their sizes and heavy shingles


def six_bytes(tokens: np.ndarray) -> np.ndarray:
    """The upper 48 bits, which tell the shingles of one bucket apart (two that agree would only be taken for shared)."""
    return np.ascontiguousarray(tokens).view("<u2").reshape(-1, 4)[:, 1:]


def eight_bytes(packed: np.ndarray, place: int) -> np.ndarray:
    """Those 48 bits and the bucket: a shingle's name from here on."""
    out = np.empty((len(packed) // 6, 4), "<u2")
    out[:, 0], out[:, 1:] = place & 0xFFFF, packed.view("<u2").reshape(-1, 3)
    return out.reshape(-1).view("<u8")


def packed_rows(place: np.ndarray, side: int, nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, hits: np.ndarray):
    """A row for each place; all arrays are laid out by place, sizes has the tokens of each node (and hits, in heads, the set's size)."""
    edge = np.flatnonzero(np.diff(place, prepend=-1))
    stops = np.append(edge[1:], len(place))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = [(int(a), int(b), int(ends[a]), int(ends[b])) for a, b in zip(edge, stops)]
    columns = [[x[a:b].tobytes() for a, b, _, _ in cuts] for x in (nodes.astype("<i8"), sizes.astype("<u4"))]
    columns.append([tokens[c:d].tobytes() for _, _, c, d in cuts])
    columns.append([hits[a:b].tobytes() if side == HEAD else hits[c:d].tobytes() for a, b, c, d in cuts])
    return pa.RecordBatch.from_arrays([pa.array(place[edge].astype(np.int32)), pa.array(np.full(len(cuts), side, np.int32)), *map(binary_array, columns)], ["place", "side", "nodes", "sizes", "tokens", "hits"])


def by_place(owner: np.ndarray, place: np.ndarray, nodes: np.ndarray, side: int, tokens: np.ndarray, hits: np.ndarray):
    """Rows of tokens that go to their places; tokens of one owner (place in nodes) lie together."""
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return packed_rows(place[first], side, nodes[owner[first]], np.diff(np.append(first, len(owner))), tokens[order], hits[order] if len(hits) else hits)


def dealt(docs: DataFrame, heavy: np.ndarray, places: int) -> DataFrame:
    """Each node's light shingles, packed for their buckets, and its size and heavy shingles, packed for its group."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches):
        known, waiting, count = set(), [], 0
        for batch in batches:
            flat, sizes, nodes = flat_sets(batch.column(0))
            fresh = np.array([s > 0 and x not in known and not known.add(x) for x, s in zip(nodes.tolist(), sizes.tolist())], bool)  # copies once a task
            waiting.append((flat[np.repeat(fresh, sizes)], sizes[fresh], nodes[fresh]))
            count += int(sizes[fresh].sum())
            if count >= PACK_TOKENS:
                yield from pack(waiting)
                waiting, count = [], 0
            if len(known) > 1 << 20:
                known.clear()
        if waiting:
            yield from pack(waiting)

    def pack(waiting):
        flat, sizes, nodes = map(np.concatenate, zip(*waiting))
        order = np.argsort(nodes.view(np.uint64) % np.uint64(places), kind="stable")
        where = np.searchsorted(sent.value, flat)
        dark = sent.value[np.minimum(where, len(sent.value) - 1)] == flat if len(sent.value) else np.zeros(len(flat), bool)
        owner = np.repeat(np.arange(len(nodes)), sizes)
        bucket = (flat[~dark] % np.uint64(places)).astype(np.uint16 if places < 1 << 16 else np.int32)
        yield by_place(owner[~dark], bucket, nodes, RAW, six_bytes(flat[~dark]), np.zeros(0, np.uint32))
        rank = np.empty(len(nodes), np.int64)
        rank[order] = np.arange(len(nodes))
        dark_owner = rank[owner[dark]]
        tokens = flat[dark][np.argsort(dark_owner, kind="stable")]
        yield packed_rows((nodes[order].view(np.uint64) % np.uint64(places)).astype(np.int64), HEAD, nodes[order], np.bincount(dark_owner, minlength=len(nodes)), tokens, sizes[order].astype("<u4"))

    return docs.select("text").mapInArrow(lambda batches: giving_back(run(batches)), PACKED)


def at_places(rows: DataFrame, places: int, finish, schema: str) -> DataFrame:
    """finish(place, its rows as a list of (side, nodes, sizes, tokens, hits)) for each place, each in a task of its own."""

    def arrays(place, side, nodes, sizes, tokens, hits):
        tokens = np.frombuffer(tokens.as_buffer(), np.uint8)
        return side, np.frombuffer(nodes.as_buffer(), "<i8"), np.frombuffer(sizes.as_buffer(), "<u4"), eight_bytes(tokens, place) if side == RAW else tokens.view("<u8"), np.frombuffer(hits.as_buffer(), "<u4")

    def run(batches):
        at, own = None, []
        for batch in batches:
            for k, place in enumerate(batch.column(0).to_pylist()):
                if place != at and own:
                    yield from finish(at, own)
                    own = []
                at = place
                own.append(arrays(place, batch.column(1)[k].as_py(), *(batch.column(i)[k] for i in (2, 3, 4, 5))))
        if own:
            yield from finish(at, own)

    return rows.repartitionById(places, "place").sortWithinPartitions("place").mapInArrow(lambda batches: giving_back(run(batches)), schema)


def joined(own: list, side: int) -> tuple[np.ndarray, ...]:
    parts = [x[1:] for x in own if x[0] == side]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    nodes, sizes, tokens, hits = map(np.concatenate, zip(*parts))
    return nodes, sizes.astype(np.int64), tokens, hits


def counted(rows: DataFrame, places: int) -> DataFrame:
    """The light shingles that several nodes have, with their numbers of nodes, packed for their nodes' groups; heads pass through."""

    def finish(place, own):
        for side, *head in own:
            if side == HEAD:
                yield packed_rows(np.full(len(head[0]), place), HEAD, *head)
        nodes, sizes, tokens, _ = joined(own, RAW)
        if not len(tokens):
            return
        order = np.argsort(tokens)
        tokens, owner = tokens[order], np.repeat(nodes, sizes)[order]
        same = tokens[1:] == tokens[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        tokens, owner = tokens[several], owner[several]
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])[: len(tokens)]  # a node from several tasks
        tokens, owner = tokens[fresh], owner[fresh]
        _, where, hits = np.unique(tokens, return_inverse=True, return_counts=True)
        hits = hits[where]
        tokens, owner, hits = tokens[hits > 1], owner[hits > 1], hits[hits > 1].astype("<u4")
        place = (owner.view(np.uint64) % np.uint64(places)).astype(np.int64)
        order = np.lexsort((owner, place))
        kinds, at = np.unique(owner[order], return_inverse=True)
        yield by_place(at, place[order], kinds, LIGHT, tokens[order], hits[order])

    return at_places(rows, places, finish, PACKED)


def signed(rows: DataFrame, places: int) -> DataFrame:
    """(node, n, s, keys): s of the n shingles are shared with other sets; nodes that can link with nothing are left out."""

    def finish(place, own):
        nodes, dark_sizes, dark, n = joined(own, HEAD)
        starts = np.cumsum(dark_sizes) - dark_sizes
        nodes, first = np.unique(nodes, return_index=True)  # a node from several tasks
        n, starts, dark_sizes = n[first].astype(np.int64), starts[first], dark_sizes[first]
        of, sizes, tokens, hits = joined(own, LIGHT)
        at = np.searchsorted(nodes, np.repeat(of, sizes))
        s = dark_sizes + np.bincount(at, minlength=len(nodes))
        alive = 4 * s >= 3 * n
        kept = alive[at]
        at, tokens, hits = at[kept], tokens[kept], hits[kept]
        order = np.lexsort((tokens, hits, at))
        tokens, ends = tokens[order], np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(nodes)))])
        keys, alive = [], np.flatnonzero(alive)
        for k in alive.tolist():
            keys.append(signatures(int(n[k]), tokens[ends[k] : ends[k + 1]], np.sort(dark[starts[k] : starts[k] + dark_sizes[k]])))
        if keys:
            flat, stops = np.concatenate(keys).astype(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[alive]), pa.array(n[alive]), pa.array(s[alive].astype(np.int64)), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat.view(np.int64)))], ["node", "n", "s", "keys"])

    return at_places(rows, places, finish, "node long, n long, s long, keys array<long>")


def mask_of(tokens: np.ndarray) -> np.ndarray:
    """A bit for each token, by hash: MASK words."""
    bits = np.zeros(64 * MASK, np.uint8)
    bits[mix(tokens) % np.uint64(64 * MASK)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with o, the number of shingles that both sets have, and `masks`: of those of a that b lacks, then of those of b that a lacks."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("own").alias("own_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("own_a")), "a")

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), "<u8") for v in batch.column(i)] for i in (2, 3))
            o, masks = [], [np.zeros(0, "<i8")]
            for p, q in zip(x, y):
                shared = np.intersect1d(p, q, assume_unique=True)
                o.append(len(shared))
                masks += (mask_of(np.setdiff1d(v, shared, assume_unique=True)) for v in (p, q))
            masks = np.concatenate(masks)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(masks) + 1, 2 * MASK, dtype=np.int32)), pa.array(masks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(o, pa.int64()), lists], ["a", "b", "o", "masks"])

    return both.select("a", "b", "own_a", "own_b").mapInArrow(lambda batches: giving_back(run(batches)), "a long, b long, o long, masks array<long>")


def set_bytes(texts: DataFrame) -> DataFrame:
    """(node, own): the shingles of each text, ascending."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_array([x.astype("<u8").tobytes() for x in sets_of(batch.column(1))])], ["node", "own"])

    return texts.select("node", "text").mapInArrow(lambda batches: giving_back(run(batches)), "node long, own binary")


def sizes_fit(x: str = "nx", y: str = "ny") -> Column:
    return 4 * F.least(x, y) >= 3 * F.greatest(x, y)


def by_turn(turn: int) -> Column:
    """An order of nodes: in turn 0 those with the smallest share of shingles of their own come first; then by hash."""
    order = F.xxhash64("node", F.lit(turn))
    return order if turn else F.shiftleft(F.least(F.floor((F.col("n") - F.col("s")) * 256 / F.col("n")), F.lit(63)).cast("long"), 57) + F.shiftrightunsigned(order, 7)


def star_pairs(lists: DataFrame, info: DataFrame, turn: int) -> DataFrame:
    """(hub, node) with sizes and shared shingles of both and `comp`, `hub_comp`: all members of lists that have several components."""
    hubs = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by("node", by_turn(turn)).alias("hub")).where("lo != hi").select("key", "hub")
    pairs = lists.select("key", "node").join(hubs, "key").where("hub != node").select("hub", "node").distinct()
    pairs = pairs.join(info.select("node", "n", "s", "comp"), "node")
    return pairs.join(info.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("s").alias("hub_s"), F.col("comp").alias("hub_comp")), "hub")


def could_link(pairs: DataFrame) -> DataFrame:
    """(a, b) of star pairs that could link, and are not of one component."""
    able = sizes_fit("n", "hub_n") & (7 * F.least("s", "hub_s") >= 3 * (F.col("n") + F.col("hub_n"))) & (F.col("comp") != F.col("hub_comp"))
    return pairs.where(able).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def bounded_pairs(stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of stars (hub, node, n, s, o, q, masks, comp, hub_comp): the members outside the hub's component, and the
    members that one of those could link with (o: overlap with the hub, q: shared shingles beside it; both at most)."""
    x = stars.where("comp != hub_comp")
    reach = x.groupBy("hub").agg(F.max("o").alias("most_o"), F.max("q").alias("most_q"), F.min("n").alias("least_n"), F.count(F.lit(1)).alias("others"))
    y = stars.join(reach, "hub").where(7 * (F.least("o", "most_o") + F.least("q", "most_q")) >= 3 * (F.col("n") + F.col("least_n")))
    return x, y


def shared_most() -> Column:
    """How many shingles two members of a star share, at most, by their masks; null if one was not held against the hub."""
    alone = lambda c, d, at: sum(F.bit_count(F.get(c, k).bitwiseAND(F.bitwise_not(F.get(d, k)))) for k in range(at, at + MASK))
    of_hub = F.least(F.col("ox") - alone("masksy", "masksx", 0), F.col("oy") - alone("masksx", "masksy", 0))
    beside = F.least("qx", "qy", F.col("nx") - F.col("ox") - alone("masksx", "masksy", MASK), F.col("ny") - F.col("oy") - alone("masksy", "masksx", MASK))
    return of_hub + beside


def other_pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b) of one star and different components that the bounds leave."""
    x, y = (t.select("hub", *(F.col(c).alias(c + side) for c in ("node", "n", "s", "o", "q", "masks", "comp")), (F.col("comp") != F.col("hub_comp")).alias("out" + side)) for t, side in ((x, "x"), (y, "y")))
    both = 3 * (F.col("nx") + F.col("ny"))
    fits = (F.col("compx") != F.col("compy")) & (~F.col("outy") | (F.col("nodex") < F.col("nodey"))) & sizes_fit() & (7 * F.least("sx", "sy") >= both) & (7 * (F.least("ox", "oy") + F.least("qx", "qy")) >= both) & F.coalesce(7 * shared_most() >= both, F.lit(True))
    x, y = x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(STAR_SALTS - 1)))), y.withColumn("salt", F.pmod(F.xxhash64("nodey"), F.lit(STAR_SALTS)).cast("int"))
    return x.join(y, (x["hub"] == y["hub"]) & (x["salt"] == y["salt"]) & fits).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def members_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version (hash of the text), n (size of the set) and `first`, the smallest (doc_id, version)
    of the component, for each row of docs; `first` is null for empty sets."""
    docs = small_batches(docs, 1024, 2 << 20).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("version"))
    places = slices(docs)
    described = written(describe(docs), "shingle-sets")
    nodes = described.where(F.col("node").isNotNull()).select("doc_id", "version", "n", "node")
    heavy = described.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("hits").alias("hits"))
    heavy = np.sort(np.array([r[0] for r in heavy.orderBy(F.desc("hits"), "token").limit(MOST_HEAVY).collect()], np.int64).view(np.uint64))  # MOST_HEAVY numbers at most

    keyed = written(signed(counted(dealt(docs, heavy, places), places), places), "prefixes")
    free_shuffles(docs.sparkSession)  # the packed shingles, the largest shuffle, before the texts move
    postings = keyed.select("node", "n", "s", F.explode("keys").alias("key"))
    info = keyed.select("node", "n", "s")
    stars = written(star_pairs(with_components(postings, None), with_components(info, None), 0).drop("comp", "hub_comp"), "stars")

    wanted = stars.select("node").union(stars.select("hub")).distinct()
    wanted = nodes.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("one")).select("node", F.col("one.doc_id").alias("own"), F.col("one.version").alias("own_version"))
    same = F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version"))
    sets = written(set_bytes(docs.join(wanted.hint("shuffle_hash"), same)).dropDuplicates(["node"]), "sets")  # rows repeated in full

    link = 7 * F.col("o") >= 3 * (F.col("n") + F.col("m"))

    def linked(pairs):
        sizes = overlaps(pairs, sets).join(info.select(F.col("node").alias("a"), "n"), "a").join(info.select(F.col("node").alias("b"), F.col("n").alias("m")), "b")
        return sizes.where(link).select("a", "b")

    # members that cannot link with the hub are held against it, too, for the bounds; much smaller ones are not, for the hub's set moves with each
    pairs = stars.where(F.col("hub_n") <= FAR_HUB * F.col("n")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    known = written(overlaps(pairs, sets), "overlaps")
    found = stars.join(known.select(F.col("a").alias("hub"), F.col("b").alias("node"), "o", "masks"), ["hub", "node"], "left")
    found = found.withColumn("q", F.col("s") - F.coalesce("o", F.lit(0))).withColumn("verified", F.coalesce("o", F.lit(-1))).withColumn("o", F.coalesce("o", F.least("n", "hub_n", "s", "hub_s")))
    found = written(found, "stars-verified")
    links = written(found.where(7 * F.col("verified") >= 3 * (F.col("n") + F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")
    labels = connected_components(links)
    n_nodes, before = keyed.count(), 0
    for turn in range(1, HUB_ROUNDS + 1):
        now = with_components(found, labels).join(labels.select(F.col("node").alias("hub"), F.col("comp").alias("hub_comp")), "hub", "left").withColumn("hub_comp", F.coalesce("hub_comp", "hub"))
        x, y = bounded_pairs(now)
        size = y.groupBy("hub").agg((F.count(F.lit(1)) * F.first("others")).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
        final = turn == HUB_ROUNDS or size <= PAIRS_A_NODE * n_nodes or (turn > 1 and links.count() <= (1 + FEW_LINKS) * before)
        before = links.count()
        if final and size > PAIRS_A_NODE * n_nodes:
            pairs = combined_pairs(sets, x.select("node", "n", "comp").union(y.select("node", "n", "comp")).distinct())
        else:
            pairs = written(other_pairs(x, y) if final else could_link(star_pairs(with_components(postings, labels), with_components(info, labels), turn)), "pairs")
        more = written(links.union(linked(pairs)), "links")
        discard(pairs, links, labels)
        links, labels = more, connected_components(more)
        if final:
            break
    discard(keyed, stars, sets, known, found, links)

    members = with_components(nodes, labels)
    # null ids are last, as the largest
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    smallest = members.where("n > 0").groupBy("comp").agg(F.min(place).alias("first")).select("comp", F.struct("first.doc_id", "first.version").alias("first"))
    return members.where("n > 0").join(smallest, "comp").select("doc_id", "version", "n", "first").union(members.where("n = 0").select("doc_id", "version", "n", F.lit(None).cast(smallest.schema["first"].dataType)))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; an empty set's component is its own id."""
    found = members_of(docs, doc_id, text)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id; rows with empty sets stay."""
    found = written(members_of(docs), "members")
    kept = found.where("n = 0 OR (doc_id <=> first.doc_id AND version = first.version)").select(F.col("doc_id").alias("own"), F.col("version").alias("own_version"), (F.col("n") == 0).alias("empty_")).distinct()
    rows = docs.withColumn("version_", F.xxhash64("text"))
    rows = rows.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("version_") == F.col("own_version")))
    repeat = F.row_number().over(Window.partitionBy("doc_id", "version_").orderBy(F.lit(1)))  # rows repeated in full
    return rows.withColumn("repeat_", repeat).where("repeat_ = 1 OR empty_").select(*docs.columns)
