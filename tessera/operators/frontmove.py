"""Move-to-front lists undone over long sequences.

A token is a place in a list of symbols; the symbol found there moves to the front.  What a stretch of tokens does to the list
is a permutation, and permutations compose associatively.  So a sequence falls into blocks: each block runs from the untouched
list, the blocks' permutations are scanned in levels of FAN, and a symbol is what the list at its block's start
has at the place that the block alone found.  No block, and no level of one, is more than a bounded group, however long the sequence.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

SYMBOLS, BLOCK, FAN = 256, 4096, 512


def _starts(totals: DataFrame, kind: str, fan: int, symbols: int, most: int) -> DataFrame:
    """owner, block, start: the list before each block; totals: owner, block, after (what the block makes of an untouched list)."""
    schema = f"owner {kind}, block long, start array<int>"

    def groups(table: pa.Table):
        """Blocks, their lists and the first list of each group of FAN or fewer; several groups of one owner come together."""
        table = table.sort_by("block")
        blocks, after = table.column("block").to_numpy(), table.column("after").combine_chunks().flatten().to_numpy().reshape(-1, symbols)
        first = table.column("start").combine_chunks().flatten().to_numpy().reshape(-1, symbols) if "start" in table.schema.names else None
        edges = np.flatnonzero(np.diff(blocks // fan, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(blocks)]):
            yield blocks[a:b], after[a:b], np.arange(symbols, dtype=np.int32) if first is None else first[a]

    def table_of(owner, blocks: list, lists: list, name: str) -> pa.Table:
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * symbols), pa.array(np.concatenate(lists).astype(np.int32)))
        return pa.table([pa.repeat(owner, len(lists)), pa.array(np.array(blocks, np.int64)), flat], ["owner", "block", name])

    def within(key: tuple, table: pa.Table) -> pa.Table:
        """Lists before the blocks of each group; the group's own first list stands in `start`, or is untouched."""
        at, out = [], []
        for blocks, after, now in groups(table):
            for p in after:
                out.append(now)
                now = now[p]
            at += blocks.tolist()
        return table_of(key[0], at, out, "start")

    if most < fan:
        return totals.groupBy("owner").applyInArrow(within, schema)

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        at, out = [], []
        for blocks, after, now in groups(table.select(["block", "after"])):
            for p in after:
                now = now[p]
            at.append(blocks[0] // fan)
            out.append(now)
        return table_of(key[0], at, out, "after")

    grouped = totals.withColumns({"over": F.floor(F.col("block") / fan), "many": F.floor(F.col("block") / (fan * max(1, FAN // fan)))})
    above = grouped.groupBy("owner", "many").applyInArrow(whole, f"owner {kind}, block long, after array<int>")
    starts = _starts(above, kind, fan, symbols, most // fan).select(F.col("owner").alias("owner_"), F.col("block").alias("over_"), "start")
    held = grouped.join(starts, F.col("owner").eqNullSafe(F.col("owner_")) & (F.col("over") == F.col("over_"))).select("owner", "many", "block", "after", "start")
    return held.groupBy("owner", "many").applyInArrow(within, schema)


def undone(tokens: DataFrame, owner: str = "owner", place: str = "place", token: str = "v", symbols: int = SYMBOLS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """tokens (owner, place, v) -> owner, place, v: the symbols; each owner has a list of its own, which starts as 0, 1, 2, ...

    Places count from 0 and are distinct; places may be missing.  A null owner is an owner.  A token that is null or no place in the list gives null."""
    rows = tokens.select(F.col(owner).alias("owner"), F.floor(F.col(place) / block).alias("block"), F.col(place).cast("long").alias("place"), F.col(token).cast("int").alias("v"))
    kind, owner_type = dict(rows.dtypes)["owner"], to_arrow_type(rows.schema["owner"].dataType)

    def run(batches):
        """Tokens in order, block after block; a block's last row, without a place, has its list."""
        at, own = None, []

        def table(part: list) -> pa.RecordBatch:
            owners, blocks, places, found, lists = zip(*part)
            made = pa.array(lists, pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(owners, owner_type), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), pa.array(found, pa.int32()), made], ["owner", "block", "place", "found", "after"])

        for batch in batches:
            owners, blocks, places, tokens = (batch.column(k).to_pylist() for k in range(4))
            part: list = []
            for owner, block_, place_, t in zip(owners, blocks, places, tokens):
                if (owner, block_) != at:
                    if at is not None:
                        part.append((*at, None, None, own))
                    at, own = (owner, block_), list(range(symbols))
                good = t is not None and 0 <= t < symbols
                if good and t:
                    own.insert(0, own.pop(t))
                part.append((owner, block_, place_, own[0] if good else None, None))
            if part:
                yield table(part)
        if at is not None:
            yield table([(*at, None, None, own)])

    dealt = rows.repartition("owner", "block").sortWithinPartitions("owner", "block", "place")
    alone = dealt.mapInArrow(run, f"owner {kind}, block long, place long, found int, after array<int>")
    most = rows.agg(F.max("block")).first()[0]  # one number
    starts = _starts(alone.where("after IS NOT NULL").select("owner", "block", "after"), kind, fan, symbols, most or 0)
    starts = starts.select(F.col("owner").alias("owner_"), F.col("block").alias("block_"), "start")
    held = alone.where("place IS NOT NULL").join(starts, F.col("owner").eqNullSafe(F.col("owner_")) & (F.col("block") == F.col("block_")))
    return held.select(F.col("owner").alias(owner), F.col("place").alias(place), F.get("start", F.col("found")).alias(token))


def is_dense(clusters: DataFrame, owner: str = "owner", cluster: str = "v") -> DataFrame:
    """owner, clusters, valid: whether the numbers of an owner's clusters have no hole."""
    counts = clusters.groupBy(owner).agg((F.max(cluster) + 1).cast("long").alias("clusters"), F.count_distinct(cluster).alias("used_"))
    return counts.select(owner, "clusters", (F.col("clusters") == F.col("used_")).alias("valid"))
