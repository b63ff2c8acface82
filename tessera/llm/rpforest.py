"""Approximate nearest neighbours by inner product (operator 6): a forest of
random-projection trees, one shared priority queue a query, exact reranking.

Vectors get one more component so that all have the norm of the longest; then the largest
inner product is the smallest angle.  The hyperplanes are fitted on a sample (SAMPLE
vectors at most, those of smallest hash); every vector is indexed.  A query walks all trees
with one queue of (margin, node) and visits the PROBES best leaves; each leaf, in blocks of
about BLOCK vectors, meets its queries in one matrix product on the original vectors, and
gives at most `k` rows a query.  The default number of probes is set for vectors without any
structure (64 independent components), where nine tenths of the neighbours need about half
of the table; clustered vectors need fewer.

Equal vectors are one entry with their k + 1 smallest ids, which is all a query can use, so
a vector that a third of the rows share is no hot leaf.  Vectors that are null, zero, or
have null or non-finite components, or another length than most, take no part, neither
does a null id.  Of rows repeated with one id each is a candidate, but an id is listed once
a query, with its best score.  Ties go to the smaller id.  Other columns are not read.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .columns import small_batches, written

SAMPLE, TREES, LEAVES, LEAST_LEAF, PROBES, BLOCK = 20_000, 16, 64, 48, 60, 4096


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return rows.where(F.size("v") == (common["length"] if common else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and its k + 1 smallest ids; a first selection on 32 salts spreads a vector that many rows have."""
    rows = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    for keys in (["v", "salt"], ["v"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("place") <= k + 1)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Forest:
    """Trees as arrays: node i has hyperplane i; children below LEAVES * 2, leaves negative."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int = TREES, leaves: int = LEAVES, least: int = LEAST_LEAF, seed: int = 0):
        self.longest = longest
        rng, points = np.random.default_rng(seed), self.lift(sample)
        self.planes, self.cuts, self.children, self.roots, self.leaves = [], [], [], [], 0

        def grow(own: np.ndarray, depth: int) -> int:
            if 2 ** (depth + 1) <= leaves and len(own) >= 2 * least:
                for _ in range(8):
                    a, b = points[rng.choice(own, 2, replace=False)]
                    side = points[own] @ (a - b)
                    cut = float(np.median(side))
                    low, high = own[side <= cut], own[side > cut]
                    if len(low) and len(high):
                        node = len(self.planes)
                        self.planes.append((a - b) / np.linalg.norm(a - b))
                        self.cuts.append(cut / np.linalg.norm(a - b))
                        self.children.append(None)
                        self.children[node] = (grow(low, depth + 1), grow(high, depth + 1))
                        return node
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points)), 0))
        self.planes = np.array(self.planes).reshape(len(self.planes), -1) if self.planes else np.zeros((0, points.shape[1]))
        self.cuts = np.array(self.cuts)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest**2 - (vectors**2).sum(1), 0)
        return np.hstack([vectors, np.sqrt(rest)[:, None]])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        high = self.lift(vectors) @ self.planes.T > self.cuts
        out = np.zeros((len(vectors), len(self.roots)), np.int64)
        table = np.array(self.children).reshape(-1, 2)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                at[inner] = table[node, high[inner, node].astype(int)]
            out[:, t] = -at - 1
        return out

    def probe(self, queries: np.ndarray, probes: int) -> list[list[int]]:
        """The leaves that each query visits, nearest first, over all trees with one queue."""
        margins = np.hstack([queries, np.zeros((len(queries), 1))]) @ self.planes.T - self.cuts
        found = []
        for own in margins.tolist():
            queue = [(0.0, -i, root) for i, root in enumerate(self.roots)]
            heapq.heapify(queue)
            seen, visited = len(queue), []
            while queue and len(visited) < probes:
                worst, _, node = heapq.heappop(queue)
                while node >= 0:
                    m = own[node]
                    low, high = self.children[node]
                    near, far = (high, low) if m > 0 else (low, high)
                    seen += 1
                    heapq.heappush(queue, (max(worst, abs(m)), seen, far))
                    node = near
                visited.append(-node - 1)
            found.append(visited)
        return found


def search(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", probes: int = PROBES, trees: int = TREES, leaves: int = LEAVES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k nearest rows of df found, itself left out."""
    spark = small_batches(df).sparkSession
    rows = valid(df, key, vector)
    entries = written(distinct_vectors(rows, k), "vectors")
    size, longest = entries.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = valid(queries, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], schema)
    sample = np.array([r[0] for r in entries.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()])  # SAMPLE vectors at most
    forest = Forest(sample, longest, trees, leaves)
    blocks = max(1, -(-size // (BLOCK * max(1, forest.leaves // trees))))

    def place(batches):
        for batch in batches:
            own = forest.leaves_of(matrix(batch.column(0)))
            n, t = own.shape
            take = pa.array(np.repeat(np.arange(n), t))
            yield pa.RecordBatch.from_arrays([pa.array(own.reshape(-1)), batch.column(0).take(take), batch.column(1).take(take)], ["leaf", "v", "ids"])

    def ask(batches):
        for batch in batches:
            visited = forest.probe(matrix(batch.column(1)), probes)
            take = pa.array(np.repeat(np.arange(len(visited)), [len(x) for x in visited]))
            yield pa.RecordBatch.from_arrays([pa.array([x for own in visited for x in own], pa.int64()), batch.column(0).take(take), batch.column(1).take(take)], ["leaf", "query_id", "q"])

    def meet(key_, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        x, ids = matrix(left.column("v").combine_chunks()), left.column("ids").combine_chunks()
        owner, flat = np.repeat(np.arange(len(x)), ids.value_lengths().to_numpy()), ids.flatten().to_numpy()
        out = []
        repeats = len(np.unique(flat)) < len(flat)  # ids that have several vectors
        asked_, points = right.column("query_id").to_numpy(), matrix(right.column("q").combine_chunks())
        for a in range(0, len(asked_), 256):
            scores = points[a : a + 256] @ x.T
            for i, line in enumerate(scores):
                line = line[owner]
                other = np.flatnonzero(flat != asked_[a + i])
                if repeats:
                    other = other[np.lexsort((flat[other], -line[other]))]
                    other = other[np.unique(flat[other], return_index=True)[1]]  # each id's best vector
                if len(other) > k:  # ties at the edge stay until ids decide
                    other = other[line[other] >= np.partition(line[other], -k)[-k]]
                best = other[np.lexsort((flat[other], -line[other]))][:k]
                out.append((np.full(len(best), asked_[a + i]), flat[best], line[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "vec_id", "score"])

    index = entries.mapInArrow(place, "leaf long, v array<double>, ids array<long>").withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)))
    visits = asked.mapInArrow(ask, "leaf long, query_id long, q array<double>").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = index.groupBy("leaf", "block").cogroup(visits.groupBy("leaf", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
