"""Exact inner-product search: ball-tree branch and bound in shards.

Rows are dealt into shards by a hash. Each shard's ball tree is built once and stored, a
row of a table. A query visits a shard's leaves in falling order of the bound
``q . centre + |q| radius`` and stops where the bound is below its k-th score so far.

Queries go to the trees: a task reads its shard's tree and then the queries, which
stream by in batches, so it holds one tree and one batch however many there are. The
k-th score is shared in two rounds. First every query searches one shard, which gives
it a k-th score that its final one cannot fall below; with it the query then searches
all other shards. What a task gives back is at most k rows per query.

Queries times shards messages are the price of an exact search; fewer, larger shards
(``shard_rows``, as large as a task's memory allows) lower it.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tastemap.llm.common import blocks, keep

#: Rows of a shard, about.
SHARD = 16_384
LEAF = 128


class BallTree:
    """Balls over integer vectors; leaves hold consecutive rows of ``order``."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        #: (start, end, left, right) of each node; leaves have no children.
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []
        stack = [(0, len(vectors), -1, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            node = len(self.nodes)
            if parent >= 0:
                a, b, *children = self.nodes[parent]
                children[side] = node
                self.nodes[parent] = (a, b, *children)
            rows = vectors[self.order[start:end]].astype(np.float64)
            centre = rows.mean(axis=0)
            apart = rows - centre
            centres.append(centre)
            radii.append(np.sqrt((apart**2).sum(axis=1).max()))
            self.nodes.append((start, end, -1, -1))
            if end - start > leaf and radii[-1] > 0:
                # Along the line from one far point to the point farthest from it.
                first = rows[(apart**2).sum(axis=1).argmax()]
                second = rows[((rows - first) ** 2).sum(axis=1).argmax()]
                along = rows @ (second - first)
                half = (end - start) // 2
                split = np.argpartition(along, half)
                self.order[start:end] = self.order[start:end][split]
                stack += [(start, start + half, node, 0), (start + half, end, node, 1)]
        self.centres = np.array(centres)
        self.radii = np.array(radii)
        self.vectors = np.ascontiguousarray(vectors[self.order])
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))

    def scores(self, start: int, end: int, query: np.ndarray, norm: float, skip: np.ndarray) -> np.ndarray:
        """Inner products; an error if one of a row not skipped does not fit a long."""
        scores = self.vectors[start:end] @ query
        for i in np.flatnonzero((self.norms[start:end] * norm >= 2.0**62) & ~skip[start:end]).tolist():
            exact = sum(int(a) * int(b) for a, b in zip(self.vectors[start + i], query))
            if abs(exact) >= 1 << 63:
                raise ValueError("an inner product does not fit a long; take a smaller scale")
            scores[i] = exact
        return scores

    def search(self, query: np.ndarray, k: int, least: int, skip: np.ndarray, ids: np.ndarray):
        """The k best rows (positions in ``vectors``) by (score falling, id rising).

        ``least``: rows with lower scores may be left out. ``skip``: row to leave out.
        """
        norm = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        above = self.centres @ query + norm * self.radii
        above += 1e-6 * (1 + np.abs(above)) + 1e-9 * norm * self.norms.max(initial=0)  # more than any rounding error
        best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-above[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least:
                break
            start, end, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if above[child] >= least:
                        heapq.heappush(heap, (-above[child], child))
                continue
            scores = self.scores(start, end, query, norm, skip)
            at = np.flatnonzero((scores >= least) & ~skip[start:end])
            if len(at):
                value = np.append(best[0], scores[at])
                rows = np.append(best[1], start + at)
                first = np.lexsort((ids[rows], -value))[:k]
                best = value[first], rows[first]
                if len(first) == k:
                    least = max(least, int(best[0][-1]))
        return best


def quantised(df: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """id and integer vector floor(scale * x); vectors that are null or empty, or hold a
    null or a component that is not finite, are left out, and so are rows without id. A
    finite component that does not fit a long is an error."""
    x = F.transform(column, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & ((F.abs(v) < float("inf"))))
    return df.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fit).select(
        F.col(id_column).cast("bigint").alias("id"),
        F.transform(
            x,
            lambda v: F.when(F.abs(v * scale) < 2.0**63, F.floor(v * scale).cast("bigint")).otherwise(
                F.raise_error("a component does not fit a long; take a smaller scale").cast("bigint")
            ),
        ).alias("vector"),
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


FOUND = "query_id bigint, id bigint, score bigint"
#: Whole numbers below it are exact in floats, whose products are faster.
_EXACT = 2.0**50


def build(rows: pa.Table) -> pa.Table:
    """shard and its tree, with the ids in the tree's order."""
    vectors = _matrix(rows["vector"].combine_chunks())
    tree = BallTree(vectors)
    found = pickle.dumps((tree, rows["id"].to_numpy()[tree.order]), protocol=5)
    return pa.table({"shard": rows["shard"][:1], "tree": pa.array([found], pa.binary())})


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each query's best rows of each shard. Of a shard, the row with the tree is first."""
    tree, ids, largest = None, None, 0.0
    for batch in batches:
        out: tuple[list, list, list] = [], [], []
        for row in range(batch.num_rows):
            if (stored := batch.column("tree")[row]).is_valid:
                tree, ids = pickle.loads(stored.as_py())
                largest = float(np.abs(tree.vectors.astype(np.float64)).max(initial=1))
                floats = tree.vectors.astype(np.float64)
                continue
            query_id, least = batch.column("query_id")[row].as_py(), batch.column("least")[row].as_py()
            query = np.array(batch.column("vector")[row].as_py(), np.int64)
            size = float(np.abs(query.astype(np.float64)).max(initial=1))
            whole = tree.vectors
            if largest * size * len(query) < _EXACT:
                tree.vectors, query = floats, query.astype(np.float64)
            score, at = tree.search(query, k, -(1 << 63) if least is None else least, ids == query_id, ids)
            tree.vectors = whole
            out[0].extend([query_id] * len(at))
            out[1].extend(ids[at].tolist())
            out[2].extend(int(s) for s in score)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "id", "score"])


def top_k(rows: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, id, score: each query's ``k`` rows of the largest inner product.

    Both sides have ``id`` and ``vector`` (whole numbers, one length for all; see
    ``quantised``). A row with the query's own id is no candidate. Ties go to the
    smaller id. Repeated ids of rows are candidates each; of several queries with one id
    the smallest vector is asked. A query without candidates has no rows.
    """
    sizes = rows.groupBy(F.size("vector").alias("n")).count().collect()
    if len(sizes) > 1:
        raise ValueError("vectors of several lengths")
    shards = blocks(sizes[0]["count"] if sizes else 0, shard_rows)
    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"))
    trees = keep(dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "trees")
    asked = keep(queries.groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector")), "queries")
    none = lambda kind: F.lit(None).cast(kind)
    stored = trees.select(
        "shard", none("bigint").alias("query_id"), none("bigint").alias("least"),
        none("array<bigint>").alias("vector"), "tree",
    )
    home = F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(shards)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search(batches, k)

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        """Each query's search of its home shard, or of all the others."""
        at_home = lambda shard: shard == home if first else shard != home
        every = F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), at_home)).alias("shard")
        sent = asked.select(every, "query_id", "least", "vector", none("binary").alias("tree"))
        sent = sent.join(trees.select("shard"), "shard", "left_semi").select(*stored.columns)
        both = stored.unionByName(sent).repartition(shards, "shard")
        return both.sortWithinPartitions("shard", F.col("query_id").asc_nulls_first()).mapInArrow(run, FOUND)

    seed = keep(searched(asked.withColumn("least", none("bigint")), True), "seed")
    kth = seed.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    known = kth.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    found = seed
    if shards > 1:
        found = seed.unionByName(searched(asked.join(known, "query_id", "left"), False))
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
