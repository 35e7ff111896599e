"""Exact top-k search by inner product: one KD-tree per shard, best-first, with a passed-on bound.

Vectors are dealt to shards of bounded size by a hash of their id. A task builds its shard's
KD-tree: the widest dimension is split at its median, and every node keeps the tight bounding box
of its vectors. The inner product of a query with anything in a box is at most the sum over the
dimensions of the larger of query times low side and query times high side. Nodes are taken from a heap by how far their bound
exceeds the kth best score so far, for a block of queries at once; a query leaves a node whose
bound is below its kth score. Equal bounds are visited, so ties are settled by the id.

Two rounds: each query first searches its own shard, which gives it a kth score; that score
goes along to all other shards, where it prunes from the start. Every query meets every shard in
blocks; a shard returns at most k rows per query.

Components are multiplied in floating point only while all products and sums stay exact
integers (checked per shard and block), otherwise as 64-bit or Python integers.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, take no part; vectors of
other lengths than the query's are no candidates; rows that share an id are rows of their own, each a candidate of the others and, where asked,
a query with its own answer; components and scores beyond a long are taken as the nearest long; fewer than k candidates give all of them; an empty table an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.llm.common import saved, ship, table

#: Vectors per shard, per leaf and queries per block.
SHARD_ROWS, LEAF_ROWS, BLOCK = 20_000, 256, 1024
TOP, SCALE, EVERY = 20, 64, 20

_ID_BITS = 21
_NONE = np.iinfo(np.int64).min


class KdTree:
    """Median splits over integer vectors; nodes in arrays, vectors in leaf order."""

    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(vectors))
        self.low, self.high, self.range, self.children = [], [], [], []
        stack = [(0, len(vectors), -1)]
        while stack:
            a, b, parent = stack.pop()
            here = vectors[self.order[a:b]]
            node = len(self.range)
            self.low.append(here.min(0))
            self.high.append(here.max(0))
            self.range.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if b - a > leaf_rows and vectors.shape[1] and (self.high[-1] > self.low[-1]).any():
                widest = int((self.high[-1] - self.low[-1]).argmax())
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(here[:, widest], middle)]
                stack += [(a, a + middle, node), (a + middle, b, node)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, node: int, queries: np.ndarray) -> np.ndarray:
        """The most a vector below a node can score."""
        return np.maximum(queries, 0) @ self.high[node] + np.minimum(queries, 0) @ self.low[node]


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and rows per query, as one sorted code per hit (score, then earlier row); a query does not meet the row with its own id.

    ``floor`` holds the score each query's hits must reach at least.
    """
    reach = max(1, int(np.abs(vectors).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, vectors.shape[1])
    if reach >= 1 << 62:
        return _search_wide(vectors, ids, queries, query_ids, floor, top)
    if reach >= 1 << (62 - _ID_BITS):
        return _search_long(vectors, ids, queries, query_ids, floor, top)
    kind = np.float64 if reach < 1 << 53 else np.int64
    ordered, asked = vectors[tree.order].astype(kind), queries.astype(kind)
    box = KdTree.__new__(KdTree)
    box.low, box.high = tree.low.astype(kind), tree.high.astype(kind)
    low_bits = (1 << _ID_BITS) - 1
    best = np.full((len(queries), top), _NONE, np.int64)
    kth = floor.astype(np.int64).copy()
    everyone = np.arange(len(queries))
    first = box.bounds(0, asked)
    heap, count = [(0.0, 0, 0, everyone, first)], 1
    while heap:
        _, _, node, active, bound = heapq.heappop(heap)
        still = bound >= kth[active]
        active = active[still]
        if not len(active):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                bound = box.bounds(child, asked[active])
                lead = (bound - kth[active].astype(np.float64)).max()
                heapq.heappush(heap, (-lead, count, child, active, bound))
                count += 1
            continue
        a, b = tree.range[node]
        rows = tree.order[a:b]
        scores = (asked[active] @ ordered[a:b].T).astype(np.int64)
        code = (scores << _ID_BITS) | (low_bits - rows)
        code[(ids[rows][None, :] == query_ids[active][:, None]) | (scores < kth[active][:, None])] = _NONE
        merged = np.concatenate([best[active], code], axis=1)
        merged = np.partition(merged, merged.shape[1] - top, axis=1)[:, -top:]
        best[active] = merged
        lowest = merged.min(1)
        kth[active] = np.maximum(kth[active], np.where(lowest == _NONE, kth[active], lowest >> _ID_BITS))
    return best >> _ID_BITS, np.where(best == _NONE, -1, low_bits - (best & low_bits))


def _search_long(vectors, ids, queries, query_ids, floor, top):
    """The same result for scores that leave no room for a row number beside them, in exact 64-bit integers, some queries at a time."""
    score, row = np.zeros((len(queries), top), np.int64), np.full((len(queries), top), -1, np.int64)
    k = min(top, len(vectors))
    for start in range(0, len(queries), 32):
        part = slice(start, start + 32)
        found = queries[part].astype(np.int64) @ vectors.astype(np.int64).T
        found[(ids[None, :] == query_ids[part][:, None]) | (found < floor[part][:, None])] = _NONE
        # The complement turns the order around without overflow; of equal scores the earlier row stays first.
        order = np.argsort(~found, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(found, order, 1)
        score[part, :k], row[part, :k] = best, np.where(best == _NONE, -1, order)
    return score, row


def _search_wide(vectors, ids, queries, query_ids, floor, top):
    """The same result for components too large for packed codes, in exact Python integers; scores saturate at a long."""
    score, row = np.zeros((len(queries), top), np.int64), np.full((len(queries), top), -1, np.int64)
    exact = vectors.astype(object)
    for q in range(len(queries)):
        values = [max(-2**63 + 1, min(2**63 - 1, int(v))) for v in exact @ queries[q].astype(object)]
        ranked = sorted((-v, i) for i, v in enumerate(values) if ids[i] != query_ids[q] and v >= floor[q])[:top]
        for k, (v, i) in enumerate(ranked):
            score[q, k], row[q, k] = -v, i
    return score, row


def usable(vectors: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, top: int = TOP, shard_rows: int = SHARD_ROWS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` rows per query; both tables hold vec_id and integer ``vector``s."""
    spark = rows.sparkSession
    ship(spark)
    # Rows have numbers of their own, since ids may repeat.
    rows = saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", F.size("vector").alias("dim")), "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    data = rows.select("dim", shard.alias("shard"), "vec_id", "row", "vector", F.lit(None).cast("long").alias("floor"), F.lit(-1).alias("block"))
    asked = queries.select("vec_id").distinct().join(rows, "vec_id")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))
    schema = "query_row long, query_id long, vec_id long, score long"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by dimension, shard and block: a shard's vectors, then its queries."""
        tree = key = None
        held: list[tuple] = []
        waiting: list[tuple] = []
        waiting_block = None

        def answers():
            if waiting and tree_of():
                built, vectors, ids, numbers = tree_of()
                asked_rows = np.array([w[1] for w in waiting], np.int64)
                floor = np.array([_NONE if w[3] is None else w[3] for w in waiting], np.int64)
                score, row = search(built, vectors, numbers, np.stack([w[2] for w in waiting]), asked_rows, floor, top)
                q, at = np.nonzero(row >= 0)
                asked_ids = np.array([w[0] for w in waiting], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(asked_rows[q]), pa.array(asked_ids[q]), pa.array(ids[row[q, at]]), pa.array(score[q, at])],
                                                 ["query_row", "query_id", "vec_id", "score"])
            waiting.clear()

        def tree_of():
            """The shard's tree, with its vectors in the order of their ids, so that of equal scores the smaller id comes first."""
            nonlocal tree
            if tree is None and held:
                order = sorted(range(len(held)), key=lambda i: held[i][:2])
                ids, numbers = (np.array([held[i][k] for i in order], np.int64) for k in (0, 1))
                vectors = np.stack([held[i][2] for i in order])
                tree = (KdTree(vectors), vectors, ids, numbers)
            return tree

        for batch in batches:
            values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            dims = batch.column("dim").to_pylist()
            ends = np.cumsum(dims)
            columns = (batch.column(k).to_pylist() for k in ("shard", "vec_id", "row", "floor", "block"))
            for i, (dim, part, vec_id, row, floor, number) in enumerate(zip(dims, *columns, strict=True)):
                vector = values[ends[i] - dim:ends[i]]
                if (dim, part) != key:
                    yield from answers()
                    tree, key, waiting_block = None, (dim, part), None
                    held = []
                if number < 0:
                    held.append((vec_id, row, vector.copy()))
                    continue
                if number != waiting_block or len(waiting) >= 2 * block:
                    yield from answers()
                    waiting_block = number
                waiting.append((vec_id, row, vector.copy(), floor))
        yield from answers()

    columns = ["dim", "shard", "vec_id", "row", "vector", "floor", "block"]

    def round_of(questions: DataFrame) -> DataFrame:
        dealt = data.union(questions.select(*columns)).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "block")
        return dealt.mapInArrow(find, schema)

    home = saved(round_of(asked.withColumns({"shard": shard, "floor": F.lit(None).cast("long")})), "home")
    floors = home.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select(
        "row", F.when(F.col("n") >= top, F.col("least")).alias("floor"))
    found = home
    if shards > 1:
        away = asked.withColumn("home", shard).join(floors, "row", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
        found = home.union(saved(round_of(away), "away"))
    ranks = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", ranks).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    least = F.lit(-(2**63) + 1)
    rows = rows.select("vec_id", F.transform("v", lambda x: F.greatest(F.floor(x.cast("double") * SCALE), least)).alias("vector"))
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
