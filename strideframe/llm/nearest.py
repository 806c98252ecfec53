"""Exact top-k search by inner product: a KD-tree per shard, best-first, with the k-th score carried along.

Rows are dealt to shards of about ``SHARD`` rows by a hash, so copies of one vector spread over all of them. A task
builds the tree of a shard by median splits of the widest dimension (by place, so that equal values split too) with
tight boxes. The inner product of a query with any point of a box is at most the sum over dimensions of the larger of
q * low and q * high. Nodes are taken by this bound; a search ends when the best bound is below the k-th score found.
Each query first searches one shard; its k-th score there goes with it to all other shards. Queries stream through a
task in batches behind the points of its shard, so memory is one shard and one batch.

Numbers are integers. While all sums stay below 2**53 the matrix products run in doubles, exactly; otherwise in Python
integers. Components are limited to +-2**62 and scores to 64 bits.

Defined cases: rows whose vector or id is NULL, or whose vector holds a NULL or non-finite component, take no part; a
query meets candidates of its own dimension only; equal scores go by smaller id, then by row; a row is never its own
candidate, but another row with the same id is.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.stages import Scratch

SHARD = 20_000
LEAF = 128
_BATCH = 256
_EDGE = 2.0**62


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(256 * x) of the usable vectors, as little-endian signed 64-bit integers."""
    for batch in batches:
        ids, made, sizes = [], [], []
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if vec_id is None or not vector.is_valid or vector.values.null_count:
                continue
            x = np.floor(256.0 * vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if np.isfinite(x).all():
                ids.append(vec_id)
                made.append(np.clip(x, -_EDGE, _EDGE).astype("<i8").tobytes())
                sizes.append(len(x))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(made, pa.binary())], names=["vec_id", "dim", "raw"]
        )


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        low, high = [], []

        def grow(a: int, b: int) -> int:
            own, number = points[order[a:b]], len(self.spans)
            low.append(own.min(0))
            high.append(own.max(0))
            self.spans.append((a, b))
            self.children.append(None)
            if b - a > LEAF:
                widest = int(np.argmax(high[number].astype(float) - low[number])) if own.shape[1] else 0
                middle = (b - a) // 2
                if own.shape[1]:
                    order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
                left = grow(a, a + middle)
                self.children[number] = (left, grow(a + middle, b))
            return number

        grow(0, len(points))
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.low, self.high = np.array(low), np.array(high)
        self.largest = int(max(abs(int(points.min(initial=0))), abs(int(points.max(initial=0)))))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bounds: list[int | None]) -> Iterator[list[tuple[int, int]]]:
        """Per query up to ``k`` (score, place) among rows other than ``own`` that reach ``bounds``, best first."""
        top = max(self.largest, int(max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0))))))
        kind = np.float64 if max(1, queries.shape[1]) * top * top < 2**53 else object
        points, q = self.points.astype(kind), queries.astype(kind)
        limits = np.maximum(q, 0) @ self.high.astype(kind).T + np.minimum(q, 0) @ self.low.astype(kind).T
        for i in range(len(q)):
            limit, floor = limits[i], bounds[i]
            best: list[tuple[int, int, int, int]] = []  # a heap, worst first: score, -id, -row, place
            heap = [(-limit[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if len(best) == k and -bound < best[0][0] or floor is not None and -bound < floor:
                    break
                children = self.children[node]
                if children:
                    for c in children:
                        heapq.heappush(heap, (-limit[c], c))
                    continue
                a, b = self.spans[node]
                scores = points[a:b] @ q[i]
                least = best[0][0] if len(best) == k else floor
                near = range(b - a) if least is None else np.flatnonzero(scores >= least).tolist()
                for j in near:
                    if self.rows[a + j] != own[i]:
                        entry = (int(scores[j]), -int(self.ids[a + j]), -int(self.rows[a + j]), a + j)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
            yield [(e[0], e[3]) for e in sorted(best, reverse=True)]


_KINDS = "query_id long, query_row long, vec_id long, row long, score long"


def _searched(k: int):
    """Points of a shard (kind 0) come first in the stream, then the queries that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at] and (keys[at][2] == 0 or end - at < _BATCH):
                    end += 1
                dim, part, kind = keys[at]
                if (dim, part) != shard:
                    shard, tree, held = (dim, part), None, []
                rows, ids, raws, limits = (batch.column(i).slice(at, end - at) for i in range(3, 7))
                x = np.frombuffer(b"".join(raws.to_pylist()), "<i8").reshape(end - at, dim)
                if kind == 0:
                    held.append((x, ids.to_numpy(), rows.to_numpy()))
                elif held:
                    tree = tree or Tree(*(np.concatenate(h) for h in zip(*held)))
                    own, found = rows.to_numpy(), []
                    for i, hits in enumerate(tree.search(x, own, k, limits.to_pylist())):
                        for score, place in hits:
                            score = max(-(2**63), min(2**63 - 1, score))
                            found.append((ids[i].as_py(), int(own[i]), int(tree.ids[place]), int(tree.rows[place]), score))
                    columns = list(zip(*found)) if found else [()] * 5
                    names = ["query_id", "query_row", "vec_id", "row", "score"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
                at = end

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best candidates of every row for which ``is_query`` holds
    (an expression on ``vec_id``)."""
    scratch = Scratch(vectors.sparkSession, "nearest")
    plain = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    points = plain.mapInArrow(scaled, "vec_id long, dim int, raw binary")
    points = scratch.keep(points.withColumn("row", F.monotonically_increasing_id()), "points")
    shards = max(1, math.ceil(points.count() / SHARD))
    dealt = points.select(
        "dim", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "vec_id", "raw"
    )
    columns = ["dim", "shard", "kind", "row", "vec_id", "raw", "bound"]

    def visit(queries: DataFrame) -> DataFrame:
        stored = dealt.withColumn("kind", F.lit(0)).withColumn("bound", F.lit(None).cast("long")).select(columns)
        stream = stored.unionByName(queries.withColumn("kind", F.lit(1)).select(columns))
        placed = stream.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")
        return placed.mapInArrow(_searched(k), _KINDS)

    asked = dealt.where(is_query)
    first = scratch.keep(visit(asked.withColumn("bound", F.lit(None).cast("long"))), "first")
    reached = first.groupBy("query_row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    reached = reached.select(F.col("query_row").alias("row"), F.when(F.col("n") >= k, F.col("kth")).alias("bound"))
    everywhere = asked.join(reached, "row", "left").withColumnRenamed("shard", "home").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    ).where("shard <> home")
    found = first.unionByName(scratch.keep(visit(everywhere), "others")) if shards > 1 else first
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same in SQL: every pair scored, ranked by a window.
SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, c.r, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS rank FROM s) WHERE rank <= 5
"""
