"""Exact top-k search by inner product over KD-trees, one for each shard.

Vectors are dealt to lanes and shards by a hash of their id. Each shard becomes a KD-tree once: median splits on the
widest dimension down to small leaves, each node with its tight bounding box. Blocks of queries travel to the lanes
(``lanes``). The traversal is best-first: a box bounds the inner product from above, a query opens its boxes in falling
order of the bound, and stops at the first that cannot beat its k-th score (or tie with it at a smaller id). The k-th
scores are propagated from shard to shard of a lane, so later shards open few boxes.

Vectors are kept as integers, floor(scale * x) of each component as a double, and scores are exact integers: sums that
could pass 2^53 are taken in whole numbers (the components themselves are exact below 2^53). A score beyond 64 bits is
the least or highest 64-bit number; among those of one lane the true scores decide, between lanes the ids.

Nulls: vectors that are null, or hold null or non-finite components, take no part, nor do rows with a null id.
Vectors of another length than the query's are no candidates of it. Ties go to the smaller id. Repeated ids are rows of their
own, except that a query never finds a row of its own id, and a query that is repeated is answered once. Columns other than the two are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, lanes

LEAF = 64
#: Vectors of a shard, about.
SHARD_ROWS = 4096
SCALE = 1024
#: Scores are 64-bit numbers.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, dim, vector (array of doubles that hold integers) of the vectors that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector")
    )


class Tree:
    """A KD-tree over the rows of x (ids ascending within ties of nothing: any order is right)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.left, self.right, self.span, self.least = [], [], [], [], [], []

        def build(a: int, b: int) -> int:
            rows = order[a:b]
            me = len(self.low)
            self.low.append(x[rows].min(axis=0))
            self.high.append(x[rows].max(axis=0))
            self.least.append(ids[rows].min())
            self.span.append((a, b))
            self.left.append(-1)
            self.right.append(-1)
            if b - a > leaf:
                wide = int(np.argmax(self.high[me] - self.low[me]))
                mid = (b - a) // 2
                order[a:b] = rows[np.argpartition(x[rows, wide], mid)]
                self.left[me] = build(a, a + mid)
                self.right[me] = build(a + mid, b)
            return me

        if len(ids):
            build(0, len(ids))
        self.ids, self.x = ids[order], x[order]
        self.most = float(np.abs(x).max()) * x.shape[1] if x.size else 0.0
        self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """best: a heap of (score, -id), the k best so far; returned with this tree's rows taken in."""
        if not len(self.ids):
            return best
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        bounds = self.high @ up + self.low @ down  # of all boxes in one product
        wide = self.most * float(np.abs(q).max(initial=0)) >= 2.0**52  # sums of doubles may be off
        if wide:
            bounds = bounds + 1e-9 * self.most * float(np.abs(q).max())
            whole = [int(v) for v in q]
        queue = [(-bounds[0], int(self.least[0]), 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if len(best) == k and (-bound, -least) < best[0]:
                if -bound < best[0][0]:
                    break
                continue
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bounds[child], int(self.least[child]), child))
                continue
            a, b = self.span[node]
            score = np.array([sum(int(v) * w for v, w in zip(row, whole, strict=True)) for row in self.x[a:b]], object) if wide else self.x[a:b] @ q
            for i in np.flatnonzero(score >= best[0][0]) if len(best) == k else range(b - a):
                row = (int(score[i]), -int(self.ids[a + i]))
                if -row[1] == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, row)
                elif row > best[0]:
                    heapq.heapreplace(best, row)
        return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest of each query over all vectors but those of its own id."""
    base = common.written(integers(vectors, id_col, vector_col, scale), "kd-vectors")
    asked = common.written(integers(queries, id_col, vector_col, scale).dropDuplicates(["id"]), "kd-queries")

    def search(dim, trees, ids, x):
        for own, q in zip(ids.tolist(), x, strict=True):
            best: list[tuple[int, int]] = []
            for tree in trees:
                best = tree.search(q, own, k, best)
            yield from ((own, -n, min(max(s, LEAST), MOST)) for s, n in best)

    rows = lanes.meet(base, asked, base.count(), SHARD_ROWS)
    found = lanes.answered(rows, lambda r, ids, x: Tree(ids, x), search, "long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8(spark, sf_dir: str) -> DataFrame:
    v = common.table(spark, sf_dir, "embeddings")
    return top_k(v, v.where("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(list_inner_product(q.x, b.x) AS BIGINT) AS score
  FROM v q JOIN v b ON q.vec_id <> b.vec_id AND len(q.x) = len(b.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""
