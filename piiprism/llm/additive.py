"""Approximate nearest neighbours by additive quantisation.

Vectors are scaled to length one and encoded as a sum of full-dimensional codewords, one of each codebook; the
codebooks are trained on a bounded sample by k-means on the residuals, and a beam search keeps the BEAM best partial
sums while encoding. The norm of each sum is stored. A query makes a lookup table of its inner products with all
codewords, so a vector's approximate cosine is a few table reads divided by the stored norm. The best vectors of each
lane (one in RERANK, LEAST at least) are then scored exactly on the original vectors, and those scores rank.

Every row is indexed; the sample bounds the training alone. Blocks of queries travel to the lanes that hold the
vectors (``lanes``).

Nulls: vectors that are null or zero, or hold null or non-finite components, take no part, nor do rows with a null
id. Vectors of another length than the query's are no candidates of it. Ties go to the smaller id. A query never
finds a row of its own id; a repeated query is answered once. Columns other than the two are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, lanes

BOOKS, WORDS = 8, 256
BEAM = 4
SAMPLE = 16_384
#: One vector of so many in a lane is scored exactly for each query, and so many at least.
RERANK, LEAST = 64, 16
#: Vectors of a packed part of a lane.
PART_ROWS = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """(books, words, dim): residual k-means, codebook after codebook."""
    rng = np.random.default_rng(seed)
    left, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        c = left[rng.choice(len(left), words, replace=len(left) < words)]
        for _ in range(rounds):
            near = np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, left)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], left[rng.integers(0, len(left), words)])
        near = np.argmax(left @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        left -= c[near]
        out.append(c)
    return np.array(out, np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the sums) by beam search."""
    codes, norms = [], []
    squares = (books * books).sum(axis=2)
    for a in range(0, len(x), 1024):
        left = x[a : a + 1024, None, :].astype(np.float32)  # row, beam, dim: the residuals
        path = np.zeros((len(left), 1, 0), np.uint8)
        for c, s in zip(books, squares, strict=True):
            width = left.shape[1]
            # squared residual after subtracting a codeword
            error = (left * left).sum(axis=2)[:, :, None] - 2 * (left.reshape(-1, left.shape[2]) @ c.T).reshape(len(left), width, -1) + s
            flat = error.reshape(len(left), -1)
            pick = np.argpartition(flat, min(beam, flat.shape[1]) - 1, axis=1)[:, :beam]
            row = np.arange(len(left))[:, None]
            parent, word = pick // len(c), pick % len(c)
            left = left[row, parent] - c[word]
            path = np.concatenate([path[row, parent], word[:, :, None].astype(np.uint8)], axis=2)
        best = np.argmin((left * left).sum(axis=2), axis=1)
        rows = np.arange(len(left))
        codes.append(path[rows, best])
        norms.append(np.sqrt(((x[a : a + 1024] - left[rows, best]) ** 2).sum(axis=1)))
    return np.concatenate(codes), np.concatenate(norms).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    doubles = F.transform(v, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists(doubles, lambda x: x != 0))
        .select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), doubles.alias("vector"))
    )


def search(ids, x, codes, norms, books, q_ids, q, k: int, rerank: int):
    """For each query (query_id, vec_id, score) of its k best in one shard."""
    table = np.einsum("qd,mwd->mqw", q, books, optimize=True)
    length = np.sqrt((x * x).sum(axis=1))
    out = []
    for i in range(len(q_ids)):
        near = table[0, i][codes[:, 0]]
        for m in range(1, len(books)):
            near = near + table[m, i][codes[:, m]]
        near = near / norms
        near[ids == q_ids[i]] = -np.inf
        if len(ids) > rerank:
            # all that tie with the last, then the smaller ids of these: copies share a code
            last = np.partition(near, len(near) - rerank)[len(near) - rerank]
            over, same = np.flatnonzero(near > last), np.flatnonzero(near == last)
            take = np.concatenate([over, same[np.argsort(ids[same], kind="stable")][: rerank - len(over)]])
        else:
            take = np.arange(len(ids))
        take = take[ids[take] != q_ids[i]]
        score = (x[take] * q[i]).sum(axis=1) / (length[take] * np.sqrt((q[i] * q[i]).sum()))
        for j in np.lexsort((ids[take], -score))[:k]:
            out.append((int(q_ids[i]), int(ids[take[j]]), float(score[j])))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, share: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found for each query."""
    spark = vectors.sparkSession
    base = common.written(usable(vectors, id_col, vector_col), "aq-vectors")
    asked = common.written(usable(queries, id_col, vector_col).dropDuplicates(["id"]), "aq-queries")
    total = base.count()
    # the sample bounds the training, by dimension; copies say nothing new
    part = min(1.0, 1.2 * SAMPLE / max(1, total))
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30))).orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()
    models = {int(d): train(np.unique(unit(np.array(g["vector"].tolist())), axis=0)) for d, g in sample.groupby("dim")} if len(sample) else {}
    # BOOKS x WORDS codewords for each length of vectors, whatever their number
    books = spark.sparkContext.broadcast(models)

    def index(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                here = b.filter(pa.array(dims == d))
                x = unit(lanes.matrix(here.column("vector")))
                if int(d) in books.value:
                    codes, norms = encode(x, books.value[int(d)])
                else:  # a length that the sample lacks is rare: its rows are all scored exactly
                    codes, norms = np.zeros((len(x), 0), np.uint8), np.ones(len(x), np.float32)
                yield pa.RecordBatch.from_arrays([here.column("id"), here.column("dim"), here.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], ["id", "dim", "vector", "codes", "norm"])

    indexed = base.mapInArrow(common.lean(index), "id long, dim int, vector array<double>, codes binary, norm float")

    def load(r, ids, x):
        return ids, x, np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["norms"], np.float32)

    def ask(dim, parts, q_ids, q):
        ids, x, codes, norms = (np.concatenate(c) for c in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        parts[:] = [(ids, x, codes, norms)]  # put together once a lane
        c = books.value.get(dim)
        if c is None:
            return search(ids, x, np.zeros((len(ids), 1), np.uint8), norms, np.zeros((1, 1, q.shape[1]), np.float32), q_ids, q, k, len(ids))
        return search(ids, x, codes, norms, c, q_ids, q, k, max(LEAST, k, len(ids) // share))

    found = lanes.answered(lanes.meet(indexed, asked, total, PART_ROWS, codes=True), load, ask, "double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    v = common.table(spark, sf_dir, "embeddings")
    return nearest(v, v.where("vec_id % 50 = 0"))
