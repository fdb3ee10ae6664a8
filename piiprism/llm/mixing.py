"""Mixing sources to target weights.

Every source's words are packed, document after document, into blocks of a fixed number of words. The mix is a
number of output shards, each a row of slots; a shard's slots are dealt to the sources by a multinomial draw from
what each source still has to give, so the totals meet the targets. A source's slots are numbered through all
shards and mapped to its blocks by one pseudorandom permutation for each pass over the source, and blocks are joined
to slots by (source, block index). No pass repeats a block, and a target never exceeds two passes.

Nulls: a null text has no words; a null source is a source of its own, ordered last; null doc_ids are kept. An
empty table gives an empty result. Repeated rows are separate rows. Columns other than doc_id, text and source are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 128
#: Slots of a shard and source that are numbered together.
PIECE = 1 << 16
WORDS = re.compile(common.WORD)


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words wanted of each source: share of all words by weight, the excess over cap x size reshared."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    size = np.array(sizes, float)
    goal = np.zeros(len(size))
    total, free = share * size.sum(), np.ones(len(size), bool)
    while free.any():
        goal[free] = (total - goal[~free].sum()) * w[free] / w[free].sum()
        over = free & (goal > cap * size)
        if not over.any():
            break
        goal[over] = cap * size[over]
        free &= ~over
    return goal.tolist()


def draw(quota: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """Slots by shard and source: multinomial draws from the quota that is left; the columns sum to quota."""
    left = np.array(quota, np.int64)
    rng, rows = np.random.default_rng(seed), []
    for k in range(shards, 0, -1):
        want = int(round(left.sum() / k))
        got = left.copy() if k == 1 else np.minimum(rng.multinomial(want, left / left.sum()), left) if want else np.zeros_like(left)
        rows.append(got)
        left = left - got
    return np.array(rows).reshape(shards, len(quota))


def multiplier(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, b) of the permutation j -> (a j + b) mod n; a j stays within 63 bits."""
    if n < 2:
        return 1, 0
    top = max(2, min(n, (1 << 62) // n))
    a = int(rng.integers(1, top))
    while math.gcd(a, n) != 1:
        a = a % top + 1
    return a, int(rng.integers(0, n))


def packed(docs: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Rows (sid, bucket, row, doc_id, size, digest, start): a document's place among its source's words; the sources' totals.

    The places come from two levels of running sums (within a bucket of a source, then over buckets), so a source
    that holds most rows is still dealt over many tasks.
    """
    sized = common.written(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64("text").alias("digest")), "mix-sizes")
    # one row a source: a corpus has few sources, whatever its size
    found = [r.asDict() for r in sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).collect()]
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = docs.sparkSession
    buckets = min(65536, max(1, -(-sum(r["rows"] for r in found) // 1024)))
    sids = spark.createDataFrame([(r["source"], i) for i, r in enumerate(found)], "source string, sid int")
    rows = (
        sized.join(F.broadcast(sids), sized["source"].eqNullSafe(sids["source"]))
        .select("sid", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "size", "digest")
    )
    w = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "digest")
    rows = rows.withColumn("row", F.row_number().over(w)).withColumn("before", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    over = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", (F.sum("n").over(over) - F.col("n")).alias("offset"))
    return rows.join(offsets, ["sid", "bucket"]).select("sid", "bucket", "row", "doc_id", "size", "digest", (F.col("offset") + F.col("before")).alias("start")), found


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 20260711) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, pieces).

    rows: sid, bucket, row, doc_id, size, start for every document. sources: sid, source, source_size, target.
    pieces: the mix itself, a row for each part of a document in a slot: shard, slot, pass, sid, block, then the
    document (bucket, row) and the words [word_from, word_to) of it.
    """
    spark = docs.sparkSession
    rows, found = packed(docs)
    goal = targets([r["words"] for r in found], weights, share, cap)
    blocks = [-(-r["words"] // block_words) for r in found]
    quota = [min(math.floor(cap) * n, round(g / r["words"] * n)) if r["words"] else 0 for r, g, n in zip(found, goal, blocks, strict=True)]
    sources = spark.createDataFrame([(i, r["source"], r["words"], g) for i, (r, g) in enumerate(zip(found, goal, strict=True))], "sid int, source string, source_size long, target double")

    rng = np.random.default_rng(seed)
    shards = min(4096, max(16, sum(quota) // 65536))
    plan = []
    if quota:
        counts = draw(quota, shards, seed)
        before = np.cumsum(counts, axis=0) - counts
        plan = [(k, s, int(before[k, s]), int(counts[k, s])) for k in range(shards) for s in range(len(quota)) if counts[k, s]]
    passes = [(s, p, blocks[s], *multiplier(blocks[s], rng)) for s in range(len(quota)) for p in range(math.floor(cap))]
    passes = spark.createDataFrame(passes, "sid int, pass long, n long, a long, b long")
    counts = spark.createDataFrame([(s, n) for s, n in enumerate(blocks)], "sid int, blocks long")
    slots = (
        spark.createDataFrame(plan, "shard int, sid int, first long, n long")
        .repartition(common.partitions_for(spark))
        .join(F.broadcast(counts), "sid")
        # in pieces, so that no array grows with the corpus
        .select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE})")).alias("piece"))
        .repartition(common.partitions_for(spark), "shard", "sid", "piece")
        .select("shard", "sid", "blocks", F.explode(F.expr(f"sequence(first + piece * {PIECE}, first + least(n, (piece + 1) * {PIECE}) - 1)")).alias("slot"))
        .withColumn("pass", F.expr("slot div blocks"))
        .join(F.broadcast(passes), ["sid", "pass"])
        .select("shard", "slot", "pass", "sid", F.expr("(a * (slot % n) + b) % n").alias("block"))
    )
    parts = (
        rows.where("size > 0")
        .select("*", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
        .select("sid", "block", "bucket", "row", F.expr(f"greatest(block * {block_words} - start, 0)").alias("word_from"), F.expr(f"least((block + 1) * {block_words} - start, size)").alias("word_to"))
    )
    return rows, sources, slots.join(parts, ["sid", "block"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows, sources, pieces = mix(docs, **options)
    keys = ["sid", "bucket", "row"]
    words = pieces.groupBy(*keys).agg(F.sum(F.expr("word_to - word_from")).alias("words"))
    return (
        rows.join(words, keys, "left")
        .join(F.broadcast(sources), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The words of the spans; a text that is taken whole stays as it is."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    words = [m.span() for m in WORDS.finditer(text)]
    if runs == [[0, len(words)]]:
        return text
    return " ".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs: a document once for each pass that takes words of it, with these words (and n_chars,
    where docs has it)."""
    rows, sources, pieces = mix(docs, **options)
    spans = pieces.groupBy("sid", "bucket", "row", "pass").agg(F.collect_list(F.struct("word_from", "word_to")).alias("spans"))
    names = docs.columns
    # columns of the plan get names that docs does not have
    digest, copy, taken_ = (next(n for n in (f"_{x}{i}" for i in range(len(names) + 1)) if n not in names) for x in ("digest", "copy", "spans"))
    plan = (
        rows.join(F.broadcast(sources.select("sid", "source")), "sid")
        .withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "digest").orderBy("bucket", "row")))
        .join(spans, ["sid", "bucket", "row"])
        .select(F.col("doc_id").alias("p_doc"), F.col("source").alias("p_source"), F.col("digest").alias("p_digest"), F.col("copy").alias("p_copy"), F.col("spans").alias(taken_))
    )
    # copies of a row are numbered by all their columns, so that reruns agree
    rest = F.xxhash64(*(n for n in names if docs.schema[n].dataType.typeName() != "map"))
    own = docs.withColumn(digest, F.xxhash64("text"))
    own = own.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", "source", digest).orderBy(rest)))
    same = own["doc_id"].eqNullSafe(plan["p_doc"]) & own["source"].eqNullSafe(plan["p_source"]) & (own[digest] == plan["p_digest"]) & (own[copy] == plan["p_copy"])
    whole = own.join(plan, same).select(*(own[n] for n in names), plan[taken_])

    def run(batches):
        for b in batches:
            texts = [None if t is None else cut(t, [(s["word_from"], s["word_to"]) for s in x]) for t, x in zip(b.column("text").to_pylist(), b.column(taken_).to_pylist(), strict=True)]
            cols = {n: b.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return whole.mapInArrow(common.lean(run), docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return taken(common.table(spark, sf_dir, "documents"))
