"""MinHash near-duplicate detection with odd sketches.

Each text becomes the set of its distinct word shingles (64-bit hashes). MinHash samples of the set are read twice:
in bands, whose equal values make candidates, and folded into an odd sketch, a bitmap in which every sample flips
one bit. The population count of two sketches' XOR estimates high similarities precisely, so it drops most wrong
candidates; the rest are confirmed on the full sets. Documents with equal sets are joined first, by a hash of the
whole set, and take part as one.

A bucket of a band can hold a third of all rows, so its members are not paired with one another. Every member is
first compared with the least member of its buckets; then, only in buckets whose members are not yet in one
component, with the least of each such bucket. What is left are buckets whose members are in several components:
copies around the threshold, or texts that share passages. The full sets of such a bucket's members are dealt to
blocks of bounded size, each pair of blocks is compared exactly by one task, and only a spanning forest of the links
leaves it. Buckets with the same members are compared once. The rule is one for all sizes of buckets: a link is found
if its texts share a band, which texts at the threshold fail to do with the probability below.

Nulls and empty texts have an empty set and link with nothing. A null doc_id links with nothing and is kept, with a
null component. Rows that repeat a doc_id are one document with the links of each of its rows. Ties do not arise:
a component is named by its least doc_id. Columns other than doc_id and text are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mixed, shingles, words

#: 32 bands of 6 samples miss a pair of similarity 0.85 with probability 3e-7, one of 0.8 with 5e-5.
BANDS, ROWS = 32, 6
SKETCH_BITS = 512
#: Rows and shingles of a block of a bucket, about.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(977)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


_A, _B = _coefficients(BANDS * ROWS)


def samples(hashes: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        best = np.minimum(best, (x[i : i + 1024, None] * _A + _B).min(axis=0))
    return best


def band_values(sample: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = sample.reshape(bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return out.view(np.int64)


def odd_sketch(sample: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    k = np.arange(len(sample), dtype=np.uint64)
    at = mixed(mixed(k) + sample.astype(np.uint64)) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def sketch_limit(threshold: float, k: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """XOR population count that a pair at the threshold exceeds with a probability below one in a million: five
    deviations of the samples, then five of the bitmap."""
    low = max(0.0, threshold - 5 * math.sqrt(threshold * (1 - threshold) / k))
    flips = 2 * k * (1 - low)
    mean = bits / 2 * (1 - math.exp(-2 * flips / bits))
    return math.ceil(mean + 5 * math.sqrt(bits / 4 * (1 - math.exp(-4 * flips / bits))))


SIGNED = "doc_id long, n_shingles long, set_hash binary, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        known = words()
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                h = shingles(t, width, known)
                if len(h):
                    s = samples(h)
                    rows.append((len(h), xxhash.xxh3_128_digest(h), band_values(s), odd_sketch(s)))
                else:
                    rows.append((0, None, None, None))
            n, digest, bands, sketch = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_hash", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), SIGNED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        known = words()
        for b in batches:
            sets = [shingles(t, width, known).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "id long, set binary")


def confirmed(pairs: DataFrame, meta: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: sizes, then sketches, then full sets."""
    limit = sketch_limit(percent / 100)
    left = meta.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = meta.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    flipped = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = (
        common.salted_join(pairs, left, "a", "b")  # a group's lead is in as many pairs as the group has members
        .join(right, "b")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .where(flipped <= limit)
        .select("a", "b")
        .distinct()
    )
    both = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(common.lean(check), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for each vertex of the edges (a, b); label is the least id that can be reached.

    Labels spread along edges and jump to their label's label, so long chains need few rounds.
    """
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "cc-labels")
    held = labels
    while True:
        near = common.salted_join(both, labels.select(F.col("id").alias("b"), "label"), "b", "a").groupBy("a").agg(F.min("label").alias("m"))
        spread = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        step = common.written(common.salted_join(spread, jump, "via", "id").select("id", "old", F.least("via", "far").alias("label")), "cc-labels")
        common.discard(held)
        held, labels = step, step.select("id", "label")
        if not step.where("old <> label").limit(1).count():
            return labels


def undecided(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, label, lead (least id, with its label) of the buckets whose members are in several components."""
    named = members.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    by = named.groupBy("key").agg(F.min(F.struct("id", "label")).alias("lead"), F.max("label").alias("high"), F.min("label").alias("low")).where("low < high")
    return named.join(by.select("key", "lead"), "key")


def forest(left: dict, right: dict, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks that join different components: ids, labels and sets by name."""
    sets = left["set"] + right["set"]
    n, split = len(sets), len(left["set"])
    sizes = np.array([len(s) for s in sets])
    col = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    used, col, seen = np.unique(col, return_inverse=True, return_counts=True)
    live = np.flatnonzero(seen > 1)  # a shingle of one text adds nothing to an intersection
    place = np.full(len(used), -1)
    place[live] = np.arange(len(live))
    col = place[col]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((split, n - split), np.float32)
    for a in range(0, len(live), 8192):
        lo, hi = np.searchsorted(col, [a, min(a + 8192, len(live))])
        x = np.zeros((n, 8192), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        both += x[:split] @ x[split:].T
    near = 100 * both >= percent * (sizes[:split, None] + sizes[None, split:] - both)
    ids, parent = left["id"] + right["id"], {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    labels, out = left["label"] + right["label"], []
    for i, j in np.argwhere(near & (both > 0)).tolist():
        a, b = top(labels[i]), top(labels[split + j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[i], ids[split + j]))
    return out


def block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the members of each key; rows: key, id, label, n (shingles)."""
    size = rows.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = rows.join(size, "key").select("key", "id", "label", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    met = (
        dealt.join(sets, "id")
        .select("key", "id", "label", "set", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "label", "set")
    )

    def run(key, t):
        block, p, q = t.column("block").to_numpy(), key[1].as_py(), key[2].as_py()

        def part(which):
            x = t.filter(pa.array(block == which))
            return {"id": x.column("id").to_pylist(), "label": x.column("label").to_pylist(), "set": [np.frombuffer(v, np.uint64) for v in x.column("set").to_pylist()]}

        left, right = part(p), part(q)
        found = forest(left, right, percent) if left["id"] and right["id"] else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return met.groupBy("key", "p", "q").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    signed = common.written(signatures(docs, width), "minhash-signatures")
    groups = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    first = signed.join(groups, (signed["set_hash"] == groups["set_hash"]) & (signed["doc_id"] == groups["rep"]), "left_semi")
    first = common.written(first.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "sketch"), "minhash-first")
    banded = first.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    members = common.written(banded.join(shared, "key").select("key", "id", "lead"), "minhash-members")
    wanted = common.written(members.select("id").distinct(), "minhash-wanted")
    meta = common.written(first.join(wanted, "id", "left_semi").select("id", "n", "sketch"), "minhash-meta")
    chosen = docs.select("doc_id", "text").join(wanted, docs["doc_id"] == wanted["id"], "left_semi")
    sets = common.written(full_sets(chosen, width), "minhash-sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        return common.written(confirmed(pairs, meta, sets, percent), "minhash-links")

    links = confirm(members.groupBy("id").agg(F.min("lead").alias("lead")).where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")))
    labels = components(links)
    star = undecided(members.select("key", "id"), labels).where("lead.label <> label").select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()
    links = links.union(confirm(star))
    labels = components(links)

    left = common.written(undecided(members.select("key", "id"), labels), "minhash-undecided")
    same = left.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("who"), F.count("*").alias("many")).select("key", F.xxhash64("who", "many").alias("bucket"))
    rows = left.join(same, "key").join(meta.select("id", "n"), "id").select(F.col("bucket").alias("key"), "id", "label", "n").distinct()
    links = links.union(common.written(block_links(rows, sets, percent), "minhash-links"))
    labels = components(links)

    # by set, then by row: a set that a third of all rows have is dealt over tasks
    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("label"))
    out = common.salted_join(signed.select("doc_id", "n_shingles", "set_hash"), named, "set_hash", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity estimated from two odd sketches."""
    z = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * z / SKETCH_BITS))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)


OP7_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
