"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two sets of sizes n <= m have a similarity of percent / 100 exactly if they share c(n, m) = ceil(percent (n + m) /
(100 + percent)) shingles. Sets up to a boundary are light, the others heavy; a pair of light sets is found by subsets,
every other pair by inverted lists.

Light: a set of m shingles enumerates its subsets of each size c(n, m) that a pair of it can need. Two sets that share a
subset of c shingles share c shingles, so a bucket of one subset is joined to its smallest set: c(., .) grows with both
sizes, so the smallest set is linked with every member that any other member could be linked with by this bucket.

Heavy: postings are not single shingles, whose lists would be as long as a common passage is common, but parts. The
shingles are dealt to parts by a hash, one part more than linked sets can differ in shingles; so linked sets agree on
all shingles of a part at least, and meet in that part's list. The number of parts is that of a class of sizes (a set
near a class's end is posted in the next one too). A part without shingles is posted only by a set that has too few
others for the argument. A list is scanned in rounds: all members against the smallest; then, in lists whose members
are not yet in one component, all members against each other, in blocks of BLOCK_ROWS, by parity bitmaps. Of each member
only the likeliest partner in another component goes on, round after round while that finds links; then every partner
in another component that may be a link. Lists with the same members are scanned once.

The boundary is the one of least cost, in values that are moved: the subsets of light sets, against parts and
shingles of the sets whose pairs lists must find; it is taken from the counts of all sizes up to LIGHT_MOST.

Every candidate is confirmed on full sets, after parity bitmaps that can drop only pairs that differ too much (each
shingle flips one bit, so two bitmaps differ in no more bits than the sets in shingles). Equal sets are joined
first by a hash of the whole set and take part once. So no link is lost and none is wrong, but for equal 64-bit hashes
of different shingles or 128-bit hashes of different sets.

Nulls and empty texts have an empty set and link with nothing. A null doc_id links with nothing, with a null
component. Rows that repeat a doc_id are one document with the links of each of its rows. Ties do not arise: a
component is named by its least doc_id. Columns other than doc_id and text are ignored. doc_id is a whole number of at
most 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .minhash import components, full_sets, undecided
from .shingles import mixed, shingles, words

#: No set beyond this is light: its subsets would cost more than any list.
LIGHT_MOST = 64
PARITY_BITS = 1024
#: Pairs of one set whose join with full sets is dealt over salts.
MANY = 512
#: Members of a list that meet in one task, from each of two blocks, and pairs whose bitmaps are compared at once.
BLOCK_ROWS, PAIRS = 1024, 1 << 17
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def overlap(n: int, m: int, percent: int) -> int:
    """Shingles that sets of n and m must share."""
    return -(-percent * (n + m) // (100 + percent))


def most_apart(both: int, percent: int) -> int:
    """Shingles that only one of two linked sets has, at most; both: the sum of their sizes, or more."""
    return both * (100 - percent) // (100 + percent)


def salt(i: int) -> np.uint64:
    return np.uint64(i * int(_B) % (1 << 64))


def subset_sizes(m: int, most: int, percent: int) -> list[int]:
    """The sizes of the subsets that a light set of m enumerates, where light sets have `most` shingles at most."""
    partners = range(-(-percent * m // 100), min(most, 100 * m // percent) + 1)
    return sorted({c for n in partners if (c := overlap(n, m, percent)) <= m})


def classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(lowest size, parts) of the classes that a set of n is posted in: its own, and those of larger sets it may link with."""
    low, out = 1, []
    while low <= 100 * n // percent:
        high = max(low + 1, low * 3 // 2) - 1
        if high >= n:
            out.append((low, high))
        low = high + 1
    return [(a, most_apart(2 * b, percent) + 1) for a, b in out]


def part_keys(hashes: np.ndarray, percent: int, known: dict) -> np.ndarray:
    """The keys of the lists that a set is posted in."""
    n = len(hashes)
    if n not in known:
        known[n] = classes(n, percent), most_apart(n + 100 * n // percent, percent)
    into, apart = known[n]
    spread, value, out = mixed(hashes + _A) >> np.uint64(32), mixed(hashes * _A + _B), []
    for low, parts in into:
        at = ((spread * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(value[order], first)
        if len(own) <= apart and len(own) < parts:
            empty = np.setdiff1d(np.arange(parts), own)
            own, sums = np.concatenate([own, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        out.append(mixed(mixed(sums + own.astype(np.uint64) * _A) + salt(low)))
    return np.concatenate(out)


def subset_keys(hashes: np.ndarray, most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and sizes of a light set's subsets: sums of the shingles' values, less those left out."""
    value, m = mixed(hashes * _A + _B), len(hashes)
    whole, keys, sizes = value.sum(), [], []
    for c in subset_sizes(m, most, percent):
        left_out = np.array(list(combinations(range(m), m - c)), np.int64).reshape(comb(m, c), m - c)
        keys.append(mixed(mixed(whole - value[left_out].sum(axis=1, dtype=np.uint64)) + salt(c) + np.uint64(1)))
        sizes.append(np.full(len(left_out), c))
    return np.concatenate(keys), np.concatenate(sizes)


def parity(hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(40)).astype(np.int64) % PARITY_BITS
    return np.packbits((np.bincount(at, minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64)


SIGNED = "doc_id long, n int, set_hash binary, light binary, parity array<long>, parts array<long>"


def signed_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document: size and hash of its set, the set itself where it may be light, its bitmap and parts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set_hash", pa.binary()), ("light", pa.binary()), ("parity", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64()))])

    def run(batches):
        known, sizes = words(), {}
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                h = shingles(t, width, known)
                rows.append((len(h), xxhash.xxh3_128_digest(h), h.tobytes() if len(h) <= LIGHT_MOST else None, parity(h), part_keys(h, percent, sizes).view(np.int64)) if len(h) else (0, None, None, None, None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), SIGNED)


def boundary(counts: dict[int, int], percent: int) -> int:
    """The largest light size, of least cost. counts: sets of each size up to LIGHT_MOST."""

    def listed(most: int) -> int:  # sets that pairs with a heavy set can hold
        return sum(k * (n + sum(p for _, p in classes(n, percent))) for n, k in counts.items() if 100 * n >= percent * (most + 1))

    def enumerated(most: int) -> int:
        return sum(k * sum(comb(n, c) for c in subset_sizes(n, most, percent)) for n, k in counts.items() if n <= most)

    return min(range(LIGHT_MOST), key=lambda most: (enumerated(most) + listed(most), -most))


def enumerated(light: DataFrame, most: int, percent: int) -> DataFrame:
    """key, id, n, c of the subsets of light sets."""

    def run(batches):
        for b in batches:
            for i, n, x in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("light").to_pylist(), strict=True):
                keys, sizes = subset_keys(np.frombuffer(x, np.uint64), most, percent)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([i] * len(keys), pa.int64()), pa.array([n] * len(keys), pa.int32()), pa.array(sizes, pa.int32())], ["key", "id", "n", "c"])

    return light.select("id", "n", "light").mapInArrow(run, "key long, id long, n int, c int")


def confirmed(pairs: DataFrame, meta: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: sizes and bitmaps, then full sets."""
    side = lambda s: meta.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}"))
    apart = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = (
        common.salted_join(pairs, side("a"), "a", "b")  # a list's smallest set is in as many pairs as the list has members
        .join(side("b"), "b")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
        .select("a", "b")
        .distinct()
    )
    likely = common.written(likely, "join-likely")
    # full sets of a in many pairs are repeated for each salt, others are sent once
    many = likely.groupBy("a").agg(F.count("*").alias("many")).where(f"many > {MANY}").drop("many").withColumn("hot", F.lit(True))
    dealt = common.salted_join(likely, many, "a", "b", "left").select("a", "b", F.when(F.col("hot"), F.pmod(F.xxhash64("b"), F.lit(common.SALTS)).cast("int")).otherwise(0).alias("salt"))
    of = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"set_{s}"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(common.SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = of("a").join(likely.select("a").distinct(), "a", "left_semi").join(many, "a", "left").select("a", "set_a", F.explode(salts).alias("salt"))
    both = dealt.join(left, ["a", "salt"]).join(of("b"), "b")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(shared >= overlap(len(p), len(q), percent))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(common.lean(check), "a long, b long")


def candidates(first: DataFrame, most: int, percent: int) -> DataFrame:
    """key, id, n: the buckets and lists that hold two sets at least, without sets that a bucket says nothing of; written."""
    light = common.written(enumerated(first.where(F.col("n") <= most), most, percent), "join-subsets")
    lists = first.where(F.col("n") * 100 >= percent * (most + 1)).select(F.explode("parts").alias("key"), "id", "n", F.lit(0).alias("c"))
    keyed = lists.unionByName(light)
    shared = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    met = common.written(keyed.join(shared, "key"), "join-met")
    least = met.where("c > 0").groupBy("key").agg(F.min("n").alias("least"))
    by_subset = met.where("c > 0").join(least, "key").where(f"{percent} * (n + least) <= {100 + percent} * c")
    members = common.written(met.where("c = 0").select("key", "id", "n").union(by_subset.select("key", "id", "n")), "join-members")
    common.discard(light, met)
    return members


def near_pairs(t: pa.Table, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids within each cell (key, p, q) that may be links of different components, all or the likeliest of each
    member; t: sorted by cell."""
    key, p, q, block, ids, label, n = (t.column(c).to_numpy() for c in ("key", "p", "q", "block", "id", "label", "n"))
    bits = t.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    cut = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
    start = np.concatenate([[0], cut])
    partners = np.repeat(np.concatenate([cut, [len(ids)]]), np.diff(np.concatenate([start, [len(ids)]]))) - np.arange(len(ids)) - 1
    total, a, b = np.concatenate([[0], np.cumsum(partners)]), [], []
    likeliest, least = np.full(len(ids), -1), np.full(len(ids), np.iinfo(np.int64).max)
    lo = 0
    while lo < len(ids):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), partners[lo:hi])
        j = np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], partners[lo:hi]) + i + 1
        open_ = (label[i] != label[j]) & ((p[i] == q[i]) | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[open_], j[open_]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * apart <= (100 - percent) * (n[i] + n[j]).astype(np.int64)
        i, j, apart = i[near], j[near], apart[near]
        if every:
            a.append(ids[i])
            b.append(ids[j])
        elif len(i):
            one, other, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([apart, apart])
            order = np.lexsort((far, one))
            first = order[np.append(True, np.diff(one[order]) != 0)]
            first = first[far[first] < least[one[first]]]
            least[one[first]], likeliest[one[first]] = far[first], other[first]
        lo = hi
    if every:
        return np.concatenate(a), np.concatenate(b)
    some = np.flatnonzero(likeliest >= 0)
    return ids[some], ids[likeliest[some]]


def scanned(open_: DataFrame, meta: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs (a, b) of members of undecided lists that may be links; open_: key, id, label."""
    same = open_.groupBy("key").agg(F.bit_xor(F.xxhash64("id")).alias("who"), F.count("*").alias("many")).select("key", F.xxhash64("who", "many").alias("list"))
    rows = open_.join(same, "key").select(F.col("list").alias("key"), "id", "label").distinct()
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    cells = (
        rows.join(size, "key")
        .join(meta, "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "label", "n", "parity")
    )

    def run(batches):
        held = None  # rows of a cell that may go on in the next batch
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            at = [t.column(c).to_numpy() for c in ("key", "p", "q")]
            last = np.flatnonzero(np.any([x != x[-1] for x in at], axis=0)) if len(t) else np.empty(0, int)
            cut = int(last[-1]) + 1 if len(last) else 0
            held = t.slice(cut)
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in near_pairs(t.slice(0, cut), percent, every)], ["a", "b"])
        if held is not None and len(held):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in near_pairs(held, percent, every)], ["a", "b"])

    found = cells.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(common.lean(run), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    full = common.written(signed_sets(docs, width, percent), "join-signed")
    signed = common.written(full.select("doc_id", "n", "set_hash"), "join-hashes")
    groups = signed.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    first = full.join(groups.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").where("n > 0")
    first = common.written(first.withColumnRenamed("doc_id", "id"), "join-first")
    common.discard(full)  # parts and bitmaps are the most of what is written: they stay no longer than they are read
    counts = {r["n"]: r["count"] for r in first.where(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}
    members = candidates(first, boundary(counts, percent), percent)
    wanted = common.written(members.select("id").distinct(), "join-wanted")
    meta = common.written(first.join(wanted, "id", "left_semi").select("id", "n", "parity"), "join-meta")
    common.discard(first)
    sets = common.written(full_sets(docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi"), width), "join-sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        return common.written(confirmed(pairs.where("a <> b"), meta, sets, percent), "join-links")

    smallest = members.groupBy("key").agg(F.min(F.struct("n", "id")).alias("lead"))
    star = common.salted_join(members.select("key", "id"), smallest, "key", "id")
    links = confirm(star.groupBy("id").agg(F.min("lead.id").alias("a")).select("a", F.col("id").alias("b")))
    labels = components(links)
    every = False
    while True:
        open_ = common.written(undecided(members.select("key", "id"), labels).select("key", "id", "label"), "join-open")
        found = confirm(scanned(open_, meta, percent, every))
        common.discard(open_)
        more = found.limit(1).count()
        if more:
            links = links.union(found)
            labels = components(links)
        if every:
            break
        every = not more  # components at least halve while their likeliest partners are links

    named = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("label"))
    out = common.salted_join(signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_hash"), named, "set_hash", "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("component_id"))


def op11(spark, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"), width=3, percent=90)


OP11_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id
FROM s JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) ON a = doc_id
"""
