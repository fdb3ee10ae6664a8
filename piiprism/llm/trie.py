"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns (role, text) are encoded by a dictionary of distinct turns: a conversation is a sequence of numbers. Equal
sequences are one row with a weight. Buckets, a bucket being the rows that begin alike, are partitioned by their next
number; those of more than LOCAL rows are partitioned again, level by level, the others go to a task each, where
multikey quicksort finishes them: a three-way partition by the number at a depth, whose middle part is a node's
members, so that nodes are emitted while the recursion goes down, and summed when it comes back. The nodes of large
buckets get their sums from their children, from the deepest level up.

A bucket or turn that a third of all rows share is no single task's work: large buckets are counted with partial
sums and found by a broadcast table of at most LARGE rows a level, frequent turns are looked up the same way, and the
ids of equal conversations are hashed in blocks, in a stream. A conversation's own turns are ordered by one task, and its
numbers (16 bytes a turn) must fit in one. A level of large buckets takes a pass over their rows, so a prefix that
thousands of distinct conversations share takes as many passes as it has turns.

A null role or text is empty. Rows with a null conv_id take no part. Ties of turn are ordered by role and text, and
repeated rows are turns of their own. Columns other than the four are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a bucket that a task finishes, at least; with many rows more, so that a level has no more than LARGE large ones.
LOCAL, LARGE = 4096, 5000
#: Conversation ids whose decimal forms are one row of a stream.
BLOCK_IDS = 4096


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, common.WORD.replace("[^", "[")), lambda w: w != "")).cast("long")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (of role and text) and words of every turn."""
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", F.row_number().over(w).alias("pos"), key.alias("key"), words(F.col("text")).alias("words"))


def encoded(rows: DataFrame) -> DataFrame:
    """conv_id, pos, id, words: keys as numbers of a dictionary."""
    dictionary = common.written(rows.groupBy("key").agg(F.count("*").alias("many")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    often = max(1000, rows.count() // LARGE)  # so at most LARGE keys are frequent
    frequent = dictionary.where(F.col("many") >= often).select("key", "id")
    tried = rows.join(F.broadcast(frequent), "key", "left")
    rest = tried.where("id IS NULL").drop("id").join(dictionary.where(F.col("many") < often).select("key", "id"), "key")
    names = ["conv_id", "pos", "id", "words"]
    return tried.where("id IS NOT NULL").select(*names).union(rest.select(*names))


def rebuilt(rows: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, ids, words: the first h turns of conversation c - c % every, then c's own after its first h."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))), lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    own = common.written(rows.groupBy("conv_id").agg(turns.alias("turns")), "trie-own")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    donors = own.where(f"conv_id % {every} = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, heads - 1).alias("first"))
    taken = own.withColumn("h", h).withColumn("donor", F.expr(f"conv_id - conv_id % {every}")).join(donors, "donor", "left")
    both = F.concat(F.expr("slice(coalesce(first, slice(turns, 1, 0)), 1, h)"), F.expr("slice(turns, h + 1, size(turns))"))
    return taken.select("conv_id", both.alias("turns")).select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))


def ends(convs: DataFrame) -> DataFrame:
    """seq, ends_sha256: of the ids of the conversations with each sequence, in a stream of blocks."""
    blocks = convs.groupBy("seq", F.floor(F.col("conv_id") / BLOCK_IDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("part"))

    def run(batches):
        seq, digest = None, None
        for b in batches:
            out = []
            for s, part in zip(b.column("seq").to_pylist(), b.column("part").to_pylist(), strict=True):
                if s == seq:
                    digest.update(b",")
                else:
                    if digest:
                        out.append((seq, digest.hexdigest()))
                    seq, digest = s, hashlib.sha256()
                digest.update(part.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], ["seq", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([digest.hexdigest()])], ["seq", "ends_sha256"])

    return blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "part").mapInArrow(run, "seq string, ends_sha256 string")


NOBODY = hashlib.sha256().hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def quicksorted(rows: list[tuple], top: int, parent: int | None) -> list[list]:
    """The nodes of a bucket from depth top on, the columns of NODE. rows: conv_id, weight, ids, words, ends_sha256."""
    nodes, above = [], []
    todo = [(True, rows, top, -1)]  # node?, members, depth, place of the node above
    while todo:
        is_node, part, depth, up = todo.pop()
        if is_node:
            ended = [r for r in part if len(r[2]) == depth]
            n = sum(r[1] for r in part)
            saved = (n - 1) * part[0][3][depth - 1] if depth else 0
            nodes.append([min(r[0] for r in part), depth, nodes[up][0] if up >= 0 else parent, n, 0, 0, saved, ended[0][4] if ended else NOBODY, up < 0])
            above.append(up)
            up, part = len(nodes) - 1, [r for r in part if len(r[2]) > depth]
        if part:
            pivot = part[len(part) // 2][2][depth]
            less, more = [r for r in part if r[2][depth] < pivot], [r for r in part if r[2][depth] > pivot]
            todo += [(False, x, depth, up) for x in (less, more) if x]
            todo.append((True, [r for r in part if r[2][depth] == pivot], depth + 1, up))
    for node, up in zip(reversed(nodes), reversed(above), strict=True):
        node[5] = node[5] or 1  # nothing below it
        if up >= 0:
            nodes[up][4] += 1
            nodes[up][5] += node[5]
            nodes[up][6] += node[6]
    return nodes


def finished(local: DataFrame) -> DataFrame:
    """NODE of all local buckets: (parent, depth, next) names one."""
    names = [c.split()[0] for c in NODE.split(", ")]
    schema = pa.schema([(n, pa.string() if n == "ends_sha256" else pa.bool_() if n == "top" else pa.int64()) for n in names])

    def run(batches):
        at, held = None, []

        def emitted():
            cols = zip(*quicksorted(held, at[1], at[0]), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for parent, depth, nxt, *row in zip(*(b.column(c).to_pylist() for c in ("parent", "depth", "next", "conv_id", "n", "ids", "words", "ends_sha256")), strict=True):
                if (parent, depth, nxt) != at:
                    if held:
                        yield emitted()
                    at, held = (parent, depth, nxt), []
                held.append(tuple(row))
        if held:
            yield emitted()

    return local.repartition("parent", "depth", "next").sortWithinPartitions("parent", "depth", "next").mapInArrow(common.lean(run), NODE)


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each node of the rebuilt conversations' prefix trie."""
    rows = common.written(ordered(conversations), "trie-turns")
    convs = rebuilt(encoded(rows)).withColumn("seq", F.sha2(F.array_join("ids", ",").cast("binary"), 256))
    convs = common.written(convs, "trie-convs")
    alike = convs.groupBy("seq").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    alike = alike.join(ends(convs), "seq").join(convs.select("conv_id", "ids", "words"), "conv_id").select("conv_id", "n", "ids", "words", "ends_sha256")
    alike = common.written(alike, "trie-alike")
    total, n_convs, least = alike.agg(F.count("*"), F.sum("n"), F.min("conv_id")).first()
    local = max(local, total // LARGE)

    place = {"parent": F.lit(None).cast("long"), "depth": F.lit(0), "next": F.lit(0).cast("long")}
    if total <= local:
        return finished(alike.withColumns(place)).drop("top")
    bucket = alike.withColumn("node", F.lit(least))
    spark = conversations.sparkSession
    large = [spark.createDataFrame([(least, None, n_convs, 0)], "node long, parent long, n_convs long, words long")]
    dealt, ended = [], []
    while True:
        d = len(dealt)
        ended.append(bucket.where(F.size("ids") == d).select("node", "ends_sha256"))
        going = bucket.where(F.size("ids") > d).withColumn("next", F.col("ids")[d])
        sizes = going.groupBy("node", "next").agg(F.count("*").alias("many"), F.min("conv_id").alias("child"), F.sum("n").alias("n_convs"), F.max(F.col("words")[d]).alias("last"))
        big = common.written(sizes.where(F.col("many") > local), "trie-large")
        split = common.written(going.join(F.broadcast(big.select("node", "next", "child")), ["node", "next"], "left"), "trie-dealt")
        here = split.where("child IS NULL").select(F.col("node").alias("parent"), F.lit(d + 1).alias("depth"), "next", "conv_id", "n", "ids", "words", "ends_sha256")
        dealt.append(here)
        if not big.limit(1).count():
            break
        large.append(big.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n_convs", F.col("last").alias("words")))
        bucket = split.where("child IS NOT NULL").drop("node", "next").withColumnRenamed("child", "node")
    nodes = dealt[0]
    for x in dealt[1:]:
        nodes = nodes.union(x)
    nodes = common.written(finished(nodes), "trie-nodes")

    out, below = nodes, None
    names = [c for c in nodes.columns if c != "top"]
    for d in reversed(range(len(large))):
        kids = nodes.where(f"top AND depth = {d + 1}").select("parent_conv_id", "n_leaves", "saved_tokens")
        if below is not None:
            kids = kids.union(below.select("parent_conv_id", "n_leaves", "saved_tokens"))
        sums = kids.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        below = common.written(
            large[d].join(sums, "node").join(ended[d], "node", "left").select(
                F.col("node").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOBODY)).alias("ends_sha256"),
            ),
            "trie-above",
        )
        out = out.select(*names).union(below.select(*names))
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(s) + 1), lambda i: [ascii(s[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t)),
r AS (SELECT h.conv_id, 0 AS part, d.pos, d.role, d.text FROM h JOIN t d ON d.conv_id = h.conv_id - h.conv_id % 20 AND d.pos <= h.h
  UNION ALL SELECT t.conv_id, 1, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id WHERE t.pos > h.h),
s AS (SELECT conv_id, row_number() OVER w AS d, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS prefix,
    len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
p AS (SELECT * FROM s UNION ALL SELECT conv_id, 0, '', 0 FROM h),
last AS (SELECT conv_id, arg_max(prefix, d) AS prefix FROM p GROUP BY conv_id),
e AS (SELECT prefix, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY prefix),
n AS (SELECT d AS depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY d, prefix),
k AS (SELECT left(prefix, 64 * (depth - 1)) AS prefix, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.prefix = n.prefix),
u AS (SELECT left(prefix, 64 * a) AS prefix, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM m JOIN u ON u.prefix = m.prefix LEFT JOIN e ON e.prefix = m.prefix LEFT JOIN n up ON m.depth > 0 AND up.prefix = left(m.prefix, 64 * (m.depth - 1))
"""
