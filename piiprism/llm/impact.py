"""Ranked lexical search, score at a time over impact-ordered postings.

A document's terms are counted once, and only terms that some item asks for are kept. The score of a term in a
document is its impact, a whole number. Documents are read in shards; a shard's postings are ordered by impact within
each term, and an item processes them over all its terms in falling order of impact, groups of equal impact whole:
each adds to its document's sum. What is left of every term is bounded by its next impact, so the sum of those bounds
what any document can still gain. Processing stops only when that proves the top k: no document without a sum can reach
the k-th best, and few with one can. The scores of those few are then completed from their documents. The k-th best of
a task's earlier shards counts from the start, and only a task's k best of each item leave it.

Items are answered in groups whose texts have at most about GROUP_BYTES, by a hash of their id; the terms of a group are sent to
the tasks. A group is one pass over the documents, whatever their number.

Nulls: a null text has no terms; a null doc_id is a document like others and comes last among equal scores; a null
item_id is an item. Rows that repeat a doc_id are documents of their own, rows that repeat an item_id are one item with
the terms of all. Ties go to the smaller doc_id. A document or item without terms finds and is found by nothing.
Columns other than the named are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GROUP_BYTES = 8 << 20
#: Postings and documents of a shard, about.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: An item goes on processing while more documents than this could still be among the best.
FEW = 256
#: Postings of a round have at least this share of the highest impact left.
ROUND = 0.75
_NULL = np.iinfo(np.int64).max

_KEPT = [c if chr(c).isalnum() or c > 127 else 32 for c in range(128)] + list(range(128, 256))
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in _KEPT)


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII; A-Z is lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()


class Asked:
    """The items of a group: their terms as numbers, with repeats."""

    def __init__(self, rows: list):
        self.items: dict[int | None, Counter] = {}
        self.number: dict[bytes, int] = {}
        for r in rows:
            own = self.items.setdefault(r["item_id"], Counter())
            own.update(self.number.setdefault(t, len(self.number)) for t in terms(r["text"]))


COUNTED = "doc_id long, n long, terms binary, counts binary"


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, number of terms, and the asked terms with their occurrences, of documents with a term."""

    def run(batches):
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = terms(text)
                if own:
                    seen = Counter(own)
                    kept = sorted((number[t], seen[t]) for t in seen.keys() & number.keys())
                    both = np.array(kept, np.int32).reshape(-1, 2)
                    rows.append((i, len(own), both[:, 0].tobytes(), both[:, 1].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.lean(run), COUNTED)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each asked term."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Shard:
    """Postings of some documents: of each term by falling impact, and of each document."""

    def __init__(self, rows: list, weight: np.ndarray, n_docs: int, n_terms: int):
        ids, lengths, held, counts = zip(*rows, strict=True)
        self.ids = np.array([_NULL if i is None else i for i in ids], np.int64)
        per_doc = np.array([len(t) // 4 for t in held])
        self.term = np.frombuffer(b"".join(held), np.int32)
        tf = np.frombuffer(b"".join(counts), np.int32).astype(np.int64)
        m = 100 - 75 + 75 * np.array(lengths, np.int64) * n_docs // n_terms
        doc = np.repeat(np.arange(len(rows)), per_doc)
        self.impact = weight[self.term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        self.start = np.concatenate([[0], np.cumsum(per_doc)])
        order = np.lexsort((-self.impact, self.term))
        self.by_doc, self.by_impact = doc[order], self.impact[order]
        self.list_start = np.searchsorted(self.term[order], np.arange(len(weight) + 1))

    def complete(self, docs: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """The whole scores of some documents; repeats: of each term in the item."""
        sizes = self.start[docs + 1] - self.start[docs]
        at = np.repeat(self.start[docs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        sums = np.concatenate([[0], np.cumsum(repeats[self.term[at]] * self.impact[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def search(self, item: list[tuple[int, int]], repeats: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all documents that can be among the k best with a score of bar at least."""
        sums = np.zeros(len(self.ids), np.int64)
        lists = []  # [repeats, next posting, end, bound]
        for t, times in item:
            a, b = self.list_start[t], self.list_start[t + 1]
            if a < b and self.by_impact[a]:
                lists.append([times, a, b, times * int(self.by_impact[a])])
        while lists:
            low = max(x[3] for x in lists) * ROUND
            for x in lists:
                times, a, b, bound = x
                if bound >= low:
                    end = b - int(np.searchsorted(self.by_impact[a:b][::-1], low / times, "left"))
                    sums[self.by_doc[a:end]] += times * self.by_impact[a:end]
                    x[1], x[3] = end, times * int(self.by_impact[end]) if end < b else 0
            lists = [x for x in lists if x[3]]
            left = sum(x[3] for x in lists)
            best = sums[sums > 0]
            reached = max(bar, int(np.partition(best, -k)[-k]) if len(best) >= k else 0)
            if left < reached and (not lists or np.count_nonzero(best + left >= reached) <= max(FEW, 2 * k)):
                may = np.flatnonzero((sums > 0) & (sums + left >= reached))
                return self.complete(may, repeats), self.ids[may]
        may = np.flatnonzero(sums)
        return sums[may], self.ids[may]


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def searched(rows: DataFrame, asked: Asked, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best of each item in each task."""
    items = [(i, sorted(own.items())) for i, own in asked.items.items()]

    def run(batches):
        none = np.empty(0, np.int64)
        best = [(none, none) for _ in items]
        held, postings = [], 0

        def look():
            shard = Shard(held, weight, n_docs, n_terms)
            for at, (_, own) in enumerate(items):
                score, ids = best[at]
                repeats = np.zeros(len(weight), np.int64)
                for t, times in own:
                    repeats[t] = times
                more, found = shard.search(own, repeats, k, int(score[-1]) if len(score) == k else 0)
                best[at] = best_of(np.concatenate([score, more]), np.concatenate([ids, found]), k)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")), strict=True):
                held.append(row)
                postings += len(row[2]) // 4
                if postings >= SHARD_POSTINGS or len(held) >= SHARD_DOCS:
                    look()
                    held, postings = [], 0
        if held:
            look()
        out = [(i, None if d == _NULL else d, s) for (i, _), (score, ids) in zip(items, best, strict=True) for s, d in zip(score.tolist(), ids.tolist(), strict=True) if s > 0]
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(common.lean(run), "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, found = max(1, -(-size // GROUP_BYTES)), []
    for g in range(groups):
        asked = Asked(items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect())
        rows = common.written(counted(docs, asked.number), "search-counted")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in document_counts(rows, len(asked.number)).tolist()], np.int64)
        found.append(common.written(searched(rows, asked, weight, n_docs, n_terms or 1, k), "search-found"))
        common.discard(rows)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH terms AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') FROM benchmark),
held AS (SELECT kind, id, t, len(t) AS n FROM terms WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM held WHERE kind = 0),
each AS (SELECT kind, id, n, unnest(t) AS term FROM held),
tf AS (SELECT kind, id, n, term, count(*) AS tf FROM each GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf WHERE kind = 0 GROUP BY term), total),
s AS (SELECT q.id AS item_id, d.id AS doc_id, CAST(sum(q.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (100 - 75 + ((75 * d.n * docs) // words))))) AS BIGINT) AS score
  FROM tf q JOIN tf d ON q.kind = 1 AND d.kind = 0 AND q.term = d.term JOIN w ON w.term = q.term, total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM r WHERE n <= 10
"""
