"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; an even draw of all texts is unlabelled, toxic ones among them. A linear
classifier over hashed words is trained in numpy on the non-negative PU risk
    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))
with the sigmoid loss: the expected loss of unlabelled texts as negatives is corrected by the share of toxic texts
among them (the class prior), and where the correction falls below zero the step is taken against it, which keeps
the estimator from fitting the positives exactly. The prior is the toxic share of the labelled training rows; the
draw leaves the confirmed texts among the unlabelled ones, so it is the prior of these too.

Training reads a bounded sample (about MAX_POSITIVE and MAX_UNLABELLED texts, chosen by a hash of doc_id); every text is
scored, whole. Features are of the text alone: which words it has, and which beginnings of words (PREFIXES), after
folding case and dropping punctuation at the ends. A feature counts once however often it occurs. Of near copies in
the sample one is used, so that a much copied text's words don't look toxic, and only features that are clearly more
frequent among the positives (SURE deviations) are weighed.

Nulls and empty texts have no words and get the score of the bias. A null doc_id or label gives no training example;
rows with null doc_ids are scored, with a null held_out. Repeated rows are scored each. Without any positive example the
score is 0 everywhere. Columns other than doc_id and text are ignored. An empty table gives an empty result. doc_id may
be of any type that labels.doc_id can be compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
PREFIXES = (4, 5)
SURE = 7.0
#: Characters that are not part of a word at its ends (fixed values).
EDGES = "\"'`.,;:!?()[]{}<>«»„“”‘’…-–—*_/\\|"


def word_features(word: str) -> list[int]:
    w = word.strip(EDGES).lower().encode("utf-32-le", "surrogatepass")
    return [xxhash.xxh32_intdigest(w, seed=1)] + [xxhash.xxh32_intdigest(w[: 4 * k], seed=2) for k in PREFIXES if len(w) > 4 * k] if w else []


def features(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    return np.unique(np.array([f for w in set((text or "").split()) for f in word_features(w)], np.uint32))


def _firsts(flat: np.ndarray, rare: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows are the first of their near copies: those that share the least of their rare features in one of
    three orders are copies. flat: the rows' features one after the other, from starts on."""
    marks, none = [], np.uint64(0xFFFFFFFFFFFFFFFF)
    full = np.flatnonzero(np.diff(np.append(starts, len(flat))))
    for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93):
        least = np.full(len(starts), none)
        if len(full):
            least[full] = np.minimum.reduceat(np.where(rare, flat.astype(np.uint64) * np.uint64(m), none), starts[full])
        marks.append(least)
    seen, keep = set(), np.zeros(len(starts), bool)
    for i, own in enumerate(zip(*(m.tolist() for m in marks), strict=True)):
        own = {(k, v) for k, v in enumerate(own) if v != int(none)}
        keep[i] = not own & seen
        seen |= own
    return keep


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, batch: int = 512, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> tuple[dict[int, float], float]:
    """(weights by feature, bias) by Adam on the non-negative PU risk, from the features of the examples."""
    size = np.array([len(r) for r in positive + unlabelled])
    flat = np.concatenate([*positive, *unlabelled]).astype(np.uint32)
    starts = np.cumsum(size) - size
    used, col = np.unique(flat, return_inverse=True)
    col = col.astype(np.int32)
    cut = starts[len(positive)] if unlabelled else len(flat)
    keep = []
    for part, begins in ((slice(0, cut), starts[: len(positive)]), (slice(cut, None), starts[len(positive) :] - cut)):
        often = np.bincount(col[part], minlength=len(used))
        keep.append(_firsts(flat[part], often[col[part]] <= max(2, len(begins) // 50), begins))
    del flat
    n_p, n_u = int(keep[0].sum()), int(keep[1].sum())
    keep = np.concatenate(keep)
    row = np.repeat(np.where(keep, np.cumsum(keep) - 1, -1), size)  # of the rows that stay
    col, row = col[row >= 0], row[row >= 0]
    a = np.bincount(col[row < n_p], minlength=len(used)) / n_p
    b = np.bincount(col[row >= n_p], minlength=len(used)) / n_u
    both = (a * n_p + b * n_u) / (n_p + n_u)
    z = (a - b) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    # a feature of toxic texts alone is among the unlabelled as often as the prior says
    live = np.flatnonzero((a * n_p >= 3) & (b <= 2.5 * prior * a + 1 / n_u) & (z >= SURE))
    place = np.full(len(used), -1)
    place[live] = np.arange(len(live))
    x = np.zeros((n_p + n_u, len(live)), np.float32)  # a bounded sample by a few hundred features
    on = place[col] >= 0
    x[row[on], place[col[on]]] = 1
    rng = np.random.default_rng(seed)
    theta = np.zeros(len(live) + 1)  # the last is the bias
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def side(take):
        y = 1 / (1 + np.exp(-np.clip(x[take] @ theta[:-1] + theta[-1], -30, 30)))
        g = y * (1 - y) / len(take)  # of the sigmoid loss: as positive 1 - y, as negative y
        return y.mean(), np.append(g @ x[take], g.sum())

    for t in range(1, steps + 1):
        y_p, g_p = side(rng.integers(0, n_p, batch))
        y_u, g_u = side(rng.integers(n_p, n_p + n_u, batch))
        g = g_u - 2 * prior * g_p if y_u >= prior * y_p else prior * g_p - g_u
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return dict(zip(used[live].tolist(), theta[:-1].tolist(), strict=True)), float(theta[-1])


def _judge(weights: dict[int, float], bias: float):
    """A function from a text to the logit of its score, for one task."""
    known = common.Remembered(lambda word: tuple(f for f in word_features(word) if f in weights))

    def logit(text: str | None) -> float:
        live = {f for found in filter(None, map(known.__getitem__, set((text or "").split()))) for f in found}
        return bias + sum(weights[f] for f in sorted(live))

    return logit


def scored(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """doc_id, score."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # some hundred features, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = _judge(*model.value)
        for b in batches:
            z = np.array([logit(t) for t in b.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, weights: dict[int, float], bias: float) -> DataFrame:
    """The rows of docs, whole, with a score below 0.5."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = _judge(*model.value)
        for b in batches:
            yield b.filter(pa.array([logit(t) < 0 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(common.lean(run), docs.schema)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _read(examples: DataFrame, most: int) -> list[np.ndarray]:
    """The features of at most so many texts, the first by a hash, on the driver. examples hold few more than that, so
    what the tasks send is bounded."""

    def run(batches):
        for b in batches:
            found = [features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("o"), pa.array(found, pa.binary())], ["o", "words"])

    rows = examples.mapInArrow(common.lean(run), "o long, words binary").orderBy("o", "words").limit(most).collect()
    return [np.frombuffer(r["words"], np.uint32) for r in rows]


def _share(order, wanted: int, rows: int):
    """A condition that an even draw of somewhat more than the wanted number of rows meets."""
    return F.pmod(order, F.lit(1 << 30)) < int(min(1.0, (1.2 * wanted + 50) / max(1, rows)) * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float] | None:
    """The classifier from the labels of rows that are not held out; None without a positive example."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    if not counts["p"]:
        return None
    order = F.xxhash64("doc_id")
    # the ids of a bounded draw of the positives, and an even draw of all texts
    chosen = known.where("toxic = 1").where(_share(order, MAX_POSITIVE, counts["p"])).select("doc_id").orderBy(order).limit(MAX_POSITIVE)
    texts = docs.select("doc_id", "text", order.alias("o"))
    positive = _read(texts.join(F.broadcast(chosen), "doc_id").select("o", "text"), MAX_POSITIVE)
    unlabelled = _read(texts.where(_share(F.col("o"), MAX_UNLABELLED, docs.count())).select("o", "text"), MAX_UNLABELLED)
    if not positive or not unlabelled:
        return None
    return train(positive, unlabelled, counts["p"] / counts["n"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = fit(docs, labels)
    out = scored(docs, *model) if model else docs.select("doc_id", F.lit(0.0).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
