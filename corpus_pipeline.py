"""A training corpus from raw documents: STAGES in order, each written and read again.

toxicity     documents that the classifier rejects go
near_dedup   one document of each group of near copies stays (the one with the least doc_id)
pii          personal data in the texts is replaced by its kind in brackets
mix          sources are mixed to their target weights: a document stands in the result once for each pass over
             its source that takes words of it, with those words
tokens       the mix is encoded: ids of every document, as unsigned 16-bit integers

All but the last return the columns of documents. Where a stage leaves rows with the same doc_id (passes of the mix),
they are rows of their own afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piiprism.llm import common, minhash, mixing, pii, toxicity, viterbi


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, *model) if model else docs


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship_code(spark)
    gone = minhash.near_duplicates(docs, width=3, percent=85).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship_code(spark)
    return pii.redacted(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship_code(spark)
    return mixing.mixed(docs)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship_code(spark)
    ids = viterbi.encoded(docs, keep=("source",))
    return ids.select("doc_id", "source", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", one_of_each), ("pii", redact), ("mix", mix_sources), ("tokens", tokens)]

#: Trained models and pseudorandom draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
