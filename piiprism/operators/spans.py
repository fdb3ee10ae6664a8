"""Spans of a document: exact merge, whitelist, redaction, edges. Arrays stay in the document's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocabulary import ENTITIES
from .recognize import SPAN

#: Spans that are folded at once.
CHUNK = 256
_PRIORITY = F.create_map  # built lazily: Columns need a session


def priority(entity: Column) -> Column:
    m = _PRIORITY(*(F.lit(x) for e, (_, p) in ENTITIES.items() for x in (e, p)))
    return F.coalesce(F.try_element_at(m, entity), F.lit(0))


def label(entity: Column) -> Column:
    m = F.create_map(*(F.lit(x) for e, (name, _) in ENTITIES.items() for x in (e, name)))
    return F.coalesce(F.try_element_at(m, entity), F.initcap(F.replace(entity, F.lit("_"), F.lit(" "))))


def whitelist(spans: Column, entities: list[str]) -> Column:
    """Applied before the merge, so an entity that would lose a merge survives."""
    return F.filter(spans, lambda s: s["entity"].isin(*entities))


def merge(spans: Column) -> Column:
    """Overlapping spans become one: extents unite, the label goes to the higher (priority, score so far), the score
    is the highest. Spans that only touch stay apart. A fold over spans ordered by (start, -end), then given order."""
    order = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), i.alias("i"), s["end"].alias("end"), s["entity"].alias("entity"), s["score"].alias("score"), s["source"].alias("source"))))

    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), s["score"].alias("score"), s["source"].alias("source"))

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        wins = (priority(s["entity"]) > priority(last["entity"])) | ((priority(s["entity"]) == priority(last["entity"])) & (s["score"] > last["score"]))
        both = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(wins, s["entity"]).otherwise(last["entity"]).alias("entity"),
            F.greatest(last["score"], s["score"]).alias("score"), F.when(wins, s["source"]).otherwise(last["source"]).alias("source"),
        )
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(plain(s))))

    def folded(part: Column, open_: Column) -> Column:
        return F.aggregate(part, open_, step)

    def chunk(own: Column, state: Column, at: Column) -> Column:
        # a fold copies what it has made at every step: only CHUNK spans are folded at once, and all but the last stay
        part = F.transform(F.array(folded(F.slice(own, at * CHUNK + 1, F.lit(CHUNK)), state["open"])), lambda r: F.struct(
            F.slice(r, F.greatest(F.size(r), F.lit(1)), F.lit(1)).alias("open"), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))).alias("over")))
        return F.transform(part, lambda r: F.struct(r["open"].alias("open"), F.array_append(state["done"], r["over"]).alias("done")))[0]

    zero = F.struct(F.array().cast(SPAN).alias("open"), F.array().cast(f"array<{SPAN}>").alias("done"))

    def whole(own: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / CHUNK) - 1, F.lit(0)).cast("int"))
        return F.aggregate(chunks, zero, lambda s, at: chunk(own, s, at), lambda s: F.concat(F.flatten(s["done"]), s["open"]))

    return F.transform(F.array(order), whole)[0]


def trimmed(spans: Column, text: Column) -> Column:
    """Blanks and punctuation leave the edges of each span; empty spans go."""

    def cut(s: Column) -> Column:
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left = F.length(F.regexp_extract(value, r"^[ \t\n,;:]*", 0))
        right = F.length(F.regexp_extract(value, r"[ \t\n,;:.]*$", 0))
        return F.struct((s["start"] + left).alias("start"), (s["end"] - right).alias("end"), s["entity"].alias("entity"), s["score"].alias("score"), s["source"].alias("source"))

    return F.filter(F.transform(spans, cut), lambda s: s["start"] < s["end"])


def redact(text: Column, spans: Column) -> Column:
    """Merged spans become [ENTITY]."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["entity"], F.lit("]")).alias("out")),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
