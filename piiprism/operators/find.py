"""All personal data of a text: the row patterns, and what lines and names say, in one merge.

Plain texts are read row by row (``plain``). For others, patterns stay in the document's row; header values,
machine-readable zones, names near contact data and repeated names come from frames of lines. These are keyed by a hash
of the text, so copies of a text are read once and rows with equal or null ids don't mix. Spans that lie in a header line
are labels and go before the merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from . import lineage, lines, plain, recognize, spans

#: Scores of what lines say.
HEADER, ZONE, ECHO, CONTACT, REPEATED = 0.90, 0.95, 0.95, 0.75, 0.80
SCORES = {"HEADER": HEADER, "ZONE": ZONE, "ECHO": ECHO, "CONTACT": CONTACT, "REPEATED": REPEATED}
_ITEM = recognize.SPAN[len("array<") : -1]


def _span(start: Column, end: Column, entity: Column, score: float, source: str) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), entity.alias("entity"), F.lit(score).alias("score"), F.lit(source).alias("source"))


def occurrences(t: Column, name: Column) -> Column:
    """Starts of a name's occurrences as whole words, ascending."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}_])"))
    gaps = F.split(t, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, g: F.struct((s["at"] + F.length(g) + F.length(name)).alias("at"), F.array_append(s["out"], s["at"] + F.length(g)).alias("out"))
    return F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), zero, step, lambda s: s["out"])


def line_spans(docs: DataFrame) -> DataFrame:
    """k, said (spans), headers (start, end), names (persons): of each text (k, text, anchors) that has any."""
    rows = lines.lines(docs, "k")
    # every line is looked at once, and only lines that say something are kept for what follows
    marked = lines.with_next(rows, "k").withColumn("bare", F.col("line").rlike(lines.BARE_NAME)).withColumn("zone", lines.mrz_kind(F.col("line")).isNotNull())
    marked = lineage.cut(marked.where("kind IS NOT NULL OR bare OR zone"))
    values = lines.header_values(marked, "k").select("k", _span(F.col("start"), F.col("end"), F.col("entity"), HEADER, "header_pair").alias("s"), "value")
    zone = lines.mrz_lines(marked.where("zone").select("k", "line_no", "start", "line"), "k")
    zones = zone.select("k", _span(F.col("start"), F.col("end"), F.lit("MRZ"), ZONE, "mrz").alias("s"))
    echoes = lines.zone_echoes(docs, lines.zone_fields(zone, "k"), "k").select("k", _span(F.col("start"), F.col("end"), F.col("entity"), ECHO, "mrz_coref").alias("s"), "value")
    near = lines.contact_names(rows, docs.select("k", F.explode("anchors").alias("start")), "k", bare=marked.where("bare").select("k", "line_no", "start", "line"))
    contacts = near.select("k", _span(F.col("start"), F.col("start") + F.length("value"), F.lit("PERSON"), CONTACT, "context").alias("s"), "value")
    heads = marked.where("kind IS NOT NULL").select("k", F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.length("line")).cast("int").alias("end")).alias("h"))
    none = F.lit(None)
    named = F.when(F.col("s.entity") == "PERSON", F.col("value")).alias("name")
    all_ = [x.select("k", "s", none.cast("struct<start:int,end:int>").alias("h"), named) for x in (values, echoes, contacts)]
    all_ += [zones.select("k", "s", none.cast("struct<start:int,end:int>").alias("h"), none.cast("string").alias("name")), heads.select("k", none.cast(_ITEM).alias("s"), "h", none.cast("string").alias("name"))]
    out = all_[0]
    for x in all_[1:]:
        out = out.unionByName(x)
    return out.groupBy("k").agg(F.collect_list("s").alias("said"), F.collect_list("h").alias("headers"), F.collect_set("name").alias("names"))


def repeated(t: Column, names: Column) -> Column:
    """Spans of full names of the text, wherever they came from, at all places where they stand."""
    own = F.array_distinct(F.filter(names, lambda n: (F.length(n) >= 4) & n.contains(" ")))
    at = lambda n: F.transform(occurrences(t, n), lambda a: _span(a, a + F.length(n), F.lit("PERSON"), REPEATED, "coreference"))
    return F.flatten(F.transform(own, at))


def find_pii(docs: DataFrame, key: str = "doc_id", column: str = "text", entities: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """key, column, spans (merged and trimmed) for each row of docs.

    entities: the ones to keep, chosen before the merge; names: the row patterns to use. A null text has no spans. Plain
    texts (``plain``) are read in their rows; only the others, if there are any, go through frames of lines.
    """
    rows = docs.select(key, column)
    odd = F.coalesce(F.col(column).rlike(plain.OTHER), F.lit(False))
    read = plain.find(rows.where(~odd), SCORES, entities, names)
    others = rows.where(odd)
    return read if others.isEmpty() else read.unionByName(find_in_columns(others, key, column, entities, names))


def find_in_columns(docs: DataFrame, key: str = "doc_id", column: str = "text", entities: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """The same for any texts, by Columns and frames of lines."""
    t = texts.fold_digits(F.col(column))
    # patterns cost the most by far: they are matched once for all that reads their spans
    read = lineage.cut(docs.select(key, column, F.sha2(t, 256).alias("k"), recognize.all_spans(t, names).alias("found")))
    people = F.transform(F.filter("found", lambda s: s["entity"] == "PERSON"), lambda s: F.substring(t, s["start"] + 1, s["end"] - s["start"]))
    anchors = F.transform(F.filter("found", lambda s: s["entity"].isin("PHONE", "EMAIL")), lambda s: s["start"])
    some = read.where(F.col("k").isNotNull()).select("k", t.alias("text"), anchors.alias("anchors")).dropDuplicates(["k"])
    both = read.join(line_spans(some), "k", "left")
    no_names, no_spans = F.array().cast("array<string>"), F.array().cast(recognize.SPAN)
    again = repeated(t, F.concat(F.coalesce(people, no_names), F.coalesce("names", no_names)))
    # in the order of the spans: ties of a merge must not depend on the shuffle
    every = F.concat("found", F.array_sort(F.concat(F.coalesce("said", no_spans), F.coalesce(again, no_spans))))
    kept = F.filter(every, lambda s: ~F.exists(F.coalesce("headers", F.array().cast("array<struct<start:int,end:int>>")), lambda h: (h["start"] <= s["start"]) & (s["end"] <= h["end"])))
    if entities is not None:
        kept = spans.whitelist(kept, entities)
    return both.select(key, column, spans.trimmed(spans.merge(kept), F.col(column)).alias("spans"))


def redacted(t: Column, names: list[str]) -> Column:
    """A text in which the row patterns find nothing more. What is taken out can free a value beside it (a digit that
    held a number back is gone), so the text is read again until nothing is found; each time at least a span, of six characters or more, goes."""
    found = lambda x: recognize.all_spans(x, names)
    clean = lambda x: F.transform(F.array(F.struct(x.alias("t"), found(x).alias("s"))), lambda r: F.struct(spans.redact(r["t"], spans.merge(r["s"])).alias("t"), (F.size(r["s"]) == 0).alias("done")))[0]
    times = F.sequence(F.lit(0), F.coalesce(F.ceil(F.length(t) / 6).cast("int"), F.lit(0)))
    zero = F.struct(t.alias("t"), F.lit(False).alias("done"))
    return F.aggregate(times, zero, lambda s, _: F.when(s["done"], s).otherwise(clean(s["t"])), lambda s: s["t"])
