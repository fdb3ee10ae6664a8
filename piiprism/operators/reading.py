"""From the readings of pages to the personal data on them, as polygons of the frame: one program.

Readings (page, id, poly, text, conf), in the coordinates of a frame, go through a floor, repaired years, one reading
of a spot, stitched dates, lines, and value rows under date headers. What is left are boxes with their place in the
page's text; every span that is found in the text comes back to the boxes whose characters it holds, and takes the
part of their quads that it covers. So characters keep their boxes through every merge.

The walks over a page's boxes are greedy and run by page; the text of a page is one row. Spans and boxes meet over a grid
(``geometry.meeting``), so a page with very many boxes is joined by many tasks.

Nulls: readings with a null text or a blank one go, as do those without four corners; a null confidence is 0. Ids that
repeat on a page are boxes of their own. A page without a frame has no detections. Empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import text
from ..sources import ocr
from . import find, geometry, lineage, lines, plain, spans
from .geometry import dealt

#: Score of a passport's number in the upper right of its page.
ZONE_NUMBER = 0.85
#: Kinds of headers whose value row is a date.
DATED = ("DOB", "ISSUE", "EXPIRY", "DATE_FIELD")


def cut_lines(rows: list[dict], factor: float = 2.5) -> list[list[dict]]:
    """Lines of a page, split where a gap exceeds the factor times the height, in the order of (mean middle, x1)."""
    out: list[list[dict]] = []
    for line in geometry.grouped_lines(rows):
        part = [line[0]]
        for r in line[1:]:
            last = part[-1]
            if r["x1"] - last["x2"] > factor * max(r["y2"] - r["y1"], last["y2"] - last["y1"]):
                out.append(part)
                part = []
            part.append(r)
        out.append(part)
    return sorted(out, key=lambda part: (sum((r["y1"] + r["y2"]) / 2 for r in part) / len(part), part[0]["x1"]))


def kept_readings(readings: DataFrame) -> DataFrame:
    """page, id, text, conf, poly and corners of the readings that count."""
    said = readings.withColumn("text", F.trim("text")).withColumn("conf", F.coalesce(F.col("conf").cast("double"), F.lit(0.0)))
    said = ocr.confident(said.where("text <> '' AND size(poly) = 4")).withColumn("text", text.repair_year(F.col("text")))
    return said.select("page", F.col("id").cast("long").alias("id"), "text", "conf", F.col("poly").cast("array<array<double>>").alias("poly"), *geometry.bounding_box(F.col("poly").cast("array<array<double>>")))


def folded(rows: list[dict], names: list[str]) -> list[dict]:
    """The boxes of a page that are left of its readings, with their place, in the order of line and no."""
    kept = geometry.with_years(geometry.surest(rows))
    return [{n: r[n] for n in names} | {"line": k, "no": j} for k, line in enumerate(cut_lines(kept)) for j, r in enumerate(line)]


def boxes(readings: DataFrame) -> DataFrame:
    """page, line, no, text, conf, poly and corners of what is kept of the readings, in lines from the top."""
    said = kept_readings(readings)
    keyed = dealt(geometry.date_halves(geometry.reading_keys(said)))
    fields = [*(StructField(f.name, f.dataType) for f in said.schema.fields), StructField("line", LongType()), StructField("no", LongType())]
    names = ["_at", *(f.name for f in said.schema.fields if f.name not in ("page", "poly"))]
    columns = [c for c in keyed.columns if c != "page"]
    rows = geometry._by_page(keyed, columns, lambda rows: folded(rows, names), StructType(fields), carried=("poly",))
    # what is joined from several boxes has the quad around them
    return value_rows(lineage.cut(dealt(rows.withColumn("poly", F.coalesce("poly", geometry.quad(*map(F.col, geometry.CORNERS)))))))


def value_rows(rows: DataFrame) -> DataFrame:
    """Boxes (page, line, no, ...) in which the row of a date header's value is one box.

    The lines after such a header stand on the baseline of the first of them, or end the island: gaps and islands over
    lines that are near in height, whatever stands between them. An island is one box, in the line after the header,
    if its boxes from the left say a whole date; else it stays as it is.
    """
    one = rows.groupBy("page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda t: t["text"]), " ").alias("said"),
        F.avg((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.max(F.col("y2") - F.col("y1")).alias("h"), F.count("*").alias("n"),
    )
    own = Window.partitionBy("page").orderBy("line")
    header = F.when(lines.header_kind(F.col("said")).isin(*DATED), F.col("line"))
    one = one.withColumn("under", F.last(header, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    below = Window.partitionBy("page", "under").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    one = one.where("under IS NOT NULL").withColumn("base", F.first(F.struct("cy", "h", "line")).over(below))
    far = F.abs(F.col("cy") - F.col("base.cy")) > 0.5 * F.greatest("base.h", "h") + 1
    island = one.where(F.col("under").isNotNull()).withColumn("left", F.max(F.when(far, 1).otherwise(0)).over(below)).where("left = 0")
    inside = rows.join(island.select("page", "line", F.col("base.line").alias("base")), ["page", "line"])
    row = inside.groupBy("page", "base").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "line", "no", "text"))), lambda t: t["text"]), " ").alias("text"),
        F.min("id").alias("id"), F.min("conf").alias("conf"), *(f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))),
    )
    row = row.where((F.col("n") > 1) & F.regexp_replace(F.trim("text"), "[.,;]+$", "").rlike(lines.FULL_DATE))
    gone = island.select("page", "line", F.col("base.line").alias("base")).join(row.select("page", "base"), ["page", "base"], "left_semi").select("page", "line")
    merged = row.select("page", "id", "text", "conf", geometry.quad(*map(F.col, geometry.CORNERS)).alias("poly"), *geometry.CORNERS, F.col("base").alias("line"), F.lit(0).cast("long").alias("no"))
    return rows.join(gone, ["page", "line"], "left_anti").select(*merged.columns).unionByName(merged)


def placed(rows: DataFrame) -> DataFrame:
    """Boxes with start and end in their page's text: words joined by a blank, lines by a line feed."""
    w = Window.partitionBy("page").orderBy("line", "no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def page_texts(rows: DataFrame) -> DataFrame:
    """page, text."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "no", "text")))
    parts = F.transform(ordered, lambda t, i: F.concat(F.when(i == 0, "").when(t["no"] == 0, "\n").otherwise(" "), t["text"]))
    return rows.groupBy("page").agg(F.array_join(parts, "").alias("text"))


def clamped(polygon: Column, width: Column, height: Column) -> Column:
    """Corners in whole pixels within the frame."""
    at = lambda v, most: F.least(F.greatest(F.bround(v, 0).cast("int"), F.lit(0)), most.cast("int"))
    return F.transform(polygon, lambda p: F.array(at(p[0], width), at(p[1], height)))


def turned(polygon: Column, matrix: Column) -> Column:
    """Corners under a 2 x 3 matrix (two rows of three)."""
    at = lambda p, m: m[0] * p[0] + m[1] * p[1] + m[2]
    return F.transform(polygon, lambda p: F.array(at(p, matrix[0]), at(p, matrix[1])))


def page_spans(rows: DataFrame, texts: DataFrame, frames: DataFrame) -> DataFrame:
    """page, id, start, end, entity, score: what is found in the texts, and numbers in the zone of a passport."""
    found = find.find_pii(texts, "page").select("page", F.explode("spans").alias("s")).select("page", "s.start", "s.end", "s.entity", "s.score")
    centre = lambda a, b: F.avg((F.col(a) + F.col(b)) / 2)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda t: t["text"]), " ")
    one = rows.groupBy("page", F.col("line").alias("at")).agg(said.alias("line"), F.min("start").alias("start"), F.max("end").alias("end"), centre("x1", "x2").alias("cx"), centre("y1", "y2").alias("cy"))
    one = one.join(frames.select("page", "width", "height"), "page").withColumn("cx", F.col("cx") / F.col("width")).withColumn("cy", F.col("cy") / F.col("height"))
    zone = lines.passport_numbers(one, found).withColumn("score", F.lit(ZONE_NUMBER))
    both = found.unionByName(zone.select("page", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity", "score"))
    return both.withColumn("id", F.row_number().over(Window.partitionBy("page").orderBy("start", "end", "entity")).cast("long"))


def outlined(hit: DataFrame) -> DataFrame:
    """Detections from hits: page, span, line, start, end, entity, evidence, sure, first and last (start, end, n, quad: of the
    boxes that a span stands in on a line), said (its text on the line), width, height and matrix of the frame."""
    long = F.greatest(F.lit(1), F.col("first.n")).cast("double"), F.greatest(F.lit(1), F.col("last.n")).cast("double")
    left = geometry.sub_polygon(F.col("first.quad"), F.greatest(F.lit(0), F.col("start") - F.col("first.start")), F.col("first.end") - F.col("first.start"), long[0])
    right = geometry.sub_polygon(F.col("last.quad"), F.lit(0), F.least("end", "last.end") - F.col("last.start"), long[1])
    quad = geometry.once(F.struct(left.alias("left"), right.alias("right")), lambda s: geometry.grown(F.array(s["left"][0], s["right"][1], s["right"][2], s["left"][3])))
    straight = clamped(quad, F.col("width"), F.col("height"))
    back = lambda p: clamped(turned(p, F.col("matrix")), F.col("width"), F.col("height"))
    polygon = geometry.once(straight, lambda p: F.when(F.col("matrix").isNull(), p).otherwise(back(p)))
    # in one array, as a condition on columns would draw each polygon again
    drawn = geometry.once(polygon, lambda p: F.struct(*geometry.bounding_box(p), p.alias("polygon")))
    large = F.filter(F.array(drawn), lambda d: (d["x2"] - d["x1"] > 2) & (d["y2"] - d["y1"] > 2))
    score = F.round(F.col("evidence") * (0.75 + 0.25 * F.col("sure")), 2).alias("score")
    return hit.select("page", "span", "line", "entity", spans.label(F.col("entity")).alias("label"), F.col("said").alias("text"), F.explode(large).alias("d"), score).select("page", "span", "line", "entity", "label", "text", "d.*", "score")


def detections(readings: DataFrame, frames: DataFrame) -> DataFrame:
    """page, span, line, entity, label, text, x1, y1, x2, y2, polygon, score: a row for each line of a page that a span stands in.

    frames: page, width, height, matrix (null, or the way back from straightened readings). The score is the span's,
    tempered by how sure the reader was; what is not larger than two pixels goes. Pages of plain texts (``plain``) are
    walked whole, one after the other; only pages with other texts, if there are any, go through frames of boxes.
    """
    # a page without a span or of other texts is looked for in what was written, not in the readings
    walked = lineage.cut(page_hits(readings, frames))
    box = lambda t: F.struct(*(F.col(f"{t}_{c}").alias(c) for c in ("start", "end", "n", "quad"))).alias(t)
    out = outlined(walked.where("span IS NOT NULL").select("*", box("first"), box("last")))
    others = walked.where("span IS NULL").select("page").distinct()
    if others.isEmpty():
        return out
    return out.unionByName(detections_in_columns(readings.join(others, "page", "left_semi"), frames))


def detections_in_columns(readings: DataFrame, frames: DataFrame) -> DataFrame:
    """The same for any pages, by Columns and frames of boxes."""
    rows = lineage.cut(dealt(placed(boxes(readings))))
    texts = lineage.cut(dealt(page_texts(rows)))
    found = lineage.cut(page_spans(rows, texts, frames))
    met = geometry.sharing(found, rows.select("page", "line", "start", "end", "conf", F.col("poly").alias("quad"), F.length("text").alias("n")))
    hit = met.groupBy("page", F.col("s_id").alias("span"), F.col("b_line").alias("line")).agg(
        F.first("s_start").alias("start"), F.first("s_end").alias("end"), F.first("s_entity").alias("entity"), F.first("s_score").alias("evidence"), F.avg("b_conf").alias("sure"),
        F.min(F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b_n").alias("n"), F.col("b_quad").alias("quad"))).alias("first"),
        F.max(F.struct(F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.col("b_n").alias("n"), F.col("b_quad").alias("quad"))).alias("last"),
    )
    hit = hit.join(frames.select("page", "width", "height", "matrix"), "page").join(texts, "page")
    a, b = F.greatest("start", "first.start"), F.least("end", "last.end")
    return outlined(hit.withColumn("said", F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))))


# ---- pages of plain texts, walked whole ----

_FULL_DATE, _PASSPORT = plain.compiled(lines.FULL_DATE), plain.compiled(lines.PASSPORT)


def mean(values: Iterable[float]) -> float:
    """As an aggregate has it: one value after the other is added."""
    total, n = 0.0, 0
    for v in values:
        total, n = total + v, n + 1
    return total / n


def value_boxes(rows: list[dict]) -> list[dict]:
    """What value_rows makes of the boxes of one page of plain texts, which come and go in the order of line and no."""
    own = {k: list(g) for k, g in groupby(rows, key=lambda r: r["line"])}
    numbers = list(own)
    heads = [plain.header_kind(" ".join(r["text"] for r in own[k])) in DATED for k in numbers]
    middle = lambda k: mean((r["y1"] + r["y2"]) / 2 for r in own[k])
    high = lambda k: max(r["y2"] - r["y1"] for r in own[k])
    for i, head in enumerate(heads):
        if not head or i + 1 == len(numbers):
            continue
        base = numbers[i + 1]
        cy, h, island = middle(base), high(base), []
        for j in range(i + 1, len(numbers)):
            k = numbers[j]
            if abs(middle(k) - cy) > 0.5 * max(h, high(k)) + 1:
                break
            island.append(k)
            if heads[j]:
                break
        inside = [r for k in island for r in own[k]]
        said = " ".join(r["text"] for r in sorted(inside, key=lambda r: (r["x1"], r["line"], r["no"], r["text"])))
        if len(inside) > 1 and _FULL_DATE.search(re.sub("[.,;]+$", "", said.strip(" "))):
            box = {"id": min(r["id"] for r in inside), "text": said, "conf": min(r["conf"] for r in inside), "line": base, "no": 0, "_at": None}
            box |= {c: f(r[c] for r in inside) for c, f in zip(geometry.CORNERS, (min, min, max, max), strict=True)}
            for k in island:
                own[k] = []
            own[base] = [box]
    return [r for k in numbers for r in own[k]]


def said_of(rows: list[dict]) -> str:
    """The text of a page's boxes, which get start and end in it."""
    parts, at = [], 0
    for i, r in enumerate(rows):
        parts.append("" if i == 0 else "\n" if r["no"] == 0 else " ")
        parts.append(r["text"])
        r["start"], r["end"] = at, at + len(r["text"])
        at = r["end"] + 1
    return "".join(parts)


def zone_numbers(rows: list[dict], found: list[tuple], width: float | None, height: float | None) -> list[tuple]:
    """What lines.passport_numbers finds on one page of plain texts."""
    out, shown, begins = [], None, [s[0] for s in found]
    for _, g in groupby(rows, key=lambda r: r["line"]):
        line = list(g)
        said = " ".join(r["text"] for r in line)
        digits = sum(map(said.count, "0123456789"))
        if not (8 <= digits <= 10 and len(said.strip(" ")) <= digits + 3 and width and height):
            continue
        cx, cy = mean((r["x1"] + r["x2"]) / 2 for r in line) / float(width), mean((r["y1"] + r["y2"]) / 2 for r in line) / float(height)
        if cx > 0.5 and cy < 0.55:
            if shown is None:
                shown = any(s[2] == "MRZ" for s in found) or any(_PASSPORT.search(" ".join(r["text"] for r in x)) for _, x in groupby(rows, key=lambda r: r["line"]))
            start, end = line[0]["start"], line[-1]["end"]
            at = bisect_right(begins, start) - 1  # spans lie apart: no other can hold the line
            if shown and (at < 0 or found[at][1] < end):
                out.append((start, end, "ID_NUMBER", ZONE_NUMBER))
    return out


def met(rows: list[dict], found: list[tuple], t: str) -> Iterator[tuple]:
    """(span, line, start, end, entity, evidence, said, sure, first box, last box) for each line that a span stands in."""
    starts = [r["start"] for r in rows]
    for k, (start, end, entity, score) in enumerate(sorted(found, key=lambda s: s[:3]), 1):
        i = max(0, bisect_right(starts, start) - 1)
        i += rows[i]["end"] <= start
        j = i
        while j < len(rows) and rows[j]["start"] < end:
            j += 1
        for line, g in groupby(rows[i:j], key=lambda r: r["line"]):
            own = list(g)
            first, last = own[0], own[-1]
            yield k, line, start, end, entity, score, t[max(start, first["start"]) : min(end, last["end"])], mean(r["conf"] for r in own), first, last


_QUAD = ArrayType(ArrayType(DoubleType()))
_HIT = [("span", LongType()), ("line", LongType()), ("start", IntegerType()), ("end", IntegerType()), ("entity", StringType()), ("evidence", DoubleType()), ("said", StringType()), ("sure", DoubleType())]
_SIDE = [("start", LongType()), ("end", LongType()), ("n", IntegerType())]
_OF_PAGE = ["page", "width", "height", "matrix"]


def page_hits(readings: DataFrame, frames: DataFrame) -> DataFrame:
    """The hits of outlined (first and last as columns first_... and last_...) of pages of plain texts; a row without a span for
    each other page. Rows come page by page and are walked as they come: surest readings, years, lines, value rows, text,
    spans, and the boxes that these stand in."""
    keyed = geometry.date_halves(geometry.reading_keys(kept_readings(readings))).withColumn("_odd", F.col("text").rlike(plain.OTHER))
    rows = dealt(keyed).join(frames.select(*_OF_PAGE), "page").sortWithinPartitions("page")
    plain.ship_code(rows.sparkSession)
    fields = [rows.schema[c] for c in _OF_PAGE] + [StructField(n, t) for n, t in _HIT]
    fields += [StructField(f"{side}_{n}", t) for side in ("first", "last") for n, t in (*_SIDE, ("quad", _QUAD))]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)
    seen = [c for c in keyed.columns if c not in ("page", "poly")]
    names = ["_at", "id", "text", "conf", *geometry.CORNERS]

    def walk(table: pa.RecordBatch) -> pa.RecordBatch:
        n = table.num_rows
        every = [dict(zip([*seen, "_at"], r, strict=True)) for r in zip(*(geometry._plain(table.column(c)) for c in seen), range(n), strict=True)]
        size = list(zip(table.column("width").to_pylist(), table.column("height").to_pylist(), strict=True))
        whole, made, at = [], [], 0  # pages: their first row, boxes and text; rows of hits
        for _, g in groupby(table.column("page").to_pylist()):
            end = at + len(list(g))
            own = every[at:end]
            if any(r["_odd"] for r in own):
                made.append((at, *[None] * 10))
            else:
                own = value_boxes(folded(sorted(own, key=lambda r: r["id"]), names))
                whole.append((at, own, said_of(own)))
            at = end
        texts = [t for _, _, t in whole]
        found = plain.found(pa.array(texts, pa.string()), texts, list(plain.BY_NAME.values()))
        for (at, own, t), s in zip(whole, found, strict=True):
            spans_ = [x[:4] for x in plain.every_span(t, s, find.SCORES, None)]
            made += [(at, *h) for h in met(own, spans_ + zone_numbers(own, spans_, *size[at]), t)]
        place = pa.array([m[0] for m in made], pa.int32())
        out = {c: table.column(c).take(place) for c in _OF_PAGE}
        out |= {c: pa.array([m[i] for m in made], arrow.field(c).type) for i, (c, _) in enumerate(_HIT, 1)}
        for side, i in (("first", 9), ("last", 10)):
            of = [m[i] for m in made]
            out |= {f"{side}_{c}": pa.array([r and r[c] for r in of], pa.int64()) for c in ("start", "end")}
            out[f"{side}_n"] = pa.array([r and len(r["text"]) for r in of], pa.int32())
            # what is joined from several boxes has the quad around them
            drawn = [r for r in of if r and r["_at"] is None]
            quads = pa.array([[[r["x1"], r["y1"]], [r["x2"], r["y1"]], [r["x2"], r["y2"]], [r["x1"], r["y2"]]] for r in drawn], table.column("poly").type)
            after = iter(range(n, n + len(drawn)))
            places = [None if r is None else next(after) if r["_at"] is None else r["_at"] for r in of]
            out[f"{side}_quad"] = pa.concat_arrays([table.column("poly"), quads]).take(pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([out[c].cast(arrow.field(c).type) for c in arrow.names], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []  # of a page that may go on in the next batch

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                yield walk(pa.concat_batches(parts))

        for b in batches:
            if not b.num_rows:
                continue
            pages = b.column("page")
            cut = pc.index(pages, pages[-1]).as_py()
            if cut:
                yield from done([*pending, b.slice(0, cut)])
                pending = [b.slice(cut)]
            else:
                if pending and pending[-1].column("page")[0] != pages[0]:
                    yield from done(pending)
                    pending = []
                pending.append(b)
        yield from done(pending)

    return rows.mapInArrow(run, schema)
