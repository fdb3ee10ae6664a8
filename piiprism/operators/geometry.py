"""Operators on boxes: overlap joins, lines, gaps, suppression, deduplication, stitched dates, polygons.

A box is a row (page, id, x1, y1, x2, y2, ...). Joins are by page with the geometry as the residual condition; the
greedy folds, whose result depends on their order, run by page, in one task for each page's boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text

CORNERS = ("x1", "y1", "x2", "y2")


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes given as columns by corner; 0 where they are apart."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    return F.when((w > 0) & (h > 0), w * h / (area(a) + area(b) - w * h)).otherwise(F.lit(0.0))


def _side(rows: DataFrame, tag: str) -> tuple[DataFrame, dict[str, Column]]:
    out = rows.select("page", *(F.col(c).alias(f"{tag}_{c}") for c in rows.columns if c != "page"))
    return out, {c: F.col(f"{tag}_{c}").cast("double") for c in CORNERS}


#: Boxes of a page from which on they meet over a grid; cells of the finest level, and how much coarser the next is.
CROWDED, CELL, COARSER, LEVELS = 4096, 64.0, 4, 8


def meeting(left: DataFrame, right: DataFrame, a: str, b: str, crowded: int = CROWDED) -> DataFrame:
    """Pairs of a page's boxes that meet or touch: left and right hold page and columns a_... and b_..., corners among them.

    Few boxes of a page are paired in one join by page. Pages of more than `crowded` boxes on the right go over a grid of
    several levels, each with cells COARSER times as wide: a box lies in at most four cells of the first level whose cells
    are not smaller than it. It is dealt to its cells of that level and of all coarser ones, two boxes are paired at the
    level of the larger, and only in the cell where their common part begins. So a page's work is spread by cells, and
    grows with its boxes and pairs, not with the square of its boxes. Boxes beyond the coarsest level are dealt to more
    cells of it. Rows with a null corner meet none.
    """
    full = right.groupBy("page").agg(F.count("*").alias("boxes")).where(f"boxes > {crowded}").select("page")
    edges = lambda t: [F.col(f"{t}_{c}").cast("double") for c in CORNERS]
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = edges(a), edges(b)
    touch = (ax1 <= bx2) & (bx1 <= ax2) & (ay1 <= by2) & (by1 <= ay2)
    few = left.join(full, "page", "left_anti").join(right, "page").where(touch)

    def dealt(rows: DataFrame, t: str) -> DataFrame:
        x1, y1, x2, y2 = edges(t)
        size = F.greatest(x2 - x1, y2 - y1, F.lit(1.0))
        own = F.least(F.greatest(F.ceil(F.log(float(COARSER), size / CELL)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")
        rows = rows.join(full, "page", "left_semi").where(size.isNotNull()).withColumn(f"{t}_level", own)
        rows = rows.withColumn("level", F.explode(F.sequence(F.col(f"{t}_level"), F.lit(LEVELS - 1))))
        wide = F.lit(CELL) * F.pow(F.lit(float(COARSER)), F.col("level"))
        cells = lambda low, high: F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide)))
        return rows.withColumn("cx", cells(x1, x2)).withColumn("cy", cells(y1, y2))

    wide = F.lit(CELL) * F.pow(F.lit(float(COARSER)), F.col("level"))
    once = (F.col("level") == F.greatest(f"{a}_level", f"{b}_level")) & (F.col("cx") == F.floor(F.greatest(ax1, bx1) / wide)) & (F.col("cy") == F.floor(F.greatest(ay1, by1) / wide))
    many = dealt(left, a).join(dealt(right, b), ["page", "level", "cx", "cy"]).where(touch & once)
    return few.unionByName(many.select(*few.columns))


def overlapping(boxes: DataFrame, floor: float) -> DataFrame:
    """page, a, b, iou of the pairs of a page's boxes, a before b, that overlap by the floor (above zero) or more."""
    (left, p), (right, q) = _side(boxes, "a"), _side(boxes, "b")
    met = meeting(left, right, "a", "b").where((F.col("a_id") < F.col("b_id")) & (iou(p, q) >= floor))
    return met.select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(iou(p, q), 6).alias("iou"))


def suppressed(texts: DataFrame, plates: DataFrame, overlap: float = 0.5, score: float = 0.6) -> DataFrame:
    """The texts that no plate of the score or more covers by more than the overlap."""
    (plate, q), (text_, p) = _side(plates.where(F.col("score") >= score).select("page", *CORNERS), "p"), _side(texts.select("page", *CORNERS).distinct(), "t")
    hit = meeting(text_, plate, "t", "p").where(iou(p, q) > overlap).select("page", *(F.col(f"t_{c}").alias(c) for c in CORNERS)).distinct()
    return texts.join(hit, ["page", *CORNERS], "left_anti").select(*texts.columns)


def _runs(rows: DataFrame, tag: str) -> DataFrame:
    """Characters [start, end) as boxes of no height; tag_... columns."""
    out = rows.select("page", *(F.col(c).alias(f"{tag}_{c}") for c in rows.columns if c != "page"))
    return out.withColumns({f"{tag}_x1": F.col(f"{tag}_start"), f"{tag}_x2": F.col(f"{tag}_end") - 1, f"{tag}_y1": F.lit(0), f"{tag}_y2": F.lit(0)})


def sharing(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, s_..., b_...: spans and boxes (page, id, start, end, ...) that share characters."""
    return meeting(_runs(spans, "s"), _runs(boxes, "b"), "s", "b").where("s_start < b_end AND s_end > b_start")


def covered(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, span, boxes, confidence: the boxes that share characters with each span, and their mean confidence.

    spans: page, id, start, end; boxes: page, id, start, end, conf.
    """
    hit = sharing(spans, boxes).select("page", F.col("s_id").alias("span"), F.col("b_conf").alias("conf"))
    return hit.groupBy("page", "span").agg(F.count("*").alias("boxes"), F.round(F.avg("conf"), 6).alias("confidence"))


def segments(boxes: DataFrame, factor: float = 2.5) -> DataFrame:
    """boxes with segment: a page's line (page, line) splits where the gap to the box before exceeds the factor times
    the higher of the two."""
    w = Window.partitionBy("page", "line").orderBy("x1", "id")
    gap = F.col("x1") - F.lag("x2").over(w)
    high = F.greatest(F.col("y2") - F.col("y1"), F.lag(F.col("y2") - F.col("y1")).over(w))
    return boxes.withColumn("cut", F.coalesce((gap > factor * high).cast("int"), F.lit(0))).withColumn("segment", F.sum("cut").over(w).cast("long")).drop("cut")


def running_text(boxes: DataFrame) -> DataFrame:
    """boxes with start and end in their page's text: words joined by a space, lines by a line feed."""
    w = Window.partitionBy("page").orderBy("line", "x1", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")
    return boxes.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt by page to tasks for all cores: pages are small and take long, so their bytes tell nothing of their work."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "page")


def _plain(column: pa.Array) -> list:
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    return column.to_numpy().tolist() if number and not column.null_count else column.to_pylist()


def _by_page(boxes: DataFrame, columns: list[str], fold: Callable[[list[dict]], list[dict]], schema: StructType, carried: tuple[str, ...] = ()) -> DataFrame:
    """What a fold makes of each page's boxes, in the order of id; a page is one row of arrays on its way to it.

    Columns that are carried are not seen by the fold: a row it gives has those of the row it is made of, or nulls if it
    is joined from several."""
    packed = boxes.groupBy("page").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    arrow = to_arrow_schema(schema)
    seen = [c for c in columns if c not in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # by column: most of the time went into rows of Python values, one by one
            given = b.column("rows").flatten()
            held = dict(zip(columns, given.flatten(), strict=True))
            every = [dict(zip([*seen, "_at"], r, strict=True)) for r in zip(*(_plain(held[c]) for c in seen), range(len(given)), strict=True)]
            out, pages, at = [], [], 0
            for page, n in zip(b.column("page").to_pylist(), b.column("rows").value_lengths().to_pylist(), strict=True):
                found = fold(sorted(every[at : at + n], key=lambda r: r["id"]))
                out += found
                pages += [page] * len(found)
                at += n
            made = {"page": pages} | {f.name: [r[f.name] for r in out] for f in arrow if f.name != "page" and f.name not in carried}
            made = {c: pa.array(v, arrow.field(c).type) for c, v in made.items()}
            if carried:
                place = pa.array([r["_at"] for r in out], pa.int64())
                made |= {c: held[c].take(place) for c in carried}
            yield pa.RecordBatch.from_arrays([made[c].cast(arrow.field(c).type) for c in arrow.names], schema=arrow)

    return packed.mapInArrow(run, schema)


def grouped_lines(rows: list[dict]) -> list[list[dict]]:
    """Lines of a page from its upper one down, each from the left: in the order of (middle, x1) a box joins the first
    line whose mean middle is near enough."""
    found: list[list] = []  # sum of middles, sum of heights, boxes
    for r in sorted(rows, key=lambda r: ((r["y1"] + r["y2"]) / 2, r["x1"])):
        cy, h = (r["y1"] + r["y2"]) / 2, r["y2"] - r["y1"]
        line = next((f for f in found if abs(cy - f[0] / len(f[2])) <= 0.5 * min(h, f[1] / len(f[2])) + 1), None)
        if line is None:
            found.append(line := [0.0, 0.0, []])
        line[0], line[1] = line[0] + cy, line[1] + h
        line[2].append(r)
    found.sort(key=lambda f: (f[0] / len(f[2]), min(r["x1"] for r in f[2])))
    return [sorted(f[2], key=lambda r: r["x1"]) for f in found]


def line_groups(boxes: DataFrame) -> DataFrame:
    """boxes with line: its number from the top of the page."""

    def fold(rows: list[dict]) -> list[dict]:
        return [r | {"line": k} for k, line in enumerate(grouped_lines(rows)) for r in line]

    return _by_page(boxes, [c for c in boxes.columns if c != "page"], fold, StructType([*boxes.schema.fields, StructField("line", LongType())]))


def _overlap(a: dict, b: dict) -> float:
    w, h = min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]), min(a["y2"], b["y2"]) - max(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0


def dedupe(detections: DataFrame, overlap: float = 0.55) -> DataFrame:
    """One of the text detections that overlap and agree in their text: the first, unless a later one scores higher.

    A page's boxes are walked in the order of id; the walk is greedy, so its order is part of the result.
    """

    def fold(rows: list[dict]) -> list[dict]:
        kept: list[dict] = []
        for r in rows:
            same = lambda o, r=r: o["type"] == "text" and o["_key"] and _overlap(r, o) >= overlap and (r["_key"] in o["_key"] or o["_key"] in r["_key"])
            at = next((i for i, o in enumerate(kept) if same(o)), -1) if r["type"] == "text" and r["_key"] else -1
            if at < 0:
                kept.append(r)
            elif r["score"] > kept[at]["score"]:
                kept[at] = r
        return [{k: v for k, v in r.items() if k != "_key"} for r in kept]

    keyed = detections.withColumn("_key", text.text_key(F.coalesce("text", F.lit(""))))
    return _by_page(keyed, [c for c in keyed.columns if c != "page"], fold, detections.schema)


def similar(a: str, b: str) -> bool:
    """Whether two keys are readings of one text: one holds the other, or nine tenths of their characters match in order."""
    if not a or not b:
        return False
    if a in b or b in a:
        return True
    longest = max(len(a), len(b))
    return abs(len(a) - len(b)) <= max(2, int(0.12 * longest)) and SequenceMatcher(None, a, b).ratio() >= 0.9


def surest(rows: list[dict], overlap: float = 0.45) -> list[dict]:
    """Readings (with _key and _full) without those that say what another says of the same spot."""
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: -r["conf"]):
        at = next((i for i, o in enumerate(kept) if _overlap(r, o) > overlap and similar(r["_key"], o["_key"])), None)
        if at is None:
            kept.append(r)
        elif len(r["_full"]) > len(kept[at]["_full"]) and kept[at]["_full"] in r["_full"]:
            kept[at] = r
    return kept


def reading_keys(readings: DataFrame) -> DataFrame:
    """readings with _key and _full, by which they are compared, and conf without nulls."""
    said = F.coalesce("text", F.lit(""))
    return readings.withColumn("_key", text.text_key(said)).withColumn("_full", F.lower(F.regexp_replace(said, r"\s+", ""))).withColumn("conf", F.coalesce("conf", F.lit(0.0)))


def dedupe_readings(readings: DataFrame, overlap: float = 0.45) -> DataFrame:
    """One of the readings (page, id, text, conf, corners) of a spot: the surest, unless another holds all its text and more.

    A page's readings are walked from the surest on, equal ones in the order of id. White space and case don't count in
    how full a reading is; other signs do. Null texts are empty: an empty reading is like no other and stays.
    """

    def fold(rows: list[dict]) -> list[dict]:
        return [{k: v for k, v in r.items() if k not in ("_key", "_full")} for r in surest(rows, overlap)]

    keyed = reading_keys(readings)
    return _by_page(keyed, [c for c in keyed.columns if c != "page"], fold, readings.schema)


def date_halves(boxes: DataFrame) -> DataFrame:
    """boxes with _head (a day and a month, perhaps in two languages, and no year) and _year (the year that a box may be)."""
    months = "|".join(text.MONTHS)
    kinds = boxes.withColumn("_head", F.col("text").rlike(rf"(?i)^\s*\d{{1,2}}\s*(?:{months})[A-Z]*\s*(?:[/IlL|1]?\s*(?:{months})[A-Z]*)?\s*$"))
    year = F.translate(F.trim("text"), "".join(text.YEAR.values()), "".join(d * len(x) for d, x in text.YEAR.items()))
    return kinds.withColumn("_year", F.when(F.trim("text").rlike(r"^[0-9IlOoSsZzB|]{2}(?:[0-9IlOoSsZzB|]{2})?$") & year.rlike("^[0-9]+$"), year))


def joined(rows: list[dict], said: str) -> dict:
    """One box around several, with the text and the least confidence of them."""
    a, b, c, d = min(r["x1"] for r in rows), min(r["y1"] for r in rows), max(r["x2"] for r in rows), max(r["y2"] for r in rows)
    box = rows[0] | {"text": said, "x1": a, "y1": b, "x2": c, "y2": d}
    if "conf" in box:
        box["conf"] = min(r["conf"] for r in rows)
    return box | {"_at": None}


def with_years(rows: list[dict]) -> list[dict]:
    """Boxes (with _head and _year): a day and month joins the first year to its right on its baseline, once."""
    rows, used, out = sorted(rows, key=lambda r: (round((r["y1"] + r["y2"]) / 2), r["x1"])), set(), []
    for i, r in enumerate(rows):
        if i in used:
            continue
        for j in range(i + 1, len(rows)) if r["_head"] else ():
            o = rows[j]
            h, gap = (r["y2"] - r["y1"], o["y2"] - o["y1"]), o["x1"] - r["x2"]
            if j not in used and o["_year"] and min(r["y2"], o["y2"]) - max(r["y1"], o["y1"]) >= 0.45 * max(1.0, min(h)) and -2 <= gap <= 6 * max(h):
                used.add(j)
                r = joined([r, o], f"{r['text']} {o['_year']}")
                break
        out.append(r)
    return out


def stitched_dates(boxes: DataFrame) -> DataFrame:
    """page, id, text, x1, y1, x2, y2: a day and month joins the first year to its right on its baseline, once."""
    names = ["id", "text", *CORNERS]
    return _by_page(date_halves(boxes), [*names, "_head", "_year"], lambda rows: [{n: r[n] for n in names} for r in with_years(rows)], StructType([boxes.schema[n] for n in ("page", *names)]))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value, which is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), made), 1)


def sub_polygon(corners: Column, first: Column, last: Column, n: Column, pad: float = 0.05) -> Column:
    """The part of a quad (array of four [x, y], from the upper left) that holds characters [first, last) of n."""
    a = F.greatest(F.lit(0.0), (first - pad) / n)
    b = F.least(F.lit(1.0), (last + pad) / n)
    at = lambda i, j, t: F.array(*(corners[i][k] + (corners[j][k] - corners[i][k]) * t for k in (0, 1)))
    return once(F.struct(a.alias("a"), b.alias("b")), lambda t: F.array(at(0, 1, t["a"]), at(0, 1, t["b"]), at(3, 2, t["b"]), at(3, 2, t["a"])))


def bounding_box(polygon: Column) -> list[Column]:
    """x1, y1, x2, y2 around a polygon."""
    side = lambda k: F.transform(polygon, lambda p: p[k])
    return [F.array_min(side(0)).alias("x1"), F.array_min(side(1)).alias("y1"), F.array_max(side(0)).alias("x2"), F.array_max(side(1)).alias("y2")]


def quad(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box as a quad from the upper left, clockwise."""
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def grown(corners: Column, tall: float = 0.02, wide: float = 0.005) -> Column:
    """A quad taken outward along its own axes by shares of its height and width."""
    along = [(corners[1][k] - corners[0][k]) * wide for k in (0, 1)]
    down = [(corners[3][k] - corners[0][k]) * tall for k in (0, 1)]
    return F.array(*(F.array(*(corners[i][k] + a * along[k] + d * down[k] for k in (0, 1))) for i, (a, d) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))))


def moved(corners: Column, matrix: Column, width: Column, height: Column) -> Column:
    """A polygon under a 2 x 3 affine matrix (two rows of three), within the frame."""
    def at(p: Column, row: int, most: Column) -> Column:
        m = matrix[row]
        return F.least(F.greatest(m[0] * p[0] + m[1] * p[1] + m[2], F.lit(0.0)), most.cast("double"))

    return F.transform(corners, lambda p: F.array(at(p, 0, width), at(p, 1, height)))


def face_box(b: dict[str, Column], width: Column, height: Column) -> list[Column]:
    """A face's box with a tenth more at the sides and below and 15 hundredths above, within the image."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return [
        F.greatest(F.lit(0), F.floor(b["x1"] - 0.1 * w)).cast("int").alias("x1"), F.greatest(F.lit(0), F.floor(b["y1"] - 0.15 * h)).cast("int").alias("y1"),
        F.least(width, F.ceil(b["x2"] + 0.1 * w)).cast("int").alias("x2"), F.least(height, F.ceil(b["y2"] + 0.1 * h)).cast("int").alias("y2"),
    ]


def inside(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon: an odd number of its edges cross the ray to the right."""
    n = F.size(polygon)
    edges = F.transform(polygon, lambda p, i: F.struct(p.alias("p"), polygon[((i + 1) % n).cast("int")].alias("q")))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0])

    return F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def picked(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """page, point, id: the smallest box that holds each point (page, point, x, y)."""
    at = points.select("page", F.col("point").alias("p_point"), F.col("x").alias("p_x1"), F.col("y").alias("p_y1"), F.col("x").alias("p_x2"), F.col("y").alias("p_y2"))
    hit = meeting(at, _side(boxes, "b")[0], "p", "b")
    area = (F.col("b_x2") - F.col("b_x1")) * (F.col("b_y2") - F.col("b_y1"))
    return hit.groupBy("page", F.col("p_point").alias("point")).agg(F.min(F.struct(area.alias("area"), F.col("b_id").alias("id")))["id"].alias("id"))


def layout_blocks(layouts: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages): text blocks in pixels and, by page, whether the whole frame has to be read.

    layouts: page, width, height, class_names, boxes (0 to 1), scores. Pictures over 35 hundredths of the frame, or
    fewer than three text blocks, keep all regions.
    """
    each = layouts.select("page", "width", "height", F.posexplode(F.arrays_zip("class_names", "boxes", "scores")).alias("no", "b"))
    px = lambda i, side: F.least(F.greatest(F.round(F.col("b.boxes")[i] * F.col(side)), F.lit(0)), F.col(side)).cast("int")
    each = each.select("page", "no", F.col("b.class_names").alias("kind"), F.col("b.scores").alias("score"), px(0, "width").alias("x1"), px(1, "height").alias("y1"), px(2, "width").alias("x2"), px(3, "height").alias("y2"), (F.col("width") * F.col("height")).alias("frame"))
    each = each.where((F.col("x2") - F.col("x1") > least) & (F.col("y2") - F.col("y1") > least))
    text_kind = ~F.lower("kind").isin("figure", "picture", "image", "table_image")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    pages = each.groupBy("page").agg(F.count_if(text_kind).alias("blocks"), F.least(F.lit(1.0), F.sum(F.when(~text_kind, area / F.col("frame")).otherwise(0.0))).alias("pictures"))
    pages = pages.withColumn("whole", (F.col("pictures") > 0.35) | (F.col("blocks") < 3))
    return each.where(text_kind).drop("frame"), pages
