"""Decisions on detector candidates as Columns: logits, softmax with an unknown option, gates, verdicts, log links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import plate_lenient, plate_strict, softmax

# Fixed values of the typed decision. A band is (upper bound, what counts below it), the last one what counts beyond.
UNKNOWN_BASE = -1.2
BLUR_BANDS = ((15.0, 2.0), (45.0, 0.9), (None, 0.05))
TOO_DARK, TOO_BRIGHT, EXPOSURE = 20.0, 240.0, 1.4
FLAT_BELOW, FLATNESS = 12.0, 1.2
SCENE_TEMPERATURE, CROP_TEMPERATURE = 0.9, 0.85
ABSTAIN_ABOVE = 0.4
DOCUMENT_PLATE, DOCUMENT_PRINT = -5.0, 3.5
DOCUMENT_FLOOR, PLATE_FLOOR, FACE_SURE = 0.80, 0.45, 0.60
PLATE_ASPECT, PLATE_SIDES = (0.8, 8.0), (8, 4)
DEFAULT_UNKNOWN = 0.05
OPTIONS = {
    "scene": ("Document / ID Card", "Street / Vehicle Scene"),
    "plate": ("License Plate", "Printed Text", "Graphic / Barcode"),
    "face": ("Human Face / Portrait", "Illustration / Statue", "Background / Icon"),
    "text": ("Identity Field", "Boilerplate Text", "OCR Noise"),
}


def _if(condition: Column, value: float, other: float = 0.0) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(other))


def _banded(c: Column, bands: tuple) -> Column:
    out = F.lit(bands[-1][1])
    for bound, value in reversed(bands[:-1]):
        out = F.when(c < bound, F.lit(value)).otherwise(out)
    return out


def _within(c: Column, near: tuple[float, float, float], wide: tuple[float, float, float] | None, other: float) -> Column:
    """A score by the narrowest range (low, high, score) that holds c."""
    out = F.lit(other) if wide is None else _if(c.between(*wide[:2]), wide[2], other)
    return F.when(c.between(*near[:2]), F.lit(near[2])).otherwise(out)


def unknown_logit(sharpness: Column, brightness: Column, contrast: Column) -> Column:
    """Blurred, badly exposed and flat crops make a decision less certain."""
    exposed = _if((brightness < TOO_DARK) | (brightness > TOO_BRIGHT), EXPOSURE)
    return F.lit(UNKNOWN_BASE) + _banded(sharpness, BLUR_BANDS) + exposed + _if(contrast < FLAT_BELOW, FLATNESS)


def scene(white: Column, gradient: Column, saturation: Column, hue: Column, contrast: Column, unknown: Column) -> list[Column]:
    """document, street, unknown: probabilities."""
    doc = white * 4.2 + F.least(gradient, F.lit(3.0)) * 0.8 - saturation * 4.0 + _if(contrast > 40, 1.0)
    street = saturation * 5.0 + hue * 2.5 - white * 3.5 + _if(contrast > 30, 1.2)
    return softmax([doc, street, unknown], SCENE_TEMPERATURE)


def plate_logits(aspect: Column, glyphs: Column, contrast: Column, edges: Column, in_document: Column) -> list[Column]:
    """plate, printed text, graphic; in a document's scene printed text is likelier and a plate is not."""
    shape = _within(aspect, (2.0, 5.5, 3.5), (1.5, 6.5, 1.5), -2.5)
    signs = F.when(glyphs.between(3, 10), 2.5).when(glyphs > 15, -0.5).otherwise(0.5)
    plate = shape + signs + _if(contrast > 35, 1.0, -1.0) + _if(in_document, DOCUMENT_PLATE)
    printed = _if((aspect < 1.8) | (glyphs > 10), 2.0, -1.0) + _if(contrast > 20, 1.5) + _if(in_document, DOCUMENT_PRINT)
    return [plate, printed, _if(edges > 2.8, 3.0, -1.5)]


def face_logits(aspect: Column, skin: Column, middle: Column, sharpness: Column, contrast: Column) -> list[Column]:
    """face, illustration, background; middle: deviation of the middle ninth."""
    shape = _within(aspect, (0.7, 1.4, 2.0), (0.5, 1.8, 0.5), -2.0)
    tone = F.when(skin.between(0.25, 0.85), 3.0).when(skin < 0.08, -1.0).otherwise(0.8)
    face = shape + tone + _if(middle > 20, 1.5, -0.5) + _if(sharpness > 40, 1.0, -0.5)
    drawn = _if((skin < 0.15) & (contrast > 30), 2.5, -1.0)
    return [face, drawn, _if((shape < -1.0) | (sharpness < 15) | (skin < 0.05), 3.0, -1.5)]


def text_logits(inked: Column, sharpness: Column, contrast: Column) -> list[Column]:
    """identity field, boilerplate, noise; inked: share of the crop's rows with ink."""
    field = _if(inked.between(0.25, 0.85) & (contrast > 30), 2.5) + _if(sharpness > 30, 1.5, -1.0)
    return [field, _if(contrast < 25, 1.5, -0.5), _if((sharpness < 15) | (inked > 0.9), 2.0, -1.0)]


def decision(kind: str, logits: list[Column], unknown: Column, empty: Column | None = None) -> Column:
    """choice, probabilities (in the order of the options), unknown_probability, abstained.

    The likeliest option is chosen, of equal ones the first. A crop without pixels is wholly unknown.
    """
    options = OPTIONS[kind]
    *p, u = softmax([*logits, unknown], SCENE_TEMPERATURE if kind == "scene" else CROP_TEMPERATURE)
    best = F.lit(options[-1])
    for k in range(len(p) - 2, -1, -1):
        best = F.when(F.greatest(*p[k:]) == p[k], F.lit(options[k])).otherwise(best)
    chosen = F.struct(best.alias("choice"), F.array(*p).alias("probabilities"), u.alias("unknown_probability"), (u > ABSTAIN_ABOVE).alias("abstained"))
    if empty is None:
        return chosen
    nothing = F.struct(F.lit(options[0]).alias("choice"), F.array(*(F.lit(0.0) for _ in p)).alias("probabilities"), F.lit(1.0).alias("unknown_probability"), F.lit(True).alias("abstained"))
    return F.when(F.coalesce(empty, F.lit(True)), nothing).otherwise(chosen)


def default_decision(options: Column) -> Column:
    """Options of no known kind are equally likely; none is chosen of an empty list."""
    n = F.size(options)
    return F.when(
        n > 0,
        F.struct(options[0].alias("choice"), F.transform(options, lambda _: (1 - F.lit(DEFAULT_UNKNOWN)) / n).alias("probabilities"), F.lit(DEFAULT_UNKNOWN).alias("unknown_probability"), F.lit(False).alias("abstained")),
    ).otherwise(F.struct(F.lit("unknown").alias("choice"), F.array().cast("array<double>").alias("probabilities"), F.lit(1.0).alias("unknown_probability"), F.lit(True).alias("abstained")))


def plate_candidates(boxes: DataFrame, floor: float = PLATE_FLOOR, in_document: Column | None = None) -> DataFrame:
    """Boxes (x1, y1, x2, y2, score) that can be plates: sure enough, more so in a document, large enough, and of a plate's shape."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    least = F.lit(max(floor, PLATE_FLOOR)) if in_document is None else F.when(in_document, max(floor, DOCUMENT_FLOOR)).otherwise(max(floor, PLATE_FLOOR))
    return boxes.where((F.col("score") >= least) & (w >= PLATE_SIDES[0]) & (h >= PLATE_SIDES[1]) & (w / h).between(*PLATE_ASPECT))


def plate_fate(verdict: Column, read: Column, in_document: Column, document_like: Column) -> Column:
    """kept, rejected or suppressed: what the verifier and the crop's text say together, one fate for a candidate.

    A null text was not read and says nothing. In a document's scene a candidate that fails is suppressed without a log entry.
    """
    fails = (verdict == "rejected") | ~F.coalesce(F.when(document_like | in_document, plate_strict(read)).otherwise(plate_lenient(read)), F.lit(True))
    return F.when(~fails, "kept").when(in_document, "suppressed").otherwise("rejected")


def suppressed_note(fates: DataFrame, key: str = "page") -> DataFrame:
    """key, suppressed: one information record for each page that has suppressed candidates."""
    return fates.groupBy(key).agg(F.count_if(F.col("fate") == "suppressed").alias("suppressed")).where("suppressed > 0")


def text_fate(score: Column, verdict: Column) -> Column:
    """Only text that was read uncertainly is verified; what the verifier rejects goes."""
    return F.when(F.coalesce(score, F.lit(1.0)) >= 0.5, "unverified").when(verdict == "rejected", "dropped").otherwise("verified")


def combined_score(span: Column, read: Column) -> Column:
    """A span's score and its box's confidence: three quarters stand, one quarter is the reading's."""
    return F.round(span * (0.75 + 0.25 * read), 2)


def assembled_log(*branches: DataFrame, key: str = "page") -> DataFrame:
    """key, no, action, entity, message: log branches (key, stage, ordinal, action, entity, message) as one numbered log."""
    from functools import reduce

    from pyspark.sql import Window

    log = reduce(DataFrame.unionByName, branches)
    return log.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("stage", "ordinal"))).select(key, "no", "action", "entity", "message")


def scene_gate(doc: Column, street: Column, white: Column) -> dict[str, Column]:
    """Text is skipped in streets; the kind is set beyond 0.8 and below 0.2; white pages look like documents."""
    return {
        "skip_text": street > doc,
        "kind": F.when(doc >= 0.8, "document").when(doc < 0.2, "street").otherwise("uncertain"),
        "document_like": white >= 0.35,
    }


def keep_face(verdict: Column, score: Column) -> Column:
    """A rejected face stays where the detector was sure."""
    return (verdict != "rejected") | (score >= FACE_SURE)


def abstained(unknown: Column) -> Column:
    return unknown > ABSTAIN_ABOVE


def links(entries: DataFrame, detections: DataFrame) -> DataFrame:
    """entry, id: a log entry's detection by its reference, else by its box.

    entries: page, entry, ref, x1, y1, x2, y2; detections: page, id, ref, x1, y1, x2, y2.
    """
    by_ref = detections.where("ref IS NOT NULL").groupBy("page", "ref").agg(F.min("id").alias("id_ref"))
    box = ["page", "x1", "y1", "x2", "y2"]
    by_box = detections.groupBy(*box).agg(F.min("id").alias("id_box"))
    return entries.join(by_ref, ["page", "ref"], "left").join(by_box, box, "left").select("page", "entry", F.coalesce("id_ref", "id_box").alias("id"))
