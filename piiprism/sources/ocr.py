"""Readings of OCR engines in one form: page, poly, text, conf. Nested results are flattened with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.geometry import dealt


def from_lists(results: DataFrame) -> DataFrame:
    """page and parallel lists rec_polys, rec_texts, rec_scores; blank texts go."""
    rows = results.select("page", F.explode(F.arrays_zip("rec_polys", "rec_texts", "rec_scores")).alias("r"))
    return rows.select("page", F.col("r.rec_polys").alias("poly"), F.col("r.rec_texts").alias("text"), F.col("r.rec_scores").cast("double").alias("conf")).where("trim(text) <> ''")


def from_pairs(results: DataFrame) -> DataFrame:
    """page and lines: array<struct<poly, read: struct<text, conf>>>."""
    rows = results.select("page", F.explode("lines").alias("r"))
    return rows.select("page", F.col("r.poly").alias("poly"), F.col("r.read.text").alias("text"), F.col("r.read.conf").cast("double").alias("conf")).where("trim(text) <> ''")


def from_words(pages: DataFrame) -> DataFrame:
    """page, width, height, blocks of lines of words (value, confidence, geometry of 0 to 1) as readings in pixels."""
    words = (
        pages.select("page", "width", "height", F.explode("blocks").alias("b"))
        .select("page", "width", "height", F.explode("b.lines").alias("l"))
        .select("page", "width", "height", F.explode("l.words").alias("w"))
    )
    x = lambda i: F.col("w.geometry")[i][0] * F.col("width")
    y = lambda i: F.col("w.geometry")[i][1] * F.col("height")
    poly = F.array(F.array(x(0), y(0)), F.array(x(1), y(0)), F.array(x(1), y(1)), F.array(x(0), y(1)))
    return words.select("page", poly.alias("poly"), F.col("w.value").alias("text"), F.col("w.confidence").cast("double").alias("conf")).where("trim(text) <> ''")


def confident(readings: DataFrame, floor: float = 0.2, long_code: int = 15) -> DataFrame:
    """Readings at the floor or above; long codes pass below it."""
    code = F.length(F.regexp_replace("text", r"[^\p{L}\p{Nd}<]", "")) >= long_code
    return readings.where((F.col("conf") >= floor) | code)


def shifted(readings: DataFrame, dx: float, dy: float) -> DataFrame:
    """Readings of a crop in the coordinates of the frame."""
    return readings.withColumn("poly", F.transform("poly", lambda p: F.array(p[0] + dx, p[1] + dy)))


def framed(readings: DataFrame) -> DataFrame:
    """Readings (page, id, poly, text, conf) in the frame's coordinates, from readings with the frame of their crop.

    crop: struct<dx, dy, scale, matrix>: where the crop begins in the frame, how much it was enlarged before it was read,
    and null or a 2 x 3 matrix that takes the frame to it. A point is divided by the scale, then moved; a matrix is undone first.
    """
    c, m = F.col("crop"), F.col("crop.matrix")
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]

    def at(p):
        u, v = p[0] - m[0][2], p[1] - m[1][2]
        x = F.when(m.isNull(), p[0]).otherwise((m[1][1] * u - m[0][1] * v) / det)
        y = F.when(m.isNull(), p[1]).otherwise((m[0][0] * v - m[1][0] * u) / det)
        return F.array(x / F.coalesce(c["scale"], F.lit(1.0)) + F.coalesce(c["dx"], F.lit(0.0)), y / F.coalesce(c["scale"], F.lit(1.0)) + F.coalesce(c["dy"], F.lit(0.0)))

    return readings.withColumn("poly", F.transform("poly", at)).drop("crop")


def united(*reads: DataFrame) -> DataFrame:
    """All readings of pages, of whole frames and of crops of them, in frame coordinates; ids are new ones by page.

    Each: page, poly, text, conf, and crop where it is of one. Their order, and the place in each, is that of the ids.
    """
    from functools import reduce

    from pyspark.sql import Window

    def one(k: int, r: DataFrame) -> DataFrame:
        return (framed(r) if "crop" in r.columns else r).select("page", F.lit(k).alias("read"), F.col("poly").cast("array<array<double>>").alias("poly"), "text", F.col("conf").cast("double").alias("conf"))

    rows = dealt(reduce(DataFrame.unionByName, (one(k, r) for k, r in enumerate(reads))))
    w = Window.partitionBy("page").orderBy("read", F.element_at("poly", 1)[1], F.element_at("poly", 1)[0], "text", "conf")
    return rows.withColumn("id", F.row_number().over(w).cast("long")).select("page", "id", "poly", "text", "conf")
