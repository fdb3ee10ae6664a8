"""Queries of whole pages: readings of frames and crops to personal data as polygons, and value rows under headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, reading
from ..sources import ocr
from . import tables
from .catalog import query

#: For each order a page: an address that a frame and an enlarged crop of it read, a date header over a day and a year that stand
#: near each other or far apart, a smudge, and a last line. Every third page was straightened before it was read.
_KEYS = """SELECT o_orderkey AS page, concat('u', CAST(o_orderkey AS VARCHAR(20)), '@acme-post.com') AS mail, concat('19', CAST(o_orderkey % 89 + 10 AS VARCHAR(9))) AS born,
  CAST(130 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 200 + o_orderkey % 300 END AS INT) AS far, o_orderkey % 3 = 0 AS straightened, o_orderkey % 5 <> 0 AS dated FROM orders"""
_BOX = "array(array({0}, {1}), array({2}, {1}), array({2}, {3}), array({0}, {3}))"
_MAIL_END = "110 + 10 * length(mail)"
_FOUND = f"""SELECT page, 'EMAIL' AS entity, 'Email' AS label, mail AS text, 110 AS bx, 41 AS ty, {_MAIL_END} AS ex, 61 AS ey, 0.95 AS evidence, 0.8 AS sure, straightened FROM k
  UNION ALL SELECT page, 'DATE_OF_BIRTH', 'Date of Birth', '14 JAN ' || born, 40, 140, far + 60, 162, 0.9, 0.6, straightened FROM k WHERE dated"""


@query(f"""WITH k AS ({_KEYS}), f AS ({_FOUND}), g AS (SELECT *, CAST(round_even(bx - 0.005 * (ex - bx), 0) AS INT) AS x1, CAST(round_even(ty - 0.02 * (ey - ty), 0) AS INT) AS y1,
  CAST(round_even(ex + 0.005 * (ex - bx), 0) AS INT) AS x2, CAST(round_even(ey + 0.02 * (ey - ty), 0) AS INT) AS y2, CASE WHEN straightened THEN 5 ELSE 0 END AS mx, CASE WHEN straightened THEN -3 ELSE 0 END AS my FROM f)
  SELECT page, entity, label, text, x1 + mx AS x1, y1 + my AS y1, x2 + mx AS x2, y2 + my AS y2, CAST(round(evidence * (0.75 + 0.25 * sure), 2) AS DOUBLE) AS score FROM g""")
def page_detections(spark, sf_dir):
    """From readings to polygons: floor, crops, repeated readings, split dates, lines, value rows, spans, and the way back."""
    k = tables.over(spark, sf_dir, "orders", _KEYS)
    at = lambda *c: F.expr(f"CAST({_BOX.format(*c)} AS array<array<double>>)")
    read = lambda text, conf, *c: F.struct(at(*c).alias("poly"), text.alias("text"), F.lit(conf).alias("conf"))
    frame = k.select("page", F.explode(F.array(
        read(F.lit("Mail:"), 0.9, 40, 40, 100, 60), read(F.col("mail"), 0.8, 110, 41, _MAIL_END, 61), read(F.when(F.col("dated"), "Date of birth").otherwise("Lot of birds"), 0.9, 40, 100, 180, 120),
        read(F.lit("14 JAN"), 0.9, 40, 140, 110, 160), read(F.when(F.col("dated"), F.col("born")).otherwise("x"), 0.6, "far", 142, "far + 60", 162), read(F.lit("smudge"), 0.1, 400, 400, 460, 420), read(F.lit("the end"), 0.9, 40, 300, 120, 320),
    )).alias("r")).select("page", "r.*")
    crop = F.struct(F.lit(100.0).alias("dx"), F.lit(30.0).alias("dy"), F.lit(2.0).alias("scale"), F.lit(None).cast("array<array<double>>").alias("matrix"))
    crops = k.select("page", at("20", "22", f"({_MAIL_END} - 100) * 2", "62").alias("poly"), F.col("mail").alias("text"), F.lit(0.7).alias("conf"), crop.alias("crop"))
    matrix = F.when(F.col("straightened"), F.expr("CAST(array(array(1, 0, 5), array(0, 1, -3)) AS array<array<double>>)"))
    frames = k.select("page", F.lit(1000).alias("width"), F.lit(700).alias("height"), matrix.alias("matrix"))
    return reading.detections(ocr.united(frame, crops), frames).select("page", "entity", "label", "text", "x1", "y1", "x2", "y2", "score")


#: Date headers and others over rows of one to three lines on a baseline, a lower line, and a row that is no date.
_ROWS = """SELECT o_orderkey AS page, CASE o_orderkey % 3 WHEN 0 THEN 'Date of issue / Date de délivrance' WHEN 1 THEN 'Fecha' ELSE 'Nationality / Sexe' END AS head, CAST(o_orderkey % 7 AS INT) AS drop,
  CASE o_orderkey % 2 WHEN 0 THEN 'JAN /JAN' ELSE 'of the' END AS mid FROM orders"""


@query(f"""WITH r AS ({_ROWS}), j AS (SELECT *, page % 3 = 0 AND page % 2 = 0 AND drop <= 5 AS joins FROM r)
  SELECT page, 0 AS line, head AS text, 40 AS x1, 90 AS x2 FROM j UNION ALL SELECT page, 1, CASE WHEN joins THEN '14 ' || mid || ' 1999' ELSE '14' END, 40, CASE WHEN joins THEN 540 ELSE 60 END FROM j
  UNION ALL SELECT page, 2, mid, 200, 300 FROM j WHERE NOT joins UNION ALL SELECT page, 3, '1999', 500, 540 FROM j WHERE NOT joins UNION ALL SELECT page, 4, 'below', 40, 90 FROM j""")
def date_value_rows(spark, sf_dir):
    """Islands of lines on the baseline under a header, by what ends them and what they say."""
    r = tables.over(spark, sf_dir, "orders", _ROWS).selectExpr("page", """stack(5, 0L, head, 40, 100, 90, 108, 1L, '14', 40, 120, 60, 128, 2L, mid, 200, 120, 300, 128, 3L, '1999', 500, 120 + drop, 540, 128 + drop,
      4L, 'below', 40, 150, 90, 158) AS (line, text, x1, y1, x2, y2)""")
    for c in geometry.CORNERS:
        r = r.withColumn(c, F.col(c).cast("double"))
    rows = r.withColumn("id", F.col("line")).withColumn("no", F.lit(0).cast("long")).withColumn("conf", F.lit(0.9)).withColumn("poly", geometry.quad(*map(F.col, geometry.CORNERS)))
    return reading.value_rows(rows).select("page", F.col("line").cast("int").alias("line"), "text", F.col("x1").cast("int").alias("x1"), F.col("x2").cast("int").alias("x2"))
