"""Queries of checks, repairs, names, zones, image statistics and narratives on rows planted over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, text
from ..functions.vocabulary import ENTITIES
from ..operators import geometry, govern, lines, recognize
from ..sources import images
from . import tables
from .catalog import _WEIGHT, anchors, query


def _planted(spark, sf_dir, sql: str, name: str = "orders"):
    return tables.over(spark, sf_dir, name, sql)


_PHONES = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('+49', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN concat('0', CAST(o_orderkey AS VARCHAR(20)), ' 77')
  WHEN 2 THEN concat('10.', CAST(o_orderkey % 300 AS VARCHAR(20)), '.0.7') WHEN 3 THEN lpad(CAST(o_orderkey AS VARCHAR(20)), 9 + CAST(o_orderkey % 4 AS INT), '4') WHEN 4 THEN '  ' ELSE concat('-', CAST(o_orderkey AS VARCHAR(20))) END AS t FROM orders"""


@query(f"SELECT o_orderkey, t, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN o_orderkey % 300 > 255 WHEN 3 THEN 9 + o_orderkey % 4 >= 11 ELSE length(t) >= 12 AND t <> '  ' END AS plausible FROM ({_PHONES}) p")
def phone_guard(spark, sf_dir):
    """Numbers as they are written, by whether they can be telephone numbers."""
    return _planted(spark, sf_dir, _PHONES).select("o_orderkey", "t", checks.plausible_phone(F.col("t")).alias("plausible"))


_YEARS = """SELECT o_orderkey, concat(CAST(o_orderkey % 28 + 1 AS VARCHAR(9)), CASE o_orderkey % 4 WHEN 0 THEN ' JAN ' WHEN 1 THEN ' FEV/FEB ' WHEN 2 THEN ' Mar /Mar ' ELSE ' LOT ' END) AS head,
  CASE o_orderkey % 5 WHEN 0 THEN 'I9' WHEN 1 THEN '2O1B' WHEN 2 THEN 'Z0ls' WHEN 3 THEN '19|S' ELSE '20S' END AS tail FROM orders"""


@query(f"SELECT o_orderkey, concat(head, CASE WHEN o_orderkey % 4 = 3 OR o_orderkey % 5 = 4 THEN tail ELSE translate(tail, 'Il|OoSsZzB', '1110055228') END) AS repaired FROM ({_YEARS}) y")
def year_repairs(spark, sf_dir):
    """Letters in the years of dates; other words than months leave a line as it is."""
    return _planted(spark, sf_dir, _YEARS).select("o_orderkey", text.repair_year(F.concat("head", "tail")).alias("repaired"))


_TITLES = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Jane Falk' WHEN 1 THEN 'Manager' ELSE 'Max  Moor' END AS name,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Manager' WHEN 2 THEN ' Sales Director,' WHEN 3 THEN ' Hill Team' ELSE ' The Office.' END AS tail FROM customer"""


@query(f"SELECT c_custkey, concat(replace(name, '  ', ' '), CASE WHEN c_custkey % 5 = 3 THEN ' Hill' ELSE '' END) AS value FROM ({_TITLES}) t")
def trailing_words(spark, sf_dir):
    """Names without the words after them that are no names."""
    return _planted(spark, sf_dir, _TITLES, "customer").select("c_custkey", lines.without_trailing(F.concat("name", "tail")).alias("value"))


_ZONE_LINES = """SELECT l_orderkey AS page, CAST(l_linenumber * 100 AS INT) AS start, CAST(l_linenumber * 100 + 20 AS INT) AS "end", CAST(l_suppkey % 11 AS DOUBLE) / 10.0 AS cx, CAST(l_partkey % 11 AS DOUBLE) / 10.0 AS cy,
  CASE l_partkey % 9 WHEN 0 THEN 'Passeport / PASSPORT' WHEN 1 THEN 'total amount' WHEN 2 THEN concat('No 12 ', lpad(CAST(l_suppkey AS VARCHAR(20)), 8, '7')) ELSE lpad(CAST(l_suppkey AS VARCHAR(20)), 7 + CAST(l_partkey % 5 AS INT), '7') END AS line FROM lineitem"""
_ZONE_SPANS = """SELECT l_orderkey AS page, CAST(l_linenumber * 100 - 5 AS INT) AS start, CAST(l_linenumber * 100 + 15 + l_suppkey % 10 AS INT) AS "end", CASE WHEN l_partkey % 13 = 0 THEN 'MRZ' ELSE 'PHONE' END AS entity FROM lineitem WHERE l_suppkey % 3 = 0"""


@query(f"""WITH l AS ({_ZONE_LINES}), s AS ({_ZONE_SPANS}) SELECT page, start, "end", 'ID_NUMBER' AS entity FROM l
  WHERE regexp_full_match(line, '[0-9]{{8,10}}') AND cx > 0.5 AND cy < 0.55 AND (page IN (SELECT page FROM s WHERE entity = 'MRZ') OR page IN (SELECT page FROM l WHERE line LIKE 'Passeport%'))
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.page = l.page AND s.start <= l.start AND l."end" <= s."end")""")
def passport_zone(spark, sf_dir):
    """Numbers in the upper right of passport pages that no span holds yet."""
    return lines.passport_numbers(tables.derived(spark, sf_dir, _ZONE_LINES), tables.derived(spark, sf_dir, _ZONE_SPANS))


_PIXELS = "SELECT image, x, y, (image * 31 + x * x * 40 + y * 17) % 256 AS r, (image * 17 + x * 50 + y * y * 30) % 256 AS g, (image * 7 + x * y * 20) % 256 AS b FROM (SELECT image, CAST(i % 6 AS INT) AS x, CAST(floor(i / 6) AS INT) AS y FROM {})"
_LAP = "coalesce(lag(gray) OVER {0}, lead(gray) OVER {0}) + coalesce(lead(gray) OVER {0}, lag(gray) OVER {0})"


@query(f"""WITH p AS ({_PIXELS.format("(SELECT o_orderkey AS image, unnest(range(30)) AS i FROM orders)")}), g AS (SELECT *, (r * 4899 + g * 9617 + b * 1868 + 8192) // 16384 AS gray FROM p),
  l AS (SELECT *, {_LAP.format("(PARTITION BY image, y ORDER BY x)")} + {_LAP.format("(PARTITION BY image, x ORDER BY y)")} - 4 * gray AS lap FROM g)
  SELECT image, round(avg(gray), 4) AS luminance, round(stddev_pop(gray), 4) AS contrast, round(var_pop(lap), 2) AS sharpness, round(avg(CASE WHEN gray > 200 THEN 1 ELSE 0 END), 4) AS white, round(avg(CASE WHEN gray > 185 THEN 1 ELSE 0 END), 4) AS bright,
  round(avg(CASE WHEN floor((r - gray) * CAST(0.713 AS DOUBLE) + 128.5) BETWEEN 133 AND 173 AND floor((b - gray) * CAST(0.564 AS DOUBLE) + 128.5) BETWEEN 77 AND 127 THEN 1 ELSE 0 END), 4) AS skin FROM l GROUP BY image""")
def image_statistics(spark, sf_dir):
    """Features of an image of 30 pixels for each order."""
    px = _planted(spark, sf_dir, _PIXELS.format("(SELECT o_orderkey AS image, explode(sequence(0, 29)) AS i FROM orders)"))
    s = images.statistics(px)
    return s.select("image", *(F.round(c, 2 if c == "sharpness" else 4).alias(c) for c in s.columns if c != "image"))


_LABEL = "CASE WHEN type = 'face' THEN 'Face' WHEN type = 'plate' THEN 'License Plate' " + " ".join(f"WHEN entity = '{e}' THEN '{label}'" for e, (label, _) in ENTITIES.items()) + " ELSE 'Sensitive Text' END"


@query(f"""WITH d AS (SELECT page, id, masked OR page % 4 = 0 AS masked, type, {_LABEL} AS label, {_WEIGHT} AS w FROM ({tables.DETECTIONS}) d),
  o AS (SELECT page, label, max(w) AS w, min(id) AS id FROM (SELECT *, max(w) OVER (PARTITION BY page, label) AS top FROM d WHERE NOT masked) WHERE w = top GROUP BY page, label),
  r AS (SELECT page, label, row_number() OVER (PARTITION BY page ORDER BY w DESC, id) AS r FROM o), t AS (SELECT page, string_agg(label, ', ' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY page),
  n AS (SELECT page, count(*) AS n, count(*) FILTER (masked) AS m, bool_or(masked AND type IN ('face', 'plate')) AS pixels FROM d GROUP BY page)
  SELECT page, CASE WHEN n = m THEN 'All ' || n || ' identifier(s) are covered; ' || CASE WHEN pixels THEN 'the DP-Pix noise floor (ε = 0.5) leaves 2.0% residual leakage.' ELSE 'every mask is zero-entropy (no residual leakage).' END
  ELSE m || ' of ' || n || ' identifier(s) masked; ' || (n - m) || ' still exposed (' || top || ').' END AS narrative FROM n LEFT JOIN t USING (page)""")
def risk_narrative(spark, sf_dir):
    """What a page's masks cover, in a sentence; every fourth page is masked throughout."""
    d = tables.derived(spark, sf_dir, tables.DETECTIONS)
    return govern.narrative(d.withColumn("masked", F.col("masked") | (F.col("page") % 4 == 0)), "strict")


def _check(digits: str, n: int) -> str:
    """The check digit of n ASCII digits, as SQL."""
    return "(" + " + ".join(f"CAST(substr({digits}, {i + 1}, 1) AS INT) * {(7, 3, 1)[i % 3]}" for i in range(n)) + ") % 10"


_DATA = f"""SELECT o_orderkey, concat(number, 'UTO', birth, 'M', expiry, '<<<<<<<<<<<<<<<', CAST(({_check("concat(number, birth, expiry)", 24)} + o_orderkey % 4) % 10 AS VARCHAR(9))) AS line FROM (
  SELECT o_orderkey, concat(number, CAST({_check("number", 9)} AS VARCHAR(9))) AS number, concat(birth, CAST({_check("birth", 6)} AS VARCHAR(9))) AS birth, concat(expiry, CAST(({_check("expiry", 6)} + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR(9))) AS expiry
  FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR(20)), 9, '8') AS number, lpad(CAST(o_custkey AS VARCHAR(20)), 6, '7') AS birth, lpad(CAST(o_orderkey % 999983 AS VARCHAR(20)), 6, '2') AS expiry FROM orders) a) b"""


@query(f"SELECT o_orderkey, line, o_orderkey % 4 = 0 AND o_orderkey % 7 <> 0 AS valid FROM ({_DATA}) d")
def mrz_check_digits(spark, sf_dir):
    """Data lines with right and wrong check digits of a field and of the whole, one for each order."""
    return _planted(spark, sf_dir, _DATA).select("o_orderkey", "line", checks.mrz_valid(F.col("line")).alias("valid"))


_READ = """SELECT o_orderkey, concat(CAST(o_orderkey AS VARCHAR(20)), CASE o_orderkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN '-S' WHEN 2 THEN 'l.' ELSE 'x' END, CAST(o_custkey AS VARCHAR(20)), CASE WHEN o_custkey % 2 = 0 THEN ' Bill' ELSE '' END) AS t FROM orders"""


@query(f"SELECT o_orderkey, replace(replace(replace(t, 'O', '0'), '-S', '-5'), 'l.', '1.') AS view FROM ({_READ}) r")
def numeric_view(spark, sf_dir):
    """What OCR read for digits, between digits only."""
    return _planted(spark, sf_dir, _READ).select("o_orderkey", text.numeric_view(F.col("t")).alias("view"))


_COUNTRIES = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('GB', lpad(CAST(o_custkey % 97 AS VARCHAR(9)), 2, '0'), ' WEST ', lpad(CAST(o_orderkey AS VARCHAR(20)), 14, '0'))
  WHEN 1 THEN concat('de', lpad(CAST(o_custkey % 97 AS VARCHAR(9)), 2, '0'), lpad(CAST(o_orderkey AS VARCHAR(20)), 18, '1')) ELSE concat('FR1', CAST(o_orderkey AS VARCHAR(20))) END AS t FROM orders"""


@query(f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (CAST(concat('32142829', lpad(CAST(o_orderkey AS VARCHAR), 14, '0'), '1611', lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0')) AS HUGEINT)) % 97 = 1
  WHEN 1 THEN (CAST(concat(lpad(CAST(o_orderkey AS VARCHAR), 18, '1'), '1314', lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0')) AS HUGEINT)) % 97 = 1 ELSE false END AS valid FROM orders""")
def iban_mod97(spark, sf_dir):
    """Account numbers of two countries with all check numbers, by one division of the whole number in SQL; short ones are none."""
    return _planted(spark, sf_dir, _COUNTRIES).select("o_orderkey", checks.iban(F.col("t")).alias("valid"))


_LINES = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('p < ', CAST(o_custkey AS VARCHAR(20)), ' u t o') WHEN 1 THEN concat('(', CAST(o_custkey AS VARCHAR(20)), ']') WHEN 2 THEN concat(CAST(o_custkey AS VARCHAR(20)), 'KKK') ELSE concat('7K', CAST(o_custkey AS VARCHAR(20)), 'L<') END AS line FROM orders"""


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'P<' || o_custkey || 'UTO' WHEN 1 THEN '<' || o_custkey || '<' WHEN 2 THEN o_custkey || '<<<' ELSE '7K' || o_custkey || 'L<' END AS compact FROM orders")
def mrz_compact(spark, sf_dir):
    """Lines of a zone as they were read, without spaces and with fillers for what stands for them."""
    return _planted(spark, sf_dir, _LINES).select("o_orderkey", text.mrz_compact(F.col("line")).alias("compact"))


_HEADED = """SELECT c_custkey AS doc_id, CASE c_custkey % 5 WHEN 0 THEN 'Surname / Nom / Apellidos' WHEN 1 THEN 'Passport No. / No. du Passeport' WHEN 2 THEN 'Date of birth / Date de naissance' WHEN 3 THEN 'Date of issue' ELSE 'Department: Human' END AS head,
  CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS blank, CASE c_custkey % 3 WHEN 0 THEN 'DE LA PAZ' WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR(20)), 9, '9') ELSE '07 Aug 1999' END AS value FROM customer"""


@query(f"""SELECT * FROM (SELECT doc_id, CAST(length(head) + 1 + blank AS INTEGER) AS start, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN 'PERSON' WHEN doc_id % 5 = 1 AND doc_id % 3 <> 0 THEN 'ID_NUMBER' WHEN doc_id % 5 = 2 AND doc_id % 3 = 2 THEN 'DATE_OF_BIRTH'
  WHEN doc_id % 5 = 3 AND doc_id % 3 = 2 THEN 'DATE' END AS entity, value FROM ({_HEADED}) h) WHERE entity IS NOT NULL""")
def header_value_pairs(spark, sf_dir):
    """Headers over values of their own and of other kinds, some with a blank line between."""
    docs = _planted(spark, sf_dir, _HEADED, "customer").select("doc_id", F.concat("head", F.lit("\n"), F.when(F.col("blank") == 1, "\n").otherwise(""), "value", F.lit("\nthe end")).alias("text"))
    return lines.header_values(lines.lines(docs)).select("doc_id", F.col("start").cast("int").alias("start"), "entity", "value")


_BLOCKS = """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Hiring Manager' WHEN 2 THEN concat('Max O', chr(39), 'Neil-Smith') ELSE 'jane doe' END AS name,
  CAST(c_custkey % 3 AS INT) AS between, CASE c_custkey % 5 WHEN 0 THEN 'no contact' WHEN 1 THEN '+1 415 555 1234' ELSE concat('u', CAST(c_custkey AS VARCHAR(20)), '@acme.com') END AS contact FROM customer"""


@query(f"SELECT doc_id, 0 AS line_no, name AS value FROM ({_BLOCKS}) b WHERE doc_id % 2 = 0 AND between < 2 AND doc_id % 5 <> 0")
def contact_block_names(spark, sf_dir):
    """Names and other lines at one to three lines from a contact, one with an apostrophe and a hyphen among them."""
    docs = _planted(spark, sf_dir, _BLOCKS, "customer").select("doc_id", F.concat("name", F.lit("\n"), F.expr("repeat('x\n', between)"), "contact").alias("text"))
    return lines.contact_names(lines.lines(docs), anchors(docs)).select("doc_id", "line_no", "value")


_LETTERS = "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Jane Falk' ELSE 'Max Moor' END AS name, CAST(c_custkey % 4 AS INT) AS more FROM customer"


@query(f"SELECT doc_id, name, 1 + more AS n FROM ({_LETTERS}) l")
def name_coreference(spark, sf_dir):
    """The names of letters' salutations, counted in the whole letters."""
    docs = _planted(spark, sf_dir, _LETTERS, "customer").select("doc_id", F.concat(F.lit("Dear "), "name", F.lit(", we write. "), F.expr("repeat(concat('so ', name, ' said; '), more)"), F.lit("Jane sat.")).alias("text"))
    names = recognize.exploded(docs, ["salutation"]).select("doc_id", "value")
    return lines.coreference(docs, names).select("doc_id", "name", F.col("n").cast("int").alias("n"))


_PRINTED = "concat('14 ', CASE o_orderkey % 4 WHEN 0 THEN 'JAN /JANV' WHEN 1 THEN 'dec' WHEN 2 THEN 'Lot' ELSE 'Aout' END, ' ', CAST(1950 + o_orderkey % 50 AS VARCHAR(9)))"


@query(f"""WITH z AS (SELECT d.o_orderkey, d.line, o_custkey, regexp_replace(d.line, '[^0-9]', '', 'g') AS digits, CASE d.o_orderkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '12' WHEN 2 THEN CAST(50 + d.o_orderkey % 50 AS VARCHAR) ELSE '08' END AS month, CAST(50 + d.o_orderkey % 50 AS VARCHAR) AS year
    FROM ({_DATA}) d JOIN orders o ON o.o_orderkey = d.o_orderkey),
  f AS (SELECT o_orderkey AS page, 3 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS compared,
    2 + CASE WHEN contains(digits, month) AND contains(digits, year) THEN 1 ELSE 0 END AS matched, o_orderkey % 4 = 0 AND o_orderkey % 7 <> 0 AS valid FROM z WHERE o_orderkey % 11 <> 0),
  c AS (SELECT *, round(CASE WHEN valid THEN 0.994::DOUBLE * matched / compared ELSE least(0.994::DOUBLE * matched / compared, 0.55::DOUBLE) END, 3) AS consistency FROM f)
  SELECT *, CASE WHEN consistency >= 0.9 THEN 'APPROVED' ELSE 'REVIEW' END AS verdict FROM c""")
def mrz_cross_zone(spark, sf_dir):
    """Printed fields against the machine-readable zones of their pages: numbers, names and dates that agree, some that don't."""
    zones = _planted(spark, sf_dir, _DATA).select(F.col("o_orderkey").alias("page"), text.mrz_compact(F.col("line")).alias("compact"))
    fields = _planted(spark, sf_dir, f"""SELECT o_orderkey AS page, stack(5, 'ID_NUMBER', lpad(CAST(o_orderkey AS STRING), 9, '8'), 'DATE', {_PRINTED}, 'PERSON', 'Uto',
      'ID_NUMBER', if(o_orderkey % 3 = 0, 'X-1234567', ''), 'PERSON', if(o_orderkey % 5 = 0, 'Nobody', '')) AS (entity, value) FROM orders WHERE o_orderkey % 11 <> 0""")
    out = lines.cross_zone(fields, zones).withColumnRenamed("check", "valid")
    return out.withColumn("compared", F.col("compared").cast("int")).withColumn("matched", F.col("matched").cast("int"))


_DATE_BOXES = """SELECT o_orderkey AS page, CASE WHEN o_orderkey % 2 = 0 THEN '14 JAN /JAN' ELSE '10 USD /EUR' END AS head, CASE o_orderkey % 3 WHEN 0 THEN 'I3' WHEN 1 THEN '20' ELSE 'x9' END AS year, CAST(o_orderkey % 200 AS INT) AS gap FROM orders"""


@query(f"""WITH b AS (SELECT *, page % 2 = 0 AND page % 3 <> 2 AND gap <= 120 AS joins FROM ({_DATE_BOXES}) d) SELECT page, 1 AS id, CASE WHEN joins THEN head || ' ' || replace(year, 'I', '1') ELSE head END AS text, 30 AS x1, CASE WHEN joins THEN 250 + gap ELSE 200 END AS x2 FROM b
  UNION ALL SELECT page, 2, year, 200 + gap, 250 + gap FROM b WHERE NOT joins""")
def date_stitch(spark, sf_dir):
    """Days and months, other pairs of words, and years at growing distances."""
    boxes = _planted(spark, sf_dir, _DATE_BOXES).selectExpr("page", "stack(2, 1, head, 30, 10, 200, 30, 2, year, 200 + gap, 12, 250 + gap, 30) AS (id, text, x1, y1, x2, y2)")
    return geometry.stitched_dates(boxes).select("page", "id", "text", "x1", "x2")


@query("""WITH o AS (SELECT o_orderkey AS page, CAST(o_orderkey % 50 AS INT) AS w, CAST(o_orderkey % 251 AS INT) AS h, o_orderkey % 2 = 0 AS third FROM orders),
  b AS (SELECT page, 'Text' AS kind, 50 AS x1, 45 AS y1, 700 AS x2, 75 AS y2, w, h, third FROM o UNION ALL SELECT page, 'Title', 50, 130, 50 + w, 150, w, h, third FROM o WHERE w > 10 UNION ALL SELECT page, 'List', 100, 300, 200, 350, w, h, third FROM o WHERE third)
  SELECT page, kind, x1, y1, x2, y2, h > 175 OR w <= 10 OR NOT third AS whole FROM b""")
def layout_blocks(spark, sf_dir):
    """Regions of a page for each order, with pictures and titles of all sizes."""
    layouts = _planted(spark, sf_dir, """SELECT o_orderkey AS page, 1000 AS width, 500 AS height, if(o_orderkey % 2 = 0, array('Text', 'Title', 'Figure', 'List'), array('Text', 'Title', 'Figure')) AS class_names,
      if(o_orderkey % 2 = 0, array(0.9D, 0.8D, 0.7D, 0.6D), array(0.9D, 0.8D, 0.7D)) AS scores, slice(array(array(0.05D, 0.09D, 0.7D, 0.15D), array(0.05D, 0.26D, (50 + o_orderkey % 50) / 1000D, 0.3D), array(0D, 0.5D, 1D, (250 + o_orderkey % 251) / 500D), array(0.1D, 0.6D, 0.2D, 0.7D)), 1, if(o_orderkey % 2 = 0, 4, 3)) AS boxes FROM orders""")
    blocks, pages = geometry.layout_blocks(layouts)
    return blocks.join(pages, "page").select("page", "kind", "x1", "y1", "x2", "y2", "whole")


_READINGS = """SELECT l_orderkey AS page, CAST(l_linenumber AS INT) AS line, concat('ZONE', lpad(CAST(min(l_partkey) AS VARCHAR(20)), 8, '0'), lpad(CAST(min(l_suppkey) AS VARCHAR(20)), 7, '0')) AS t,
  CAST(min(l_partkey) % 4 AS INT) AS kind, CASE WHEN min(l_suppkey) % 2 = 0 THEN 0.95 ELSE 0.8 END AS second, CASE WHEN min(l_suppkey) % 5 = 0 THEN 60 ELSE 1 END AS moved FROM lineitem GROUP BY l_orderkey, l_linenumber"""


@query(f"""WITH r AS ({_READINGS}) SELECT page, 2 * line AS id FROM r WHERE moved = 60 OR kind IN (1, 3) OR second < 0.9
  UNION ALL SELECT page, 2 * line + 1 FROM r WHERE moved = 60 OR kind = 3 OR (kind IN (0, 2) AND second > 0.9)""")
def reading_dedupe(spark, sf_dir):
    """Lines read twice: alike, cut short, with a wrong letter, with another text, or elsewhere."""
    r = tables.derived(spark, sf_dir, _READINGS).selectExpr("page", """stack(2, 2 * line, concat(t, ' <<<<'), 0.9D, 10, 100 * line, 2 * line + 1,
      CASE kind WHEN 0 THEN concat(t, ' << <<') WHEN 1 THEN concat(t, '<<') WHEN 2 THEN concat('zonex', substring(t, 6), '<<<<') ELSE concat('total ', page) END, CAST(second AS DOUBLE), 10 + moved, 100 * line) AS (id, text, conf, x1, y1)""")
    return geometry.dedupe_readings(r.selectExpr("*", "x1 + 100 AS x2", "y1 + 20 AS y2")).select("page", "id")
