"""Queries of regions, readings, labels and summaries on rows planted over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, govern, recognize, spans
from ..sources import ocr
from . import tables
from .catalog import _NATIONAL, query

_IDS = f"SELECT o_orderkey, concat('id ', {_NATIONAL}, CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '.' END) AS t, {_NATIONAL} AS d FROM orders"


@query(f"""SELECT o_orderkey, 3 AS start, d AS value FROM (SELECT *, list_sum(list_transform(range(1, 10), lambda i: CAST(d[i] AS INT) * (11 - i))) % 11 AS r FROM ({_IDS}) i)
  WHERE o_orderkey % 3 <> 0 AND list_unique(string_split(d, '')) > 1 AND CAST(d[10] AS INT) = CASE WHEN r < 2 THEN r ELSE 11 - r END""")
def national_id_texts(spark, sf_dir):
    """National ids in texts: right and wrong check digits, and one digit too many."""
    return recognize.exploded(tables.over(spark, sf_dir, "orders", _IDS), ["national_id"], "o_orderkey", "t").select("o_orderkey", "start", "value")


_EDGES = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN ',; ' WHEN 2 THEN concat(':', chr(10)) ELSE '' END AS head, CASE c_custkey % 7 WHEN 0 THEN '' ELSE c_name END AS name, CASE c_custkey % 3 WHEN 0 THEN '., ' WHEN 1 THEN ';' ELSE '' END AS tail FROM customer"""


@query(f"SELECT c_custkey, CAST(length(head) AS INT) AS start, CAST(length(head) + length(name) AS INT) AS \"end\" FROM ({_EDGES}) e WHERE name <> ''")
def trimmed_edges(spark, sf_dir):
    """Spans with blanks and signs at their edges, and some of nothing else."""
    t = tables.over(spark, sf_dir, "customer", _EDGES).withColumn("t", F.concat("head", "name", "tail"))
    one = F.array(F.struct(F.lit(0).alias("start"), F.length("t").alias("end"), F.lit("PERSON").alias("entity"), F.lit(0.5).alias("score"), F.lit("x").alias("source")))
    return t.select("c_custkey", F.explode(spans.trimmed(one, F.col("t"))).alias("s")).select("c_custkey", "s.start", "s.end")


@query(f"""SELECT page, id, round(x1 + (x2 - x1) * greatest(0.0, (id - 0.05) / 10), 6) AS ax, round(x1 + (x2 - x1) * least(1.0, (id + 3.05) / 10), 6) AS bx, round(CAST(y2 AS DOUBLE), 6) AS dy FROM ({tables.BOXES}) b""")
def sub_polygons(spark, sf_dir):
    """The part of each box that holds three of its ten characters."""
    b = tables.derived(spark, sf_dir, tables.BOXES)
    corners = geometry.quad(*(F.col(c).cast("double") for c in geometry.CORNERS))
    q = b.withColumn("q", geometry.sub_polygon(corners, F.col("id"), F.col("id") + 3, F.lit(10.0)))
    return q.select("page", "id", F.round(F.col("q")[0][0], 6).alias("ax"), F.round(F.col("q")[2][0], 6).alias("bx"), F.round(F.col("q")[3][1], 6).alias("dy"))


@query("SELECT o_orderkey, x + y < 40.5 AND NOT (x > 10 AND y > 10 AND x + y < 30.5) AS inside FROM (SELECT o_orderkey, o_orderkey % 50 + 0.5 AS x, o_custkey % 50 + 0.25 AS y FROM orders) p")
def points_inside(spark, sf_dir):
    """Points in a triangle with a notch, whose edges cross: what is in both is out."""
    p = tables.over(spark, sf_dir, "orders", "SELECT o_orderkey, CAST(o_orderkey % 50 + 0.5 AS DOUBLE) AS x, CAST(o_custkey % 50 + 0.25 AS DOUBLE) AS y FROM orders")
    corners = [(0, 0), (40.5, 0), (0, 40.5), (0, 0), (10, 10), (20.5, 10), (10, 20.5), (10, 10)]
    polygon = F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in corners))
    return p.select("o_orderkey", geometry.inside(polygon, F.col("x"), F.col("y")).alias("inside"))


_READ = "SELECT o_orderkey AS page, CAST(o_orderkey % 10 AS DOUBLE) / 20 AS conf, lpad(CAST(o_orderkey AS VARCHAR(20)), CAST(10 + o_orderkey % 8 AS INT), '7') AS text FROM orders"


@query(f"SELECT page, text FROM ({_READ}) r WHERE conf >= 0.2 OR length(text) >= 15")
def confident_readings(spark, sf_dir):
    """Readings at the floor, and long codes below it."""
    return ocr.confident(tables.over(spark, sf_dir, "orders", _READ)).select("page", "text")


@query("""WITH r AS (SELECT o_orderkey AS page, unnest(range(3)) AS k, o_orderkey FROM orders) SELECT page, 'lists' AS way, concat('t', k, '-', page) AS text, CAST(k AS DOUBLE) / 4 AS conf, 10.0::DOUBLE * k AS x FROM r WHERE (page + k) % 4 <> 0
  UNION ALL SELECT page, 'pairs', concat('t', k, '-', page), CAST(k AS DOUBLE) / 4, 10.0::DOUBLE * k FROM r WHERE (page + k) % 4 <> 0 UNION ALL SELECT page, 'words', concat('t', k, '-', page), CAST(k AS DOUBLE) / 4, 10.0::DOUBLE * k FROM r WHERE (page + k) % 4 <> 0""")
def reading_forms(spark, sf_dir):
    """The results of three readers in one form: parallel lists, pairs, and blocks of lines of words; blank texts go."""
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    ks = F.sequence(F.lit(0), F.lit(2))
    said = lambda k: F.when((F.col("page") + k) % 4 != 0, F.concat(F.lit("t"), k.cast("string"), F.lit("-"), F.col("page").cast("string"))).otherwise(" ")
    point = lambda a, b: F.array(a.cast("double"), F.lit(b).cast("double"))
    poly = lambda k: F.array(point(k * 10, 0), point(k * 10 + 5, 0), point(k * 10 + 5, 5), point(k * 10, 5))
    conf = lambda k: k.cast("double") / 4
    lists = ocr.from_lists(o.select("page", F.transform(ks, poly).alias("rec_polys"), F.transform(ks, said).alias("rec_texts"), F.transform(ks, conf).alias("rec_scores")))
    pairs = ocr.from_pairs(o.select("page", F.transform(ks, lambda k: F.struct(poly(k).alias("poly"), F.struct(said(k).alias("text"), conf(k).alias("conf")).alias("read"))).alias("lines")))
    word = lambda k: F.struct(said(k).alias("value"), conf(k).alias("confidence"), F.array(F.array(k / 64.0, F.lit(0.0)), F.array((k + 0.5) / 64.0, F.lit(0.5))).alias("geometry"))
    words = ocr.from_words(o.select("page", F.lit(640).alias("width"), F.lit(10).alias("height"), F.array(F.struct(F.array(F.struct(F.transform(ks, word).alias("words"))).alias("lines"))).alias("blocks")))
    out = None
    for way, r in (("lists", lists), ("pairs", pairs), ("words", words)):
        r = r.select("page", F.lit(way).alias("way"), "text", "conf", F.col("poly")[0][0].alias("x"))
        out = r if out is None else out.unionByName(r)
    return out


_DRAWN = "SELECT page, CAST(10 * k AS INT) AS x1, 5 AS y1, CAST(10 * k + 8 + 4 * k AS INT) AS x2, 40 AS y2 FROM (SELECT o_orderkey AS page, {} AS k FROM orders) r WHERE page % 3 <> 0"


@query(f"""WITH d AS ({tables.DETECTIONS}), t AS (SELECT page, max(id) AS top FROM d GROUP BY page), r AS ({_DRAWN.format("unnest(range(4))")}),
  n AS (SELECT r.page, coalesce(top, 0) + row_number() OVER (PARTITION BY r.page ORDER BY x1) AS id FROM r LEFT JOIN t ON t.page = r.page WHERE x2 - x1 >= 12)
  SELECT page, CAST(id AS INT) AS id, type, entity, masked FROM d UNION ALL SELECT page, CAST(id AS INT), 'manual', 'CUSTOM', true FROM n""")
def drawn_regions(spark, sf_dir):
    """Regions drawn by hand beside the detections of their pages: masked, with the next ids; small ones go."""
    regions = tables.over(spark, sf_dir, "orders", _DRAWN.format("explode(sequence(0, 3))"))
    return govern.manual_regions(tables.derived(spark, sf_dir, tables.DETECTIONS), regions).select("page", "id", "type", "entity", "masked")


_CASES = " ".join(f"WHEN '{e}' THEN '{label}'" for e, label in govern.FIELDS.items())
_RANKS = " ".join(f"WHEN '{e}' THEN {k}" for k, e in enumerate(govern.FIELDS))


@query(f"""WITH d AS (SELECT page, id, entity, CASE entity {_CASES} ELSE lower(entity) END AS name, CASE entity {_RANKS} ELSE 4 END AS rank FROM ({tables.DETECTIONS}) d WHERE entity IS NOT NULL),
  f AS (SELECT page, name, min(rank) AS rank, min(CASE WHEN rank = 4 THEN id END) AS id FROM d GROUP BY page, name) SELECT page, string_agg(name, ', ' ORDER BY rank, id) AS labels FROM f GROUP BY page""")
def field_labels(spark, sf_dir):
    """Labels of each page's fields, each once: the compared ones in their order, then others as they come."""
    d = tables.derived(spark, sf_dir, tables.DETECTIONS).where("entity IS NOT NULL")
    return govern.field_labels(d.withColumn("label", F.lower("entity")))


@query(f"SELECT page, coalesce(entity, 'none') AS entity, count(*) AS n, round(avg(score), 4) AS mean_score, list(id ORDER BY id) AS ids FROM ({tables.DETECTIONS}) d GROUP BY page, entity")
def page_summaries(spark, sf_dir):
    """Kinds of detections by page with their ids."""
    return govern.page_summary(tables.derived(spark, sf_dir, tables.DETECTIONS)).withColumn("entity", F.coalesce("entity", F.lit("none")))


_TALKS = "SELECT conv_id, turn, concat(coalesce(text, ''), ' write to ', CASE WHEN conv_id % 3 = 0 THEN 'nobody' ELSE concat('c', CAST(conv_id AS VARCHAR(20)), '@talk-', CAST(turn AS VARCHAR(20)), '.org') END, ' soon') AS t FROM conversations"


@query(f"SELECT conv_id, turn, concat('c', CAST(conv_id AS VARCHAR), '@talk-', CAST(turn AS VARCHAR), '.org') AS value FROM ({_TALKS}) t WHERE conv_id % 3 <> 0")
def conversation_addresses(spark, sf_dir):
    """Addresses at the ends of turns of conversations."""
    t = tables.over(spark, sf_dir, "conversations", _TALKS).withColumn("key", F.struct("conv_id", "turn"))
    return recognize.exploded(t, ["email"], "key", "t").select("key.conv_id", "key.turn", "value").where("value LIKE '%@talk-%'")
