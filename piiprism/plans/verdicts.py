"""Queries of the typed decision, plate and text verification, log assembly, mask toggles and polygons, with their SQL.

Every feature varies over the rows, in the query and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide, geometry, govern
from . import tables
from .catalog import query

#: A crop for each line of an order, with all features of the decision.
_CROPS = """SELECT l_orderkey AS page, CAST(l_linenumber AS INT) AS id, CAST(min(l_partkey) % 97 AS DOUBLE) AS sharp, CAST((min(l_suppkey) * 7 + min(l_partkey)) % 256 AS DOUBLE) AS bright,
  CAST(min(l_partkey) % 61 AS DOUBLE) AS contrast, CAST((min(l_partkey) * 3 + min(l_suppkey)) % 71 AS DOUBLE) / 10.0 AS aspect, CAST(min(l_suppkey) % 19 AS INT) AS glyphs, CAST(min(l_partkey) % 53 AS DOUBLE) / 10.0 AS edges,
  CAST(min(l_partkey) % 101 AS DOUBLE) / 100.0 AS share, CAST(min(l_suppkey) % 41 AS DOUBLE) AS middle, min(l_partkey) % 3 = 0 AS in_document, min(l_suppkey) % 2 = 0 AS document_like, min(l_partkey) % 29 = 0 AS empty,
  CAST(min(l_quantity) AS DOUBLE) / 50.0 AS score, CASE min(l_partkey) % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'error' ELSE 'approved' END AS verdict,
  CASE min(l_suppkey) % 4 WHEN 0 THEN 'AB 123 C' WHEN 1 THEN 'ab-cdefgh' WHEN 2 THEN 'HELLOWORLD' ELSE NULL END AS plate_text
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_U = "(-1.2 + CASE WHEN sharp < 15 THEN 2.0 WHEN sharp < 45 THEN 0.9 ELSE 0.05 END + CASE WHEN bright < 20 OR bright > 240 THEN 1.4 ELSE 0 END + CASE WHEN contrast < 12 THEN 1.2 ELSE 0 END)"


def _decided_sql(logits: list[str], options: tuple[str, ...], t: float) -> str:
    z = ", ".join(f"CAST({x} AS DOUBLE) AS z{k}" for k, x in enumerate(logits))
    n, e = len(logits), [f"exp((z{k} - u) / {t})" for k in range(len(logits))]
    total = f"({' + '.join(e)} + 1)"
    top = "greatest(" + ", ".join(f"z{k}" for k in range(n)) + ")"
    choice = "CASE WHEN empty THEN '" + options[0] + "' " + " ".join(f"WHEN z{k} = {top} THEN '{options[k]}'" for k in range(n)) + " END"
    return (
        f"WITH z AS (SELECT page, id, empty, {z}, CAST({_U} AS DOUBLE) AS u FROM ({_CROPS}) c) SELECT page, id, {choice} AS choice, "
        f"round(CASE WHEN empty THEN 0 ELSE {e[0]} / {total} END, 6) AS first, round(CASE WHEN empty THEN 1 ELSE 1 / {total} END, 6) AS unknown, empty OR 1 / {total} > 0.4 AS abstained FROM z"
    )


def _decided(spark, sf_dir, kind, logits):
    c = tables.derived(spark, sf_dir, _CROPS)
    d = decide.decision(kind, logits, decide.unknown_logit(F.col("sharp"), F.col("bright"), F.col("contrast")), F.col("empty"))
    return c.select("page", "id", d.alias("d")).select("page", "id", "d.choice", F.round(F.col("d.probabilities")[0], 6).alias("first"), F.round("d.unknown_probability", 6).alias("unknown"), "d.abstained")


_ASPECT = "CASE WHEN aspect BETWEEN 2.0 AND 5.5 THEN 3.5 WHEN aspect BETWEEN 1.5 AND 6.5 THEN 1.5 ELSE -2.5 END"


@query(_decided_sql(
    [f"{_ASPECT} + CASE WHEN glyphs BETWEEN 3 AND 10 THEN 2.5 WHEN glyphs > 15 THEN -0.5 ELSE 0.5 END + CASE WHEN contrast > 35 THEN 1 ELSE -1 END - CASE WHEN in_document THEN 5 ELSE 0 END",
     "CASE WHEN aspect < 1.8 OR glyphs > 10 THEN 2 ELSE -1 END + CASE WHEN contrast > 20 THEN 1.5 ELSE 0 END + CASE WHEN in_document THEN 3.5 ELSE 0 END", "CASE WHEN edges > 2.8 THEN 3 ELSE -1.5 END"],
    decide.OPTIONS["plate"], 0.85))
def plate_decision(spark, sf_dir):
    """Plate, printed text or graphic, with the prior of a document's scene."""
    return _decided(spark, sf_dir, "plate", decide.plate_logits(F.col("aspect"), F.col("glyphs"), F.col("contrast"), F.col("edges"), F.col("in_document")))


_FACE = "CASE WHEN aspect BETWEEN 0.7 AND 1.4 THEN 2.0 WHEN aspect BETWEEN 0.5 AND 1.8 THEN 0.5 ELSE -2.0 END"


@query(_decided_sql(
    [f"{_FACE} + CASE WHEN share BETWEEN 0.25 AND 0.85 THEN 3 WHEN share < 0.08 THEN -1 ELSE 0.8 END + CASE WHEN middle > 20 THEN 1.5 ELSE -0.5 END + CASE WHEN sharp > 40 THEN 1 ELSE -0.5 END",
     "CASE WHEN share < 0.15 AND contrast > 30 THEN 2.5 ELSE -1 END", f"CASE WHEN {_FACE} < -1 OR sharp < 15 OR share < 0.05 THEN 3 ELSE -1.5 END"],
    decide.OPTIONS["face"], 0.85))
def face_decision(spark, sf_dir):
    return _decided(spark, sf_dir, "face", decide.face_logits(F.col("aspect"), F.col("share"), F.col("middle"), F.col("sharp"), F.col("contrast")))


@query(_decided_sql(
    ["CASE WHEN share BETWEEN 0.25 AND 0.85 AND contrast > 30 THEN 2.5 ELSE 0 END + CASE WHEN sharp > 30 THEN 1.5 ELSE -1 END", "CASE WHEN contrast < 25 THEN 1.5 ELSE -0.5 END", "CASE WHEN sharp < 15 OR share > 0.9 THEN 2 ELSE -1 END"],
    decide.OPTIONS["text"], 0.85))
def text_decision(spark, sf_dir):
    return _decided(spark, sf_dir, "text", decide.text_logits(F.col("share"), F.col("sharp"), F.col("contrast")))


@query("SELECT o_orderkey, CASE n WHEN 0 THEN 'unknown' ELSE 'a' END AS choice, CASE n WHEN 0 THEN NULL ELSE round(0.95 / n, 6) END AS first, CASE n WHEN 0 THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS unknown, n = 0 AS abstained FROM (SELECT o_orderkey, o_orderkey % 5 AS n FROM orders)")
def default_decision(spark, sf_dir):
    """Options of no known kind."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.slice(F.array(*map(F.lit, "abcde")), 1, (F.col("o_orderkey") % 5).cast("int")).alias("options"))
    d = o.select("o_orderkey", decide.default_decision(F.col("options")).alias("d"))
    return d.select("o_orderkey", "d.choice", F.round(F.try_element_at("d.probabilities", F.lit(1)), 6).alias("first"), F.col("d.unknown_probability").alias("unknown"), "d.abstained")


@query(f"SELECT page, id, round(CAST({_U} AS DOUBLE), 6) AS z FROM ({_CROPS}) c")
def unknown_logits(spark, sf_dir):
    return tables.derived(spark, sf_dir, _CROPS).select("page", "id", F.round(decide.unknown_logit(F.col("sharp"), F.col("bright"), F.col("contrast")), 6).alias("z"))


@query(f"SELECT b.page, b.id FROM ({tables.BOXES}) b WHERE b.score >= CASE WHEN b.page % 2 = 0 THEN 0.8 ELSE 0.45 END AND b.x2 - b.x1 >= 8 AND b.y2 - b.y1 >= 4 AND (b.x2 - b.x1) / (b.y2 - b.y1) BETWEEN 0.8 AND 8.0")
def plate_floors(spark, sf_dir):
    """Floors of confidence, size and shape of plate candidates."""
    return decide.plate_candidates(tables.derived(spark, sf_dir, tables.BOXES), 0.35, F.col("page") % 2 == 0).select("page", "id")


# what the three texts that occur read as: none of them in small letters is a strict plate, capitals of ten are no plate
_STRICT = "CASE plate_text WHEN 'AB 123 C' THEN true WHEN 'ab-cdefgh' THEN false WHEN 'HELLOWORLD' THEN false ELSE true END"
_LENIENT = "CASE plate_text WHEN 'AB 123 C' THEN true WHEN 'ab-cdefgh' THEN false WHEN 'HELLOWORLD' THEN true ELSE true END"
_FATE = f"SELECT page, id, CASE WHEN verdict <> 'rejected' AND CASE WHEN document_like OR in_document THEN {_STRICT} ELSE {_LENIENT} END THEN 'kept' WHEN in_document THEN 'suppressed' ELSE 'rejected' END AS fate FROM ({_CROPS}) c"


def _fates(spark, sf_dir):
    return tables.derived(spark, sf_dir, _CROPS).select("page", "id", decide.plate_fate(F.col("verdict"), F.col("plate_text"), F.col("in_document"), F.col("document_like")).alias("fate"))


@query(_FATE)
def plate_fates(spark, sf_dir):
    """Verifier and text together, one fate for each candidate."""
    return _fates(spark, sf_dir)


@query(f"SELECT page, count(*) AS suppressed FROM ({_FATE}) f WHERE fate = 'suppressed' GROUP BY page")
def suppressed_plates(spark, sf_dir):
    return decide.suppressed_note(_fates(spark, sf_dir))


@query(f"SELECT page, id, CASE WHEN score >= 0.5 THEN 'unverified' WHEN verdict = 'rejected' THEN 'dropped' ELSE 'verified' END AS fate, verdict <> 'rejected' OR score >= 0.6 AS face_kept FROM ({_CROPS}) c")
def verified_crops(spark, sf_dir):
    """Text is verified where it was read uncertainly; a face stays where the detector was sure."""
    return tables.derived(spark, sf_dir, _CROPS).select("page", "id", decide.text_fate(F.col("score"), F.col("verdict")).alias("fate"), decide.keep_face(F.col("verdict"), F.col("score")).alias("face_kept"))


@query(f"SELECT page, id, floor(share * 100 / 101 * (0.75 + 0.25 * score) * 100 + 0.5) / 100 AS score FROM ({_CROPS}) c")
def combined_scores(spark, sf_dir):
    """Spans' scores with the confidence of the text that they were read from."""
    return tables.derived(spark, sf_dir, _CROPS).select("page", "id", decide.combined_score(F.col("share") * 100 / 101, F.col("score")).alias("score"))


_LOG = f"""WITH f AS ({_FATE}), l AS (
  SELECT DISTINCT page, 0 AS stage, 0 AS ordinal, 'info' AS action, 'scene' AS entity, 'scene read' AS message FROM f
  UNION ALL SELECT page, 1, id, fate, 'plate', 'candidate ' || id FROM f WHERE fate <> 'suppressed'
  UNION ALL SELECT page, 2, 0, 'info', 'plate', count(*) || ' suppressed' FROM f WHERE fate = 'suppressed' GROUP BY page)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY stage, ordinal) AS INTEGER) AS no, action, entity, message FROM l"""


@query(_LOG)
def log_assembly(spark, sf_dir):
    """Scene, plates and the note on suppressed ones as one numbered log."""
    f = _fates(spark, sf_dir)
    row = lambda df, stage, ordinal, action, entity, message: df.select("page", F.lit(stage).alias("stage"), ordinal.cast("int").alias("ordinal"), action.alias("action"), F.lit(entity).alias("entity"), message.alias("message"))
    scene = row(f.select("page").distinct(), 0, F.lit(0), F.lit("info"), "scene", F.lit("scene read"))
    plates = row(f.where("fate <> 'suppressed'"), 1, F.col("id"), F.col("fate"), "plate", F.concat(F.lit("candidate "), F.col("id").cast("string")))
    note = row(decide.suppressed_note(f), 2, F.lit(0), F.lit("info"), "plate", F.concat(F.col("suppressed").cast("string"), F.lit(" suppressed")))
    return decide.assembled_log(scene, plates, note)


# ---- masks, cards and policies ----

_HEAVY = "coalesce(CASE WHEN type = 'face' THEN 28 WHEN type = 'plate' THEN 20 ELSE CASE entity WHEN 'MRZ' THEN 35 WHEN 'CREDIT_CARD' THEN 25 WHEN 'PERSON' THEN 20 ELSE 0 END END, 0)"


@query(f"WITH d AS ({tables.DETECTIONS}) SELECT page, id, CASE WHEN id % 2 = 1 THEN NOT min(CASE WHEN id % 2 = 1 THEN masked END) OVER (PARTITION BY page) ELSE masked END AS masked FROM d")
def mask_toggle(spark, sf_dir):
    """The linked detections of each page go masked, or all of them unmasked where all are."""
    d = tables.derived(spark, sf_dir, tables.DETECTIONS)
    return govern.toggled(d, d.where("id % 2 = 1").select("page", "id")).select("page", "id", "masked")


@query(f"WITH d AS ({tables.DETECTIONS}) SELECT page, id % 2 AS entry, CASE WHEN bool_and(masked) THEN 'Masked' WHEN NOT bool_or(masked) THEN 'Exposed' ELSE sum(masked::INT) || '/' || count(*) || ' Masked' END AS status FROM d GROUP BY page, id % 2")
def card_states(spark, sf_dir):
    d = tables.derived(spark, sf_dir, tables.DETECTIONS)
    return govern.card_status(d, d.select("page", "id", (F.col("id") % 2).alias("entry")))


@query(f"SELECT page, id FROM ({tables.DETECTIONS}) d WHERE NOT masked AND {_HEAVY} >= 25")
def risk_highlights(spark, sf_dir):
    """What an audit highlights; the other policies highlight nothing."""
    d = tables.derived(spark, sf_dir, tables.DETECTIONS)
    return govern.highlighted(d, "audit").unionByName(govern.highlighted(d, "balanced")).select("page", "id")


@query(f"WITH d AS ({tables.DETECTIONS}) SELECT 'strict' AS policy, page, id, true AS masked FROM d WHERE score >= 0.25 UNION ALL SELECT 'balanced', page, id, masked FROM d WHERE score >= 0.35")
def policy_states(spark, sf_dir):
    d = tables.derived(spark, sf_dir, tables.DETECTIONS)
    one = lambda p: govern.policy_masks(d, p).select(F.lit(p).alias("policy"), "page", "id", "masked")
    return one("strict").unionByName(one("balanced"))


@query(f"SELECT page, id, CAST(least(greatest(floor(least(greatest(floor(least(x2 - x1, y2 - y1) * (1 + id) / 7.0 + 0.5), 8), 22) * 20 / 12.0 + 0.5), 8), 40) AS INTEGER) AS block FROM ({tables.BOXES}) b")
def mosaic_blocks(spark, sf_dir):
    """Cell sides of the strict policy's mosaic."""
    b = tables.derived(spark, sf_dir, tables.BOXES)
    side = lambda a, z: (F.col(z) - F.col(a)) * (1 + F.col("id"))
    return b.select("page", "id", govern.mosaic_block(side("x1", "x2"), side("y1", "y2"), 20).alias("block"))


# ---- polygons ----


@query(f"SELECT page, id, round(CAST(x1 - 0.005 * (x2 - x1) - 0.02 * (-id) AS DOUBLE), 6) AS x1, round(CAST(y1 - 0.02 * (y2 - y1) - 0.005 * id AS DOUBLE), 6) AS y1, round(CAST(x2 + 0.005 * (x2 - x1) + 0.02 * (-id) AS DOUBLE), 6) AS rx, round(CAST(y2 + id + 0.02 * (y2 - y1) + 0.005 * id AS DOUBLE), 6) AS by FROM ({tables.BOXES}) b")
def grown_polygons(spark, sf_dir):
    """Slanted quads taken outward along their own axes: their upper left and lower right corners."""
    d = lambda c: F.col(c).cast("double")
    lean = F.array(F.array(d("x1"), d("y1")), F.array(d("x2"), d("y1") + d("id")), F.array(d("x2") - d("id"), d("y2") + d("id")), F.array(d("x1") - d("id"), d("y2")))
    q = tables.derived(spark, sf_dir, tables.BOXES).select("page", "id", geometry.grown(lean).alias("q"))
    return q.select("page", "id", F.round(F.col("q")[0][0], 6).alias("x1"), F.round(F.col("q")[0][1], 6).alias("y1"), F.round(F.col("q")[2][0] + F.col("id"), 6).alias("rx"), F.round(F.col("q")[2][1], 6).alias("by"))


@query(f"SELECT page, id, CAST(least(x1, x2 - 2 * id) AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(greatest(x1, x2 - 2 * id) AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM ({tables.BOXES}) b")
def polygon_boxes(spark, sf_dir):
    """Boxes to quads and back, some of them with their sides crossed."""
    d = lambda c: F.col(c).cast("double")
    q = geometry.quad(d("x1"), d("y1"), d("x2") - 2 * d("id"), d("y2"))
    return tables.derived(spark, sf_dir, tables.BOXES).select("page", "id", *geometry.bounding_box(q))


@query(f"SELECT page, id, round(CAST(least(greatest(0.8 * x1 - 0.6 * y1 + 5, 0), 300) AS DOUBLE), 6) AS x, round(CAST(least(greatest(0.6 * x1 + 0.8 * y1 - 20, 0), 200) AS DOUBLE), 6) AS y FROM ({tables.BOXES}) b")
def deskew_inverse(spark, sf_dir):
    """Corners under the inverse of a turned frame, kept within it."""
    d = lambda c: F.col(c).cast("double")
    m = F.array(*(F.array(*map(F.lit, r)) for r in ((0.8, -0.6, 5.0), (0.6, 0.8, -20.0))))
    q = geometry.moved(geometry.quad(d("x1"), d("y1"), d("x2"), d("y2")), m, F.lit(300), F.lit(200))
    return tables.derived(spark, sf_dir, tables.BOXES).select("page", "id", F.round(q[0][0], 6).alias("x"), F.round(q[0][1], 6).alias("y"))


@query(f"SELECT page, id, CAST(greatest(0, floor(x1 - 0.1 * (x2 - x1))) AS INTEGER) AS x1, CAST(greatest(0, floor(y1 - 0.15 * (y2 - y1))) AS INTEGER) AS y1, CAST(least(320, ceil(x2 + 0.1 * (x2 - x1))) AS INTEGER) AS x2, CAST(least(45, ceil(y2 + 0.1 * (y2 - y1))) AS INTEGER) AS y2 FROM (SELECT page, id, CAST(x1 AS DOUBLE) AS x1, CAST(x2 AS DOUBLE) AS x2, CAST(y1 AS DOUBLE) AS y1, CAST(y2 AS DOUBLE) AS y2 FROM ({tables.BOXES}) b) c")
def face_boxes(spark, sf_dir):
    b = tables.derived(spark, sf_dir, tables.BOXES)
    return b.select("page", "id", *geometry.face_box({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")}, F.lit(320), F.lit(45)))


#: Records of events: whole, with an unknown field, with a word for a number, cut short, a text, a list, none.
_RECORDS = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN concat('{"entity": "text", "action": "kept", "confidence": 0.5, "detection_id": ', CAST(event_id AS VARCHAR(20)), '}') WHEN 1 THEN concat('{"entity": "face", "more": [1, {"a": 2}], "message": "m', CAST(event_id AS VARCHAR(20)), '"}')
  WHEN 2 THEN '{"entity": "plate", "detection_id": "seven"}' WHEN 3 THEN '{"entity": "plate", "det' WHEN 4 THEN 'started' WHEN 5 THEN '[{"entity": "text"}]' END AS record FROM events"""


@query(f"""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'face' WHEN 2 THEN 'plate' ELSE 'system' END AS entity, CASE WHEN event_id % 7 = 0 THEN 'kept' WHEN event_id % 7 >= 3 THEN 'info' END AS action,
  CASE WHEN event_id % 7 = 1 THEN json_extract_string(record, '$.message') WHEN event_id % 7 >= 3 THEN record END AS message, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN event_id % 7 = 0 THEN event_id END AS detection_id,
  CASE WHEN json_valid(record) AND json_type(CASE WHEN json_valid(record) THEN record END) = 'OBJECT' THEN CASE WHEN event_id % 7 = 2 THEN 'partial' ELSE 'read' END ELSE 'foreign' END AS status FROM ({_RECORDS}) r""")
def log_records(spark, sf_dir):
    """Log records read by their schema, with broken, partial and foreign ones among them."""
    r = tables.over(spark, sf_dir, "events", _RECORDS)
    return r.select("event_id", govern.decoded(F.col("record")).alias("d")).select("event_id", "d.*")
