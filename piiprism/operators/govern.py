"""Governance over detections: risk, mask states, fingerprints, summaries, audit records.

A detection is a row (page, id, type, entity, text, score, masked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..functions.vocabulary import ENTITIES, OTHER_TEXT, POLICIES, WEIGHTS


def weight(kind: Column, entity: Column) -> Column:
    m = F.create_map(*(F.lit(x) for k, w in WEIGHTS.items() for x in (k, w)))
    return (
        F.when(kind == "manual", WEIGHTS["CUSTOM"])
        .when(kind.isin("face", "plate"), F.try_element_at(m, kind))
        .otherwise(F.coalesce(F.try_element_at(m, entity), F.when(kind == "text", OTHER_TEXT).otherwise(0)))
    )


def risk(detections: DataFrame, policy: str = "balanced", by: str = "page") -> DataFrame:
    """by, total, masked, initial, residual, status."""
    epsilon = POLICIES[policy][0]
    w = weight(F.col("type"), F.col("entity"))
    a = detections.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if("masked").alias("masked"),
        F.least(F.lit(99), F.sum(w)).cast("int").alias("initial"),
        F.sum(F.when(~F.col("masked"), w).otherwise(0)).alias("open"),
        F.max(F.col("masked") & F.col("type").isin("face", "plate")).alias("pixels"),
    )
    floor = F.when(F.col("pixels"), min(2.0, 1 / epsilon)).otherwise(0.0)
    residual = F.least(F.lit(99.0), F.floor((F.least(F.lit(99.0), F.col("open").cast("double")) + floor) * 10 + 0.5) / 10)
    status = F.when(F.col("total") == 0, "No Detections").when(F.col("residual") <= 2, "Protected").when(F.col("residual") < 25, "Low Risk").when(F.col("residual") <= 60, "High Risk - Coverage Required").otherwise("Critical Exposure")
    return a.withColumn("residual", residual).select(by, "total", "masked", "initial", "residual", status.alias("status"))


def summary(detections: DataFrame) -> DataFrame:
    """entity, n, mean_score, top_score, sample (the first 24 characters of the text with the least id)."""
    return detections.groupBy("entity").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.max("score").alias("top_score"), F.substring(F.min_by("text", "id"), 1, 24).alias("sample")
    )


def page_summary(detections: DataFrame) -> DataFrame:
    """page, entity, n, mean_score, ids (ascending): the detections of each kind on a page."""
    return detections.groupBy("page", "entity").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.array_sort(F.collect_list("id")).alias("ids"))


#: The fields that two zones of a page are compared by, in the order in which they are named.
FIELDS = {"PERSON": "Person Name", "ID_NUMBER": "Passport / ID Number", "DATE": "Date", "DATE_OF_BIRTH": "Date of Birth"}


def field_labels(matched: DataFrame) -> DataFrame:
    """page, labels: the labels of a page's fields (page, id, entity, label), each once: those of FIELDS in its order, then
    others in the order of their first id."""
    known = F.create_map(*(F.lit(x) for pair in FIELDS.items() for x in pair))
    rank = F.create_map(*(F.lit(x) for k, e in enumerate(FIELDS) for x in (e, k)))
    own = F.coalesce(F.try_element_at(known, F.col("entity")), F.col("label"))
    first = F.struct(F.coalesce(F.try_element_at(rank, F.col("entity")), F.lit(len(FIELDS))).alias("rank"), F.when(~F.col("entity").isin(*FIELDS), F.col("id")).alias("id"))
    each = matched.groupBy("page", own.alias("name")).agg(F.min(first).alias("first"))  # a page has few labels
    return each.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ", ").alias("labels"))


def mask_all(detections: DataFrame) -> DataFrame:
    """All go masked, unless all are: then none."""
    from pyspark.sql import Window

    every = F.min("masked").over(Window.partitionBy("page"))
    return detections.withColumn("masked", ~every)


def toggled(detections: DataFrame, chosen: DataFrame) -> DataFrame:
    """Masks the chosen detections (page, id) of each page, or unmasks them where all of them are masked."""
    picked = detections.join(chosen.select("page", "id", F.lit(True).alias("picked")).distinct(), ["page", "id"], "left")
    every = picked.where("picked").groupBy("page").agg(F.min("masked").alias("every"))
    out = picked.join(every, "page", "left").withColumn("masked", F.when(F.col("picked"), ~F.col("every")).otherwise(F.col("masked")))
    return out.select(*detections.columns)


def card_status(detections: DataFrame, links: DataFrame) -> DataFrame:
    """page, entry, status of a log entry by the detections that it is linked with (page, entry, id)."""
    by = links.join(detections.select("page", "id", "masked"), ["page", "id"]).groupBy("page", "entry").agg(F.count("*").alias("n"), F.count_if("masked").alias("m"))
    part = F.concat(F.col("m").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" Masked"))
    return by.select("page", "entry", F.when(F.col("m") == F.col("n"), "Masked").when(F.col("m") == 0, "Exposed").otherwise(part).alias("status"))


def highlighted(detections: DataFrame, policy: str, floor: int = 25) -> DataFrame:
    """What is not masked and weighs `floor` or more, under a policy that highlights risk."""
    heavy = weight(F.col("type"), F.col("entity")) >= floor
    return detections.where(~F.col("masked") & heavy & F.lit(POLICIES[policy][5]))


def policy_masks(detections: DataFrame, policy: str) -> DataFrame:
    """Detections that reach a policy's confidence floor, masked where the policy masks by itself."""
    _, _, _, floor, masks, _ = POLICIES[policy]
    return detections.where(F.col("score") >= floor).withColumn("masked", F.col("masked") | F.lit(masks))


def mosaic_block(width: Column, height: Column, block: int = 12) -> Column:
    """Side of a mosaic's cells: a seventh of the shorter side within 8 and 22, by the policy's block, within 8 and 40."""
    within = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    own = within(F.floor(F.least(width, height) / 7.0 + 0.5), 8, 22)
    return within(F.floor(own * block / 12.0 + 0.5), 8, 40).cast("int")


def random_salt() -> str:
    """16 hexadecimal characters for one session; never stored."""
    import secrets

    return secrets.token_hex(8)


def audit(detections: DataFrame, salt: str, policy: str = "balanced") -> DataFrame:
    """page, report: one JSON record for each page, with salted fingerprints in place of texts."""
    row = F.struct("id", "type", "entity", F.round("score", 2).alias("score"), "masked", fingerprint(F.col("text"), salt).alias("fingerprint"))
    rows = detections.groupBy("page").agg(F.array_sort(F.collect_list(row)).alias("detections"))
    return rows.join(risk(detections, policy), "page").select("page", F.to_json(F.struct(F.lit("privacy-audit-report/1.0").alias("schema"), F.lit(policy).alias("policy"), "total", "masked", "initial", "residual", "status", "detections")).alias("report"))


def verdict(target: Column, unknown: Column, failed: Column) -> Column:
    """A crop's verdict; a verifier that fails keeps the detection."""
    return F.when(F.coalesce(failed, F.lit(True)), "error").when((target < 0.5) | (unknown > 0.4), "rejected").otherwise("approved")


def top_exposed(detections: DataFrame, k: int = 3) -> DataFrame:
    """page, exposed: the k heaviest kinds among what is not masked, each once."""
    kind = F.coalesce("entity", "type")
    by = detections.where(~F.col("masked")).groupBy("page", kind.alias("kind")).agg(F.max(weight(F.col("type"), F.col("entity"))).alias("w"))
    top = by.groupBy("page").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "kind"))).alias("a"))  # a page has few kinds
    return top.select("page", F.array_join(F.transform(F.slice("a", 1, k), lambda x: x["kind"]), ", ").alias("exposed"))


def narrative(detections: DataFrame, policy: str = "balanced", k: int = 3) -> DataFrame:
    """page, narrative: what is masked, what is exposed (the k heaviest labels, each once, the least id first), what leaks."""
    epsilon = POLICIES[policy][0]
    names = F.create_map(*(F.lit(x) for e, (label, _) in ENTITIES.items() for x in (e, label)))
    label = F.when(F.col("type") == "face", "Face").when(F.col("type") == "plate", "License Plate").when(F.col("type") == "manual", "Custom Region").otherwise(F.coalesce(F.try_element_at(names, F.col("entity")), F.lit("Sensitive Text")))
    rows = detections.select("page", "masked", F.col("type").isin("face", "plate").alias("pixels"), label.alias("label"), F.struct((-weight(F.col("type"), F.col("entity"))).alias("w"), "id").alias("order"))
    by = rows.groupBy("page", "label").agg(  # a page has few labels
        F.count("*").alias("n"), F.count_if("masked").alias("m"), F.max(F.col("masked") & F.col("pixels")).alias("pixels"), F.min(F.when(~F.col("masked"), F.col("order"))).alias("first")
    )
    exposed = F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "label")))
    page = by.groupBy("page").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("pixels").alias("pixels"), F.array_sort(exposed).alias("exposed"))
    top = F.array_join(F.transform(F.slice("exposed", 1, k), lambda x: x["label"]), ", ")
    # fixed values: the sentences
    leak = F.when(F.col("pixels"), f"the DP-Pix noise floor (ε = {epsilon:.1f}) leaves {min(2.0, 1 / epsilon):.1f}% residual leakage.").otherwise("every mask is zero-entropy (no residual leakage).")
    covered = F.format_string("All %d identifier(s) are covered; %s", "n", leak)
    return page.select("page", F.when(F.col("n") == F.col("m"), covered).otherwise(F.format_string("%d of %d identifier(s) masked; %d still exposed (%s).", "m", "n", F.col("n") - F.col("m"), top)).alias("narrative"))


def block_means(pixels: DataFrame, block: int, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """cell_y, cell_x, mean: the value of each cell of a mosaic of pixels (x, y, v), with one draw of noise for a cell."""
    cells = pixels.groupBy(F.floor(F.col("y") / block).cast("int").alias("cell_y"), F.floor(F.col("x") / block).cast("int").alias("cell_x")).agg(F.avg("v").alias("mean"))
    mean = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("mean") + F.randn(seed) * sigma)) if sigma else F.col("mean")
    return cells.withColumn("mean", F.round(mean, 6))


def manual_regions(detections: DataFrame, regions: DataFrame, least: int = 12) -> DataFrame:
    """detections and the regions drawn by hand (page, x1, y1, x2, y2) that are large enough: masked, with ids after the page's last."""
    from pyspark.sql import Window

    top = detections.groupBy("page").agg(F.max("id").alias("top"))
    own = regions.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least)).join(top, "page", "left")
    no = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("page").orderBy("x1", "y1", "x2", "y2"))
    row = {"id": no.cast(detections.schema["id"].dataType), "type": F.lit("manual"), "entity": F.lit("CUSTOM"), "score": F.lit(1.0), "masked": F.lit(True)}
    return detections.unionByName(own.select("page", *(c.alias(n) for n, c in row.items()), *(n for n in ("x1", "y1", "x2", "y2") if n in detections.columns)), allowMissingColumns=True)


#: What a log record can hold.
LOG = "entity string, action string, message string, confidence double, detection_id long"


def decoded(record: Column) -> Column:
    """A log record's JSON text as struct<LOG, status>: read by the schema; what is no JSON object is a message of the system.

    status is read, partial (a field has another type, and is null) or foreign. Unknown fields are dropped; a null
    record is a foreign one with a null message.
    """
    whole = F.from_json(record, f"{LOG}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    fits = F.coalesce(F.trim(record).startswith("{") & F.try_parse_json(record).isNotNull(), F.lit(False))
    names = [c.split()[0] for c in LOG.split(", ")]
    fallback = {"entity": F.lit("system"), "action": F.lit("info"), "message": record}
    kinds = dict(c.split() for c in LOG.split(", "))
    own = F.struct(*(whole[n].alias(n) for n in names), F.when(whole["_broken"].isNull(), "read").otherwise("partial").alias("status"))
    other = F.struct(*(fallback.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names), F.lit("foreign").alias("status"))
    return F.when(fits, own).otherwise(other)
