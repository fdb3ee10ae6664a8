"""Geometry folds, images, OCR readings, streams, decisions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiprism.operators import geometry, govern
from piiprism.plans import catalog, tables
from piiprism.sources import images, ocr
from piiprism.streaming import spans as streams


def test_dedupe_equals_brute_force(spark, sf):
    got = {(r["page"], r["id"]) for r in catalog.QUERIES["detection_dedupe"](spark, sf).collect()}
    pages = {}
    for r in tables.derived(spark, sf, tables.BOXES).orderBy("page", "id").collect():
        kept = pages.setdefault(r["page"], [])
        at = next((i for i, o in enumerate(kept) if r["type"] == o["type"] == "text" and r["x2"] % 2 == o["x2"] % 2 and geometry._overlap(r.asDict(), o.asDict()) >= 0.55), None)
        if at is None:
            kept.append(r)
        elif r["score"] > kept[at]["score"]:
            kept[at] = r
    assert got == {(p, r["id"]) for p, rows in pages.items() for r in rows}


def test_filters(spark):
    px = np.random.default_rng(1).integers(1, 256, (64, 48, 3), dtype=np.uint8)
    df = spark.createDataFrame([("a", 64, 48, 3, px.tobytes()), ("b", 64, 48, 3, px.tobytes())], "path string, height int, width int, channels int, data binary")
    boxes = spark.createDataFrame([("a", 8, 8, 40, 40), ("a", 30, 30, 10, 10), ("a", 40, 50, 400, 500)], "path string, x1 int, y1 int, x2 int, y2 int")
    read = lambda kind, **o: {r["path"]: np.frombuffer(r["data"], np.uint8).reshape(64, 48, 3) for r in images.redact(df, boxes, kind, **o).collect()}
    black = read("solid_black")
    assert not black["a"][8:40, 8:40].any() and not black["a"][50:, 40:].any() and (black["a"][:8] == px[:8]).all() and (black["b"] == px).all()
    cells = read("dp_pix", sigma=0.0)["a"][8:40, 8:40]
    assert (cells[:16, :16] == cells[0, 0]).all() and abs(cells[0, 0].astype(int) - px[8:24, 8:24].mean(axis=(0, 1))).max() <= 0.5
    noisy = read("dp_pix", sigma=8.0, seed=2)["a"][8:40, 8:40]
    assert (noisy[:16, :16] == noisy[0, 0]).all() and (noisy[0, 0] != cells[0, 0]).any()
    assert read("blur")["a"][8:40, 8:40].std() < px[8:40, 8:40].std()
    with pytest.raises(ValueError):
        images.redact(df, boxes, "sparkle")


def test_ocr_readings(spark):
    q = "array(array(0d, 0d), array(9d, 0d), array(9d, 4d), array(0d, 4d))"
    lists = spark.sql(f"SELECT 1 AS page, array({q}, {q}) AS rec_polys, array('a', ' ') AS rec_texts, array(0.9d, 0.8d) AS rec_scores")
    assert [r["text"] for r in ocr.from_lists(lists).collect()] == ["a"]
    pairs = spark.sql(f"SELECT 1 AS page, array(named_struct('poly', {q}, 'read', named_struct('text', 'b', 'conf', 0.1d))) AS lines")
    got = ocr.from_pairs(pairs)
    assert got.count() == 1 and ocr.confident(got).count() == 0
    assert ocr.shifted(got, 1.0, 2.0).first()["poly"][0] == [1.0, 2.0]
    words = spark.sql("SELECT 1 AS page, 100 AS width, 50 AS height, array(named_struct('lines', array(named_struct('words', array(named_struct('value', 'w', 'confidence', 0.5d, 'geometry', array(array(0.1d, 0.2d), array(0.3d, 0.4d)))))))) AS blocks")
    assert ocr.from_words(words).first()["poly"] == [[10.0, 10.0], [30.0, 10.0], [30.0, 20.0], [10.0, 20.0]]


def test_polygons(spark):
    quad = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 10), (0, 10))))
    r = spark.range(1).select(
        geometry.sub_polygon(quad, F.lit(2), F.lit(5), F.lit(10), 0.0).alias("s"), geometry.inside(quad, F.lit(5.0), F.lit(5.0)).alias("i"), geometry.inside(quad, F.lit(5.0), F.lit(50.0)).alias("o")
    ).first()
    assert [[round(v, 6) for v in p] for p in r["s"]] == [[20, 0], [50, 0], [50, 10], [20, 10]] and r["i"] and not r["o"]


def test_manual_regions(spark):
    d = spark.createDataFrame([(1, 1, "text", "EMAIL", 0.5, False, 0, 0, 9, 9)], "page int, id int, type string, entity string, score double, masked boolean, x1 int, y1 int, x2 int, y2 int")
    r = spark.createDataFrame([(1, 0, 0, 20, 20), (1, 0, 0, 5, 5), (2, 0, 0, 20, 20)], "page int, x1 int, y1 int, x2 int, y2 int")
    assert {(x["page"], x["id"], x["type"]) for x in govern.manual_regions(d, r).collect()} == {(1, 1, "text"), (1, 2, "manual"), (2, 1, "manual")}


def test_stream(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = streams.redacted(stream, ["email"]).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    events = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    assert streams.counts(events, "ts", "props", ["long_number"]).isStreaming


def test_audit_has_no_plain_text(spark, sf):
    r = catalog.QUERIES["audit_json"](spark, sf).first()
    assert "privacy-audit-report/1.0" in r["report"] and '"text":' not in r["report"]


def test_readings_of_odd_rows(spark):
    rows = [(1, 1, "P<UTO", 0.9, 0, 0, 10, 10), (1, 2, "p< UTO <<", 0.7, 0, 0, 10, 10), (1, 3, None, None, 0, 0, 10, 10), (1, 4, "", 0.1, 0, 0, 10, 10), (2, 1, "a", 0.5, 0, 0, 0, 0), (2, 2, "a", 0.5, 0, 0, 0, 0), (3, 1, "b", 0.5, 0, 0, 9, 9), (3, 2, "b", 0.5, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, "page long, id long, text string, conf double, x1 int, y1 int, x2 int, y2 int")
    got = sorted((r["page"], r["id"]) for r in geometry.dedupe_readings(df).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1)]
    assert geometry.dedupe_readings(df.limit(0)).count() == 0
    assert geometry.similar("abcdefghijklmnopqrst", "abcdefghijXlmnopqrst") and not geometry.similar("abcdefghij", "abXdefghXj") and not geometry.similar("", "a")
