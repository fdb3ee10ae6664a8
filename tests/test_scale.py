"""What a query costs on small files of many rows and on long documents."""

import time

from pyspark.sql import functions as F

from piiprism.operators import find, lines
from piiprism.plans import tables
from piiprism.sources import images


def test_rows_of_one_small_file_are_dealt_to_all_cores(spark, sf):
    rows = tables.over(spark, sf, "orders", "SELECT o_orderkey FROM orders")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert rows.count() == tables.table(spark, sf, "orders").count()


def test_header_values_of_a_long_document_in_linear_time(spark):
    n = 120_000
    text = F.concat(F.repeat(F.lit("word\n"), n), F.lit("Surname\n\n \nMorant\n"), F.repeat(F.lit("word\n"), n))
    began = time.time()
    got = lines.header_values(lines.lines(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text")))).collect()
    assert [(r["value"], r["entity"], r["start"]) for r in got] == [("Morant", "PERSON", 5 * n + 11)]
    assert time.time() - began < 60


def test_lines_of_a_text_are_looked_at_once(spark):
    said = find.line_spans(spark.sql("SELECT 'a' AS k, 'Surname\\nMorant' AS text, array(0) AS anchors"))
    assert [r["names"] for r in said.collect()] == [["Morant"]]


def test_pixels_are_dealt_without_their_colours(spark):
    px = spark.sql("SELECT id % 2 AS image, id % 3 AS x, id % 5 AS y, id * 20 AS r, id AS g, id + 50 AS b FROM range(30)")
    plan = images.statistics(px)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(code" in plan and "lag(gray" not in plan
