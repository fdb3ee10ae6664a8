"""Inputs of the catalogue: the driver's tables, and tables of boxes, spans and detections derived from them.

Every derived table is given twice, as a DataFrame and as SQL, from the same rule.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A page for each order, a box for each of its lines.
_LINES = """SELECT l_orderkey AS page, CAST(l_linenumber AS INT) AS id, min(l_partkey) AS p, min(l_suppkey) AS s, CAST(min(l_quantity) AS INT) AS q, min(l_discount) AS d
FROM lineitem GROUP BY l_orderkey, l_linenumber"""
BOXES = f"""SELECT page, id, CAST(p % 300 AS INT) AS x1, CAST((s % 4) * 8 AS INT) AS y1, CAST(p % 300 + 20 + q * 4 AS INT) AS x2, CAST((s % 4) * 8 + 16 AS INT) AS y2,
  CAST(s % 4 AS INT) AS line, round(d * 10, 2) AS score, CASE p % 3 WHEN 0 THEN 'plate' ELSE 'text' END AS type FROM ({_LINES}) AS l"""
SPANS = f"""SELECT page, id, CAST(s % 60 AS INT) AS start, CAST(s % 60 + 3 + q AS INT) AS "end", CASE WHEN id % 2 = 0 THEN 'box' ELSE 'span' END AS side, round(d * 10, 2) AS conf FROM ({_LINES}) AS l"""
_KINDS = ["EMAIL", "PHONE", "CREDIT_CARD", "PERSON", "DATE", "URL", "LOCATION", "MRZ", "OTHER"]
DETECTIONS = f"""SELECT page, id, CASE p % 11 WHEN 9 THEN 'face' WHEN 10 THEN 'plate' ELSE 'text' END AS type,
  CASE p % 11 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS entity, concat('v', CAST(p AS VARCHAR(20))) AS text, round(d * 10, 2) AS score, s % 3 = 0 AS masked FROM ({_LINES}) AS l"""


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to tasks for all cores: a small file, or one large group of rows in a file, is one task else, whatever is
    made of its rows."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def over(spark: SparkSession, sf_dir: str, name: str, sql: str, dealt: bool = True) -> DataFrame:
    """SQL over one of the driver's tables, whatever views the session has; its rows are dealt to all cores."""
    view = f"_{name}_{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, name)
    (spread(rows) if dealt else rows).createTempView(view)
    try:
        return spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{view}", sql))
    finally:
        spark.catalog.dropTempView(view)


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return over(spark, sf_dir, "lineitem", sql.replace('"end"', "`end`"), dealt=False)  # its groups are dealt anyway


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({columns})")
