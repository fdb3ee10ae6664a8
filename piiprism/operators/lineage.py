"""Cuts a long lineage where several branches read one result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """rows, written once to the folder that all executors share (``spark.checkpoint.dir``) and read from there by all that
    follows; one machine makes a folder of its own where none is set."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="piiprism-")
        sc.setCheckpointDir(folder)
    return rows.checkpoint()
