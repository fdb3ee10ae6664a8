"""Records written as JSON lines, once for each batch, from tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def write_batch(records: DataFrame, folder: str, batch: int, column: str = "report") -> None:
    """The JSON texts of a column as lines of ``folder/batch=N``. A batch that runs again replaces what it wrote, so each of
    its records stands there once, and other batches stay. Null records are left out."""
    records.where(F.col(column).isNotNull()).select(column).write.mode("overwrite").text(f"{folder.rstrip('/')}/batch={int(batch)}")


def write_stream(records: DataFrame, folder: str, column: str = "report") -> DataStreamWriter:
    """A stream's records by ``write_batch``: a batch that a restarted query repeats has its old number, and is written once."""
    return records.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, folder, batch, column))


def read_batches(spark, folder: str, column: str = "report") -> DataFrame:
    """batch and column of all that is written."""
    return spark.read.text(folder).select(F.col("batch").cast("long").alias("batch"), F.col("value").alias(column))
