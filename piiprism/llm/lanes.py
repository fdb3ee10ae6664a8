"""Queries meet all vectors: vectors are dealt to lanes once, and blocks of queries travel to the lanes.

A lane is the work of one task: at most about LANE_ROWS vectors, packed in parts, which come first and stay, and then all
blocks of queries, which pass by one at a time. So every vector is shuffled once, whatever the number of queries, an
index is built once for each part, and a query is sent once to each lane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LANE_ROWS, LEAST_ROWS = 65_536, 4096
BLOCK_QUERIES = 512


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def packed(rows: DataFrame, by: list[str], codes: bool = False) -> DataFrame:
    """One row for each group, by id: ids and x, and where asked for codes and norms, as bytes."""
    more = ["codes", "norms"] if codes else []
    schema = pa.schema([*((b, pa.int32()) for b in by), *((n, pa.binary()) for n in ("ids", "x", *more))])

    def run(key, t):
        t = t.sort_by("id")
        row = {b: k.as_py() for b, k in zip(by, key, strict=True)} | {"ids": t.column("id").to_numpy().tobytes(), "x": matrix(t.column("vector")).astype(np.float64).tobytes()}
        if codes:
            row |= {"codes": b"".join(t.column("codes").to_pylist()), "norms": t.column("norm").to_numpy().astype(np.float32).tobytes()}
        return pa.Table.from_pylist([row], schema)

    return rows.groupBy(*by).applyInArrow(run, ", ".join(f"{b} int" for b in by) + "".join(f", {n} binary" for n in ("ids", "x", *more)))


def meet(base: DataFrame, asked: DataFrame, total: int, part_rows: int, codes: bool = False) -> DataFrame:
    """Rows of lanes in order: the parts of a lane's vectors (kind 0), then the blocks of queries (kind 1)."""
    partitions = common.partitions_for(base.sparkSession)
    lanes = max(1, min(2 * partitions, -(-total // LEAST_ROWS)), -(-total // LANE_ROWS))
    parts = max(1, -(-total // (lanes * part_rows)))
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    own = packed(base.withColumn("lane", deal(1, lanes)).withColumn("part", deal(3, parts)), ["dim", "lane", "part"], codes).withColumn("kind", F.lit(0))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    ask = packed(asked.withColumn("part", deal(7, blocks)), ["dim", "part"]).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(1))
    both = own.unionByName(ask, allowMissingColumns=True)
    return both.repartition(max(partitions, lanes), "dim", "lane").sortWithinPartitions("dim", "lane", "kind", "part")


FOUND = "query_id long, vec_id long, score {score}"


def answered(rows: DataFrame, load: Callable, ask: Callable, score: str) -> DataFrame:
    """query_id, vec_id, score: ask(parts of the lane, query ids, query vectors) for each block in each lane; load makes
    a part of a row."""
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            for r in b.to_pylist():
                if (here := (r["dim"], r["lane"])) != at:
                    at, parts = here, []
                ids = np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["x"], np.float64).reshape(len(ids), -1)
                if r["kind"] == 0:
                    parts.append(load(r, ids, x))
                elif parts:
                    cols = list(zip(*ask(r["dim"], parts, ids, x), strict=True)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(common.lean(run), FOUND.format(score=score))
