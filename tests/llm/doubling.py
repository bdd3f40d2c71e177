"""Prefix doubling over every byte position: what op8 does sparsely, for comparison on small tables.

Ranks of 25 bytes come first; each round sorts pairs of the ranks at a position and at the position behind its
string, so lengths double: 25, 50, 100, 200, 400. A position with a unique rank leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm.common import written
from tableferry.llm.shingling import mix, prefix_sums

FIRST, LENGTH = 25, 400


def repeated_starts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pos: byte positions whose 400 bytes also start anywhere else."""

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer((t or "").encode(), np.uint8)
                if len(data) < LENGTH:
                    continue
                s, q = prefix_sums(data)
                at = np.arange(len(data) - FIRST + 1)
                rank = mix((s[at + FIRST] - s[at]) * q[at]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(rank), pa.array(np.zeros(len(at), np.int64))], names=["k", "pos", "r1", "r2"])

    rows, length = docs.select(key, "text").mapInArrow(run, "k long, pos long, r1 long, r2 long"), FIRST
    while True:
        rows = written(rows, f"pairs-{length}")
        classes = rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r1", "r2", F.monotonically_increasing_id().alias("rank"))
        alive = written(rows.join(written(classes, f"classes-{length}"), ["r1", "r2"]).select("k", "pos", "rank"), f"ranks-{length}")
        if length == LENGTH:
            return alive.select(F.col("k").alias(key), "pos")
        behind = alive.select("k", (F.col("pos") - length).alias("pos"), F.col("rank").alias("r2"))
        rows = alive.withColumnRenamed("rank", "r1").join(behind, ["k", "pos"]).select("k", "pos", "r1", "r2")
        length *= 2
