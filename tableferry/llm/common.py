"""Shared helpers: tables in the cluster's shared folder, and text clean-up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files, new_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return new_root(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a task holds few texts as Python objects at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that reads them has run."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            Files(df.sparkSession, path.rsplit("/", 1)[0]).delete(path.rsplit("/", 1)[1])


class Bits:
    """Which of all keys a set may hold: one bit a key, sent to the executors.

    ``keys``: one column of well-mixed longs. There are 16 bits a key, so about one key in 16 passes by mistake,
    and 64 MB of them at most: beyond 30 million keys more pass, so what the bits let through is always
    decided again by a join or by counting. A key of the set is never missed.
    """

    LEAST, MOST, SEGMENTS = 1 << 16, 1 << 29, 64

    def __init__(self, keys: DataFrame):
        self.size = min(self.MOST, max(self.LEAST, 1 << (16 * keys.count()).bit_length()))
        size, each = self.size, self.size // self.SEGMENTS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                bit = batch.column(0).to_numpy(zero_copy_only=False).view(np.int64) & (size - 1)
                for s in np.unique(bit // each):
                    at = bit[bit // each == s] - s * each
                    mine = held.setdefault(int(s), np.zeros(each, bool))
                    mine[at] = True
            for s, mine in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

        bit = F.col(keys.columns[0]).bitwiseAND(F.lit(size - 1))
        dealt = keys.select(bit.alias("bit")).distinct().repartition(min(self.SEGMENTS, 8 * max(1, size >> 23)), F.floor(F.col("bit") / each))
        bits = np.zeros(size // 8, np.uint8)
        for row in dealt.mapInArrow(run, "segment int, bits binary").collect():  # at most 64 MB in all
            part = np.frombuffer(row["bits"], np.uint8)
            bits[row["segment"] * len(part) : (row["segment"] + 1) * len(part)] |= part
        self.sent = keys.sparkSession.sparkContext.broadcast(bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (self.size - 1)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def test(self, column: str) -> Column:
        """Whether the set may hold the column's value."""

        def may(keys: pa.Array) -> pa.Array:
            return pa.array(self.may_hold(keys.to_numpy(zero_copy_only=False)))

        return F.arrow_udf(may, "boolean")(F.col(column))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))
