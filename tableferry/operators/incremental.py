"""Watermarks: which to resume from, how far to read, and what to save."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import after
from ..storage import SnapshotTable
from . import load
from .mapping import dedup_last


def typed_min(value: Column) -> Column:
    """Least of text values, as numbers if all are, else as timestamps if all are, else as texts."""
    number, time = value.try_cast("decimal(38,10)"), value.try_cast("timestamp")
    all_ = F.count(value)
    return (
        F.when(F.count(number) == all_, F.min_by(value, number))
        .when(F.count(time) == all_, F.min_by(value, time))
        .otherwise(F.min(value))
    )


def watermarks(checkpoints: DataFrame) -> DataFrame:
    """mapping_id, watermark, from (task, value): the single record's value if there is one, else the least
    over the range records (``id#n``), as a range that lags must not be skipped."""
    single = ~F.col("task").contains("#")
    rows = checkpoints.withColumn("mapping_id", F.split("task", "#")[0]).where("value IS NOT NULL")
    own = F.max(F.when(single, F.col("value")))
    return rows.groupBy("mapping_id").agg(F.coalesce(own, typed_min(F.when(~single, F.col("value")))).alias("watermark"))


def upper_bound(now: dt.datetime, lag_seconds: int, watermark: dt.datetime | None) -> dt.datetime:
    """Now less the lag, so that rows committed late are still ahead; never behind the watermark."""
    upper = now - dt.timedelta(seconds=lag_seconds)
    return max(upper, watermark) if watermark is not None else upper


def advanced(old: Any, upper: Any, last_key: Any, failed: bool) -> Any:
    """The watermark after a run: the old one if it failed; the upper bound if there was one, even without
    rows; else the last key."""
    if failed:
        return old
    return upper if upper is not None else last_key if last_key is not None else old


def run_cycle(table: SnapshotTable, rows: DataFrame, key: list[str], checkpoint: str, batch_id: int, upper: Any = None, last: Any = "manifest") -> dict[str, Any]:
    """Merge the rows past the watermark and commit data and watermark at once. A batch that is already
    committed is skipped, so a replay adds nothing. ``rows``: the target's columns, among them the
    checkpoint."""
    state = table.manifest()
    if batch_id <= state["batch_id"]:
        return state
    watermark = state["watermark"] if last == "manifest" else last
    new = dedup_last(after(rows, checkpoint, watermark, upper), key, [F.col(checkpoint)])
    top = new.agg(F.max(checkpoint).cast("string"), F.count(F.lit(1))).first()
    updated = load.existing_keys(table.near(new, state)[0], new, key).count()
    mark = advanced(watermark, upper, top[0], False)
    return load.apply(table, "MERGE", new, key, state, batch_id=batch_id, watermark=str(mark) if mark is not None else None, n_written=top[1], n_updated=updated)[0]


def checkpoints(spark: SparkSession, tables: dict[str, SnapshotTable]) -> DataFrame:
    """task, value, rows_done: what the last runs committed for each of their tasks (``target`` or ``target#n``)."""
    rows = [(t["task"], t["value"], t["rows_done"]) for table in tables.values() for t in table.manifest().get("tasks", [])]
    return spark.createDataFrame(rows, "task string, value string, rows_done bigint")


def start(spark: SparkSession, root: str, first: DataFrame, key: list[str] | None = None) -> SnapshotTable:
    table = SnapshotTable(spark, root, key or ())
    if not table.versions():
        table.commit(first)
    return table
