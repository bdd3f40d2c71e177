"""Write modes: each gives the target's rows anew from those it has and the good rows; ``apply`` writes them to a
versioned table, which needs no more than the good rows for most of them."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Conflict, SnapshotTable
from .mapping import DUPLICATE


def on_key(a: str, b: str, key: list[str]):
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in key))


def merge(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Update written columns where the key matches, else insert; columns not written keep their value."""
    made = rows.withColumn("_new", F.lit(True)).alias("s")
    joined = target.withColumn("_old", F.lit(True)).alias("t").join(made, on_key("t", "s", key), "full_outer")
    types = dict(target.dtypes)

    def pick(c: str):
        if c in key:
            return F.coalesce(f"t.{c}", F.col(f"s.{c}").cast(types[c])).alias(c)
        if c in rows.columns:
            return F.when(F.col("s._new"), F.col(f"s.{c}").cast(types[c])).otherwise(F.col(f"t.{c}")).alias(c)
        return F.col(f"t.{c}").alias(c)

    return joined.select(*map(pick, target.columns))


def fitted(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows with the target's columns; those not written are NULL."""
    types = dict(target.dtypes)
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in target.columns))


def insert_only(target: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Target with the rows of new keys, and the rows whose key it has, as rejects."""
    new = fitted(rows.join(target.select(*key), key, "left_anti"), target)
    known = rows.join(target.select(*key), key, "left_semi").withColumns({"err_num": F.lit(DUPLICATE), "err_col": F.lit(",".join(key))})
    return target.unionByName(new), known


def truncate_insert(target: DataFrame, rows: DataFrame, watermark: object = None) -> DataFrame:
    """Rows in place of the target; not with a watermark, as what lies before it would be lost."""
    if watermark is not None:
        raise ValueError("TRUNCATE_INSERT can't follow a watermark")
    return fitted(rows, target)


def delete_insert(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Target without the rows' keys, and the rows."""
    return target.join(rows.select(*key), key, "left_anti").select(*target.columns).unionByName(fitted(rows, target))


#: Times that an insert is made anew because others have committed to its buckets meanwhile.
TRIES = 5


def apply(table: SnapshotTable, mode: str, rows: DataFrame, key: list[str], base: dict[str, Any] | None = None, **facts: Any) -> tuple[dict[str, Any], DataFrame | None]:
    """Write rows of distinct keys in a mode; facts are committed with them. Gives the manifest and, for INSERT_ONLY,
    the rows whose key the target has, as rejects. ``base``: the version whose facts the caller has gone by.

    INSERT_ONLY adds files, after a look at those that may have its keys. MERGE and DELETE_INSERT add deltas and
    read nothing. TRUNCATE_INSERT writes all anew.
    """
    if mode == "TRUNCATE_INSERT":
        return table.commit(truncate_insert(table.read(), rows), base, **facts), None
    if mode in ("MERGE", "DELETE_INSERT") and not (base or table.manifest())["key"]:  # a table without a key of its own
        return table.commit((merge if mode == "MERGE" else delete_insert)(table.read(), rows, key), base, **facts), None
    if mode == "MERGE":
        return table.merge(rows, base=base, **facts), None
    if mode == "DELETE_INSERT":
        return table.merge(fitted(rows, table.read()), base=base, **facts), None
    for attempt in range(TRIES):
        now = base or table.manifest()
        part, buckets = table.near(rows, now)
        known = rows.join(part.select(*key), key, "left_semi").withColumns({"err_num": F.lit(DUPLICATE), "err_col": F.lit(",".join(key))})
        try:
            return table.insert(fitted(rows.join(part.select(*key), key, "left_anti"), part), buckets, now, **facts), known
        except Conflict:
            if base is not None or attempt + 1 == TRIES:
                raise
    raise AssertionError


def existing_keys(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return target.select(*key).join(rows.select(*key).distinct(), key, "left_semi")


def estimate(target: DataFrame, checked: DataFrame, key: list[str]) -> DataFrame:
    """Counts a run would report: n_read, n_rejected, n_updated, n_inserted; nothing is written."""
    known = target.select(*key).distinct().withColumn("_known", F.lit(True))
    return checked.join(known, key, "left").agg(*counted(F.col("err_num").isNull(), F.col("_known").isNotNull()))


def counted(good: Column, seen: Column) -> list[Column]:
    """What a run reports of its rows."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return [F.count(F.lit(1)).alias("n_read"), count(~good, "n_rejected"), count(good & seen, "n_updated"), count(good & ~seen, "n_inserted")]
