"""Differences between two tables by a tree of range hashes, and their repair.

Rows have a place on a line: their key, if that is a whole number or a time, else a hash of it. The line is cut into
ranges, each range into narrower ones, and so on. From the widest on, both sides are summed by range (rows, and a hash of
each row), and only ranges whose sums differ are looked at one level further down. There the rows are joined. Equal
tables take one pass, and each later level reads only what the ranges hold: the ranges reach the scan as filters.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import SnapshotTable
from .validate import row_text

#: Children of a range, and the widths at the last level and of the widest ranges by default.
FANOUT, LEAF, LEVELS = 16, 1024, 4
#: Ranges that become a filter of the scan; more of them are joined instead.
MOST_FILTERS = 256
INSERT, UPDATE, DELETE = "insert", "update", "delete"


def place(df: DataFrame, key: list[str]) -> Column:
    """Where a row lies: by its key itself if that keeps neighbours together, else by 60 bits of its hash."""
    kind = dict(df.dtypes)[key[0]]
    if len(key) == 1 and re.match("tinyint|smallint|int|bigint", kind):
        return F.col(key[0]).cast("bigint")
    if len(key) == 1 and kind.startswith(("date", "timestamp")):
        return F.unix_micros(F.col(key[0]).cast("timestamp"))
    return F.conv(F.substring(F.md5(row_text(df, key).cast("binary")), 1, 15), 16, 10).cast("bigint")


def hashed(df: DataFrame, columns: list[str]) -> Column:
    return F.conv(F.substring(F.md5(row_text(df, columns).cast("binary")), 1, 15), 16, 10).cast("bigint")


def whole(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a NULL in their key; others equal none."""
    return df.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key)))


def within(df: DataFrame, key: list[str], ranges: list[int] | DataFrame | None, width: int) -> DataFrame:
    """Rows in ranges of a width, given by number; None for all. Ranges next to each other are one filter."""
    if ranges is None:
        return df
    at = place(df, key)
    if isinstance(ranges, list):
        runs: list[list[int]] = []
        for r in sorted(ranges):
            if runs and runs[-1][1] == r:
                runs[-1][1] = r + 1
            else:
                runs.append([r, r + 1])
        return df.where(reduce(lambda a, b: a | b, ((at >= a * width) & (at < b * width) for a, b in runs), F.lit(False)))
    return df.withColumn("_node", F.floor(at / width)).join(ranges.select(F.col("node").alias("_node")), "_node", "left_semi").drop("_node")


def sums(df: DataFrame, key: list[str], columns: list[str], width: int) -> DataFrame:
    """node, n, total of a level's ranges; each task sums its rows first."""
    node = F.call_function("div", place(df, key) - F.pmod(place(df, key), F.lit(width)), F.lit(width).cast("bigint"))
    rows = df.select(node.alias("node"), hashed(df, columns).alias("h"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))


def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """node, n_source, n_target of ranges whose sums differ."""
    x = a.select("node", F.col("n").alias("n_source"), F.col("total").alias("x"))
    y = b.select("node", F.col("n").alias("n_target"), F.col("total").alias("y"))
    both = x.join(y, "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")) | ~F.col("n_source").eqNullSafe(F.col("n_target")))
    return both.select("node", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_source", "n_target")))


def descend(source: DataFrame, target: DataFrame, key: list[str], columns: list[str] | None = None, leaf: int = LEAF, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """Unequal ranges of each level, the widest first: level, width, node, n_source, n_target. The ranges of one level
    are children of those before. Levels are kept in memory, as they are read twice; there are as many as ``levels``,
    or fewer if all is equal."""
    columns = columns or source.columns
    source, target = (whole(x, key).select(*dict.fromkeys([*key, *columns])) for x in (source, target))
    out: list[DataFrame] = []
    ranges: list[int] | DataFrame | None = None
    for level in range(levels):
        width, wider = leaf * fanout ** (levels - 1 - level), leaf * fanout ** (levels - level)
        sides = [sums(within(x, key, ranges, wider), key, columns, width) for x in (source, target)]
        found = unequal(*sides).withColumns({"level": F.lit(level + 1), "width": F.lit(width).cast("bigint")}).persist()
        out.append(found.select("level", "width", "node", "n_source", "n_target"))
        first = [r["node"] for r in found.select("node").limit(MOST_FILTERS + 1).collect()]
        if not first:
            break
        ranges = first if len(first) <= MOST_FILTERS else found.select("node")
    return out


def differences(source: DataFrame, target: DataFrame, key: list[str], columns: list[str] | None = None, **shape: Any) -> DataFrame:
    """key columns, action: insert (the target lacks the row), update (its row differs) or delete (the source lacks it);
    from the rows of the last level's unequal ranges only. Keys are distinct on each side."""
    columns = columns or source.columns
    levels = descend(source, target, key, columns, **shape)
    leaves, width = levels[-1], shape.get("leaf", LEAF)
    first = [r["node"] for r in leaves.select("node").limit(MOST_FILTERS + 1).collect()]
    ranges: list[int] | DataFrame = first if len(first) <= MOST_FILTERS else leaves
    a, b = (within(whole(x, key).select(*dict.fromkeys([*key, *columns])), key, ranges, width) for x in (source, target))
    left = a.select(*key, hashed(a, columns).alias("_a"))
    right = b.select(*key, hashed(b, columns).alias("_b"))
    action = F.when(F.col("_b").isNull(), INSERT).when(F.col("_a").isNull(), DELETE).when(F.col("_a") != F.col("_b"), UPDATE)
    return left.join(right, key, "full_outer").select(*key, action.alias("action")).where("action IS NOT NULL")


def repair(table: SnapshotTable, source: DataFrame, **shape: Any) -> dict[str, Any]:
    """Merge the source's rows that the table lacks or has otherwise. Rows that only the table has stay: what becomes of
    them is for reconciliation to say. Gives the manifest."""
    base = table.manifest()
    key, target = base["key"], table.read(base["version"])
    found = differences(source, target, key, [c for c in target.columns if c in source.columns], **shape)
    todo = found.where(F.col("action") != DELETE).select(*key)
    return table.merge(source.join(todo, key, "left_semi"), None, base)
