"""Reading sources: tables or SELECTs, scoped by filters, watermarks and key ranges."""

from __future__ import annotations

import datetime as dt
import decimal
import re
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..spec import Mapping


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of Parquet tables."""
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def jdbc(spark: SparkSession, url: str, table: str, predicates: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a database; one partition for each predicate, such as those of :func:`range_predicates`."""
    if predicates:
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    return spark.read.jdbc(url, table, properties=options)


def source(spark: SparkSession, mapping: Mapping, binds: dict[str, Any] | None = None) -> DataFrame:
    """The mapping's table or SELECT with its filter, which reaches the scan."""
    df = spark.table(mapping.table) if mapping.table else spark.sql(mapping.sql, args=binds or {})
    return df.where(F.expr(mapping.where)) if mapping.where else df


def after(df: DataFrame, checkpoint: str, last: Any, upper: Any = None) -> DataFrame:
    """Rows past the watermark, up to and with ``upper``; all of them without a watermark."""
    if last is not None:
        df = df.where(F.col(checkpoint) > F.lit(last))
    return df.where(F.col(checkpoint) <= F.lit(upper)) if upper is not None else df


def in_range(df: DataFrame, checkpoint: str, low: Any, high: Any, first: bool) -> DataFrame:
    """Half-open, so that a value on a border is read once: low < x <= high, and the least in the first."""
    x = F.col(checkpoint)
    return df.where(((x >= F.lit(low)) if first else (x > F.lit(low))) & (x <= F.lit(high)))


def sql_literal(value: Any) -> str:
    """A value in the SQL of a JDBC source; times in the escapes that drivers translate."""
    if value is None:
        return "NULL"
    if isinstance(value, dt.datetime):
        return "{ts '" + value.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    if isinstance(value, dt.date):
        return "{d '" + value.isoformat() + "'}"
    return str(value) if isinstance(value, (int, float, decimal.Decimal)) else "'" + str(value).replace("'", "''") + "'"


def range_predicates(plan: DataFrame, checkpoint: str) -> list[str]:
    """Predicates of a range plan, one a range, for a JDBC read. The first is open below and takes NULLs, the last is
    open above, so together they are the table."""
    highs = [sql_literal(r["high"]) for r in plan.orderBy("bucket").collect()]  # a row a worker
    if len(highs) < 2:
        return ["1 = 1"]
    inner = [f"{checkpoint} > {low} AND {checkpoint} <= {high}" for low, high in zip(highs, highs[1:-1])]
    return [f"{checkpoint} IS NULL OR {checkpoint} <= {highs[0]}", *inner, f"{checkpoint} > {highs[-2]}"]


def _as_number(df: DataFrame, column: str) -> Column:
    type_ = dict(df.dtypes)[column]
    if not re.match("tinyint|smallint|int|bigint|float|double|decimal|timestamp|date", type_):
        raise ValueError(f"ranges need numbers or times; {column} is {type_}")
    return (F.unix_micros(F.col(column).cast("timestamp")) if type_.startswith(("timestamp", "date")) else F.col(column)).cast("double")


#: Distinct values that one task of a range plan sorts, about, and the most ranges of them.
A_RANGE, MOST_RANGES = 2_000_000, 8192


def range_plan(df: DataFrame, checkpoint: str, workers: int) -> DataFrame:
    """bucket, low, high, n: NTILE(workers) over the checkpoint order.

    Rows are counted by value first. A running sum over the distinct values places each value's rows; it
    runs within ranges of values, to which the counts of the ranges before are added, not in one task. There are
    as many ranges as the values call for.
    """
    spark = df.sparkSession
    counts = df.where(F.col(checkpoint).isNotNull()).groupBy(F.col(checkpoint).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    number = _as_number(counts, "v")
    all_, values = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-values // A_RANGE)))
    fences = counts.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or [] if ranges > 1 else []
    edges = np.array(sorted(fences))

    @F.pandas_udf("int")
    def part_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy()).astype(np.int32))

    parted = counts.withColumn("part", part_of(number))
    sizes = parted.groupBy("part").agg(F.sum("n").alias("m"))
    before = sizes.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))  # a row a range
    running = F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    placed = parted.join(F.broadcast(before), "part").withColumn("end", running + F.col("before")).withColumn("begin", F.col("end") - F.col("n"))
    size, extra = divmod(all_ or 0, workers)

    def tile(at: Column) -> Column:
        """The tile of a row by its place: the first ``extra`` tiles have a row more than the others."""
        longer = extra * (size + 1)
        later = F.call_function("div", at - longer, F.lit(max(size, 1)).cast("bigint")) + extra
        return F.when(at < longer, F.call_function("div", at, F.lit(size + 1).cast("bigint"))).otherwise(later) + 1

    # A value lies in all tiles from its first row's to its last row's. Each border between tiles is within one value at
    # most, so there are no more pieces than values and tiles together.
    pieces = placed.select("v", F.explode(F.sequence(tile(F.col("begin")).cast("int"), tile(F.col("end") - 1).cast("int"))).alias("bucket"))
    rows = F.when(F.col("bucket") <= extra, size + 1).otherwise(size).cast("bigint")
    return pieces.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("n", rows)


def preview(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, key: list[str], n: int, seed: str = "s") -> DataFrame:
    """n rows in the order of a hash of their key: random, and the same again."""
    return df.orderBy(F.md5(F.concat_ws("|", *key, F.lit(seed)).cast("binary")), *key).limit(n)


def sample_percent(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About so many of a hundred rows, by a hash of the key; a filter, without a shuffle."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.where(F.pmod(h, F.lit(100)) < percent)
