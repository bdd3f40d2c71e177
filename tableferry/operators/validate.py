"""Checks before a load and comparisons after it. A finding has check_name, target, level and n."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, hash32, number_text
from .profile import duplicate_keys, orphans, unequal_parts

FINDING = "check_name string, target string, level string, n bigint"


def finding(check: str, target: str, n: DataFrame, bad: str = "ERROR") -> DataFrame:
    """A finding from a frame of one count; the level is PASS at zero."""
    c = F.col(n.columns[0]).cast("bigint")
    return n.select(F.lit(check).alias("check_name"), F.lit(target).alias("target"), F.when(c > 0, bad).otherwise("PASS").alias("level"), c.alias("n"))


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def all_of(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def verdict(findings: DataFrame) -> DataFrame:
    """The worst level of all findings."""
    rank = F.when(F.col("level") == "ERROR", 3).when(F.col("level") == "WARN", 2).when(F.col("level") == "INFO", 1).otherwise(0)
    return findings.agg(F.coalesce(F.max_by("level", rank), F.lit("PASS")).alias("level"))


def canonical(x: Column, type_: str) -> Column:
    """A value as text that is equal for equal values; NULL has a mark of its own."""
    if type_.startswith("timestamp"):
        text = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif type_.startswith(("decimal", "double", "float")):
        text = number_text(x)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("\\N"))


def row_text(df: DataFrame, columns: list[str]) -> Column:
    types = dict(df.dtypes)
    return F.concat_ws(SEPARATOR, *(canonical(F.col(c), types[c]) for c in columns))


def data_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, total: row count and sum of row hashes."""
    return df.select(hash32(row_text(df, columns)).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias("total"))


def missing_keys(source: DataFrame, target: DataFrame, key: list[str], rejects: DataFrame | None = None) -> DataFrame:
    """Source keys, less those of rejects, that the target has not. Buckets of keys are compared first, and only keys
    of unequal ones meet."""
    types = dict(source.dtypes)
    keys, held = source.select(*key), target.select(*(F.col(k).cast(types[k]).alias(k) for k in key))
    if rejects is not None:
        keys = keys.join(rejects.select(*key), key, "left_anti")
    keys, held = unequal_parts(keys, held, key)
    return keys.distinct().join(held, key, "left_anti")


def compare_rows(source: DataFrame, target: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, first_diff: the first column that differs, or ``(missing)``; NULL where all are equal."""
    t = target.select(*key, *(F.col(c).alias(f"_t_{c}") for c in columns), F.lit(True).alias("_there"))
    first = F.coalesce(*(F.when(~F.col(c).eqNullSafe(F.col(f"_t_{c}")), F.lit(c)) for c in columns))
    return source.join(t, key, "left").select(*key, F.when(F.col("_there").isNull(), "(missing)").otherwise(first).alias("first_diff"))


def null_counts(source: DataFrame, target: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_source, n_target."""

    def one(df: DataFrame, n: str) -> DataFrame:
        row = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns))
        return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias(n)) for c in columns))).alias("x")).select("x.*")

    return one(source, "n_source").join(one(target, "n_target"), "column_name")


def totals(df: DataFrame, columns: list[str], nullable: list[str], suffix: str) -> DataFrame:
    """One row from one pass: n, the sum of row hashes, and NULLs of each nullable column."""
    hashed = df.select(hash32(row_text(df, columns)).alias("h"), *(F.col(c).isNull().alias(f"_{k}") for k, c in enumerate(nullable)))
    total = F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).alias(f"total_{suffix}")
    return hashed.agg(F.count(F.lit(1)).alias(f"n_{suffix}"), total, F.array(*(F.count(F.when(F.col(f"_{k}"), 1)) for k in range(len(nullable)))).alias(f"nulls_{suffix}"))


def post_suite(source: DataFrame, target: DataFrame, rejects: DataFrame, key: list[str], columns: list[str], sample: DataFrame, nullable: list[str]) -> DataFrame:
    """P01 to P06. ``source``: mapped rows of the run; ``target``: rows of the run's keys.

    Count, checksum and NULL counts come from one pass over each side.
    """
    good = source.join(rejects.select(*key), key, "left_anti")
    both = totals(good, columns, nullable, "a").crossJoin(totals(target, columns, nullable, "b"))  # one row each
    nulls = F.size(F.filter(F.zip_with("nulls_a", "nulls_b", lambda x, y: x != y), lambda x: x))
    checks = [
        ("P01_row_count", "*", "ERROR", F.abs(F.col("n_a") - F.col("n_b"))),
        ("P05_checksum", ",".join(columns), "ERROR", F.when(F.col("total_a") == F.col("total_b"), 0).otherwise(1)),
        ("P06_null_counts", ",".join(nullable), "WARN", nulls),
    ]
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check_name"), F.lit(t).alias("target"), F.lit(bad).alias("bad"), n.cast("bigint").alias("n")) for c, t, bad, n in checks))).alias("f"))
    found = rows.select("f.check_name", "f.target", F.when(F.col("f.n") > 0, F.col("f.bad")).otherwise("PASS").alias("level"), "f.n")
    return all_of(
        found,
        finding("P02_missing_keys", ",".join(key), counted(missing_keys(source, target, key, rejects))),
        finding("P03_duplicate_keys", ",".join(key), counted(duplicate_keys(target, key))),
        finding("P04_sample", ",".join(columns), counted(compare_rows(sample, target, key, columns).where("first_diff IS NOT NULL"))),
    )


def pre_not_null(mapped: DataFrame, columns: list[str]) -> DataFrame:
    """C08: NULLs of each column that must not have any, in one pass."""
    one = mapped.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(f"c{k}") for k, c in enumerate(columns)))
    each = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("target"), F.col(f"c{k}").alias("n")) for k, c in enumerate(columns)))).alias("f")).select("f.*")
    return each.select(F.lit("C08_not_null").alias("check_name"), "target", F.when(F.col("n") > 0, "ERROR").otherwise("PASS").alias("level"), "n")


def pre_volume(measured: DataFrame, target: str, capacity: int, room: str = "1.35") -> DataFrame:
    """C12: bytes to expect, with room for blocks, against a capacity; WARN from 70 % of it. ``measured``: bytes."""
    n = F.ceil(F.col("bytes") * F.lit(room).cast("decimal(5,2)")).cast("bigint")
    level = F.when(F.col("n") > capacity, "ERROR").when(F.col("n") > int(0.7 * capacity), "WARN").otherwise("PASS")
    return measured.select(F.lit("C12_volume").alias("check_name"), F.lit(target).alias("target"), n.alias("n")).withColumn("level", level)


def pre_keys(source: DataFrame, target: DataFrame, key: list[str], insert_only: bool) -> DataFrame:
    """C09 duplicate source keys; C10, for INSERT ONLY, source keys that the target has."""
    found = finding("C09_duplicate_keys", ",".join(key), counted(duplicate_keys(source, key)))
    if insert_only:
        found = found.unionByName(finding("C10_existing_keys", ",".join(key), counted(target.select(*key).join(source.select(*key), key, "left_semi")), "WARN"))
    return found


def pre_foreign_keys(spark: SparkSession, keys: list[tuple[str, DataFrame, list[str], DataFrame, list[str]]]) -> DataFrame:
    """C11: orphans of each (name, child, foreign key, parent, key)."""
    return all_of(*(finding("C11_orphans", name, counted(orphans(c, fk, p, pk))) for name, c, fk, p, pk in keys))
