"""Measuring columns, keys and references, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, hash32


def blank(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x.cast("string")) == "")


def _is_number(type_: str) -> bool:
    return type_.startswith(("decimal", "double", "float")) or type_ in ("int", "bigint", "smallint", "tinyint")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each column: n_rows, n_null, n_blank, max_chars, max_bytes, max_abs. One pass for all."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    measures = []
    for k, c in enumerate(columns):
        x, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        size = types[c] == "string"
        measures += [
            F.count(F.when(x.isNull(), 1)).alias(f"n_null_{k}"),
            F.count(F.when(blank(x), 1)).alias(f"n_blank_{k}") if size else F.lit(0).cast("bigint").alias(f"n_blank_{k}"),
            (F.max(F.char_length(text)) if size else F.lit(None)).cast("bigint").alias(f"max_chars_{k}"),
            (F.max(F.octet_length(text)) if size else F.lit(None)).cast("bigint").alias(f"max_bytes_{k}"),
            (F.max(F.abs(x)) if _is_number(types[c]) else F.lit(None)).cast("double").alias(f"max_abs_{k}"),
        ]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *measures)
    names = ("n_null", "n_blank", "max_chars", "max_bytes", "max_abs")
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{n}_{k}").alias(n) for n in names)) for k, c in enumerate(columns)))
    return one.select("n_rows", F.explode(each).alias("c")).select("c.column_name", "n_rows", *(f"c.{n}" for n in names))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys on more than one row, with how many; keys with a NULL part don't count."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, fk: list[str], parent: DataFrame, pk: list[str]) -> DataFrame:
    """Child rows whose whole foreign key has no parent."""
    whole = F.lit(True)
    for k in fk:
        whole = whole & F.col(k).isNotNull()
    keys = parent.select(*(F.col(p).alias(f) for f, p in zip(fk, pk, strict=True)))
    return child.where(whole).join(keys, fk, "left_anti")


def null_or_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n: rows that are NULL or blank."""
    one = df.agg(*(F.count(F.when(F.col(c).isNull() | blank(F.col(c)), 1)).alias(f"c{k}") for k, c in enumerate(columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{k}").alias("n")) for k, c in enumerate(columns)))).alias("c")).select("c.*")


def hash_buckets(df: DataFrame, text: Column, buckets: int, h: str = "h") -> DataFrame:
    """bucket, n, total: count and sum of hashes of the rows by hash."""
    return df.select(hash32(text).alias(h)).groupBy(F.pmod(h, F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(h).cast("decimal(38,0)")).alias("total"))


def unequal_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose counts or sums differ on the two sides."""
    left = a.select("bucket", F.col("n").alias("n_source"), F.col("total").alias("h_source"))
    right = b.select("bucket", F.col("n").alias("n_target"), F.col("total").alias("h_target"))
    return left.join(right, "bucket", "full_outer").where(~(F.col("n_source").eqNullSafe(F.col("n_target")) & F.col("h_source").eqNullSafe(F.col("h_target"))))


#: Buckets of a first comparison: their sums go to the driver.
BUCKETS = 1024


def unequal_parts(source: DataFrame, target: DataFrame, key: list[str], buckets: int = BUCKETS, always: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that lie in buckets whose keys differ; ``always``: rows of the target whose bucket is
    taken anyway, and which don't count in the comparison. Keys are summed where they are read, so that only those of
    unequal buckets are shuffled afterwards. Keys have the same types on both sides."""
    h = hash32(F.concat_ws(SEPARATOR, *(F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in key)))
    bucket = F.pmod(h, F.lit(buckets))
    plain = F.lit(True) if always is None else ~F.coalesce(always, F.lit(False))
    one = source.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("total"))
    two = target.groupBy(bucket.alias("bucket")).agg(F.count(F.when(plain, 1)).alias("m"), F.coalesce(F.sum(F.when(plain, h)), F.lit(0)).alias("other"), F.count(F.when(~plain, 1)).alias("taken"))
    n, m, total, other, taken = (F.coalesce(c, F.lit(0)) for c in ("n", "m", "total", "other", "taken"))
    bad = [r[0] for r in one.join(two, "bucket", "full_outer").where((n != m) | (total != other) | (taken > 0)).select("bucket").collect()]
    if len(bad) == buckets:
        return source, target
    return source.where(bucket.isin(bad)), target.where(bucket.isin(bad))


#: Bytes of a value by type.
WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def volume(df: DataFrame) -> DataFrame:
    """n_rows, bytes: rows and the bytes of their values. Texts and binaries count by their length, others by type."""
    fixed = sum(WIDTHS.get(t, 8) for _, t in df.dtypes if t not in ("string", "binary"))
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = F.lit(fixed).cast("bigint")
    for t in texts:
        size = size + t
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
