"""Profiles of a table that are kept by file and merged when they are asked for.

Each file is profiled once: rows, NULLs, longest text, and sketches of its distinct values and its quantiles. A table's profile is the union of those of its files, so after a load only the new files are read, and
none for files that went. Counts are exact; distinct values and quantiles are estimates of the sketches' usual error.
Deltas count once they are folded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Files, SnapshotTable

#: Types whose values have quantiles.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
SHAPE = "path string, column_name string, n_rows bigint, n_null bigint, max_chars int, hll binary, kll binary"


def _folder(table: SnapshotTable) -> str:
    return f"{table.root}/profiles"


def kept(table: SnapshotTable) -> DataFrame:
    """Profiles by file and column, as far as they have been made."""
    if not Files(table.spark, _folder(table)).names():
        return table.spark.createDataFrame([], SHAPE)
    return table.spark.read.schema(SHAPE).parquet(f"{_folder(table)}/*")


def update(table: SnapshotTable) -> int:
    """Profile the base files that have none yet, in one pass over them; how many those were."""
    live = [f["path"] for f in table.files() if f["columns"] is None]
    known = {r["path"] for r in kept(table).select("path").distinct().collect()}  # a row a file, as in the manifest
    todo = [p for p in live if p not in known]
    if todo:
        rows = table.spark.read.parquet(*(f"{table.root}/{p}" for p in todo))
        path = F.concat(F.lit("data/"), F.regexp_extract("_metadata.file_path", "/data/([^/]+/[^/]+)$", 1))
        measures = []
        for k, (c, kind) in enumerate(rows.dtypes):
            x = F.col(f"`{c}`")
            number = kind.split("(")[0] in NUMBERS
            measures += [
                F.count(F.when(x.isNull(), 1)).alias(f"n_null_{k}"),
                (F.max(F.char_length(x)) if kind == "string" else F.lit(None).cast("int")).alias(f"max_chars_{k}"),
                F.hll_sketch_agg(x if kind in ("int", "bigint", "string") else x.cast("string")).alias(f"hll_{k}"),
                (F.kll_sketch_agg_double(x.cast("double")) if number else F.lit(None).cast("binary")).alias(f"kll_{k}"),
            ]
        one = rows.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), *measures)
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), *(F.col(f"{m}_{k}").alias(m) for m in ("n_null", "max_chars", "hll", "kll"))) for k, c in enumerate(rows.columns)))
        made = one.select("path", "n_rows", F.explode(each).alias("c")).select("path", "c.column_name", "n_rows", "c.n_null", "c.max_chars", "c.hll", "c.kll")
        made.coalesce(1).write.parquet(f"{_folder(table)}/{uuid.uuid4().hex}")
    return len(todo)


def merged(table: SnapshotTable) -> DataFrame:
    """column_name, n_rows, n_null, max_chars, n_distinct (estimated), median (estimated, of numbers): of the table as
    it is now, from the profiles of its files."""
    update(table)
    live = table.spark.createDataFrame([(f["path"],) for f in table.files() if f["columns"] is None], "path string")
    rows = kept(table).dropDuplicates(["path", "column_name"]).join(live, "path", "left_semi")
    found = rows.groupBy("column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.max("max_chars").alias("max_chars"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"),
    )
    numbers = rows.where("kll IS NOT NULL AND n_rows > n_null").groupBy("column_name").agg(F.kll_merge_agg_double("kll").alias("kll"))
    medians = numbers.select("column_name", F.kll_sketch_get_quantile_double("kll", F.lit(0.5).cast("double")).alias("median"))
    return found.join(medians, "column_name", "left")
