"""Catalog frames, matching of tables and columns between two catalogs, and type compatibility.

A catalog frame has a row for each column: table_name, kind (TABLE or VIEW), column_name, data_type, ordinal,
nullable. Files carry no keys, so primary and foreign keys are declared, and can be held against the rows; a database
is asked for them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profile import duplicate_keys, orphans

#: Prefixes and suffixes that table names carry.
PREFIXES, SUFFIXES = ("SRC_", "TB_", "TBL_", "T_", "MST_"), ("_TB", "_T")
#: Name endings that stand for each other, source to target.
ENDINGS = [("_NM", "_NAME"), ("_CD", "_CODE"), ("_DT", "_AT"), ("_DT", "_DATE"), ("_FLAG", "_YN")]

CATALOG = "table_name string, kind string, column_name string, data_type string, ordinal int, nullable boolean"
#: A declared key: table, columns, and for a foreign key the parent and its columns.
Key = tuple[str, list[str], str | None, list[str] | None]


def catalog(spark: SparkSession, frames: Mapping[str, DataFrame], kind: str = "TABLE") -> DataFrame:
    rows = [(t, kind, f.name, f.dataType.simpleString(), k + 1, f.nullable) for t, df in frames.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, CATALOG)


def with_keys(spark: SparkSession, columns: DataFrame, keys: list[Key]) -> DataFrame:
    """Catalog columns with their place in the primary key and the column that a foreign key names."""
    own = [(t, c, k + 1) for t, cs, parent, _ in keys if parent is None for k, c in enumerate(cs)]
    foreign = [(t, c, f"{parent}.{pc}") for t, cs, parent, pcs in keys if parent is not None for c, pc in zip(cs, pcs or [], strict=True)]
    pk = spark.createDataFrame(own, "table_name string, column_name string, pk_position int")
    fk = spark.createDataFrame(foreign, "table_name string, column_name string, refers_to string")
    fk = fk.groupBy("table_name", "column_name").agg(F.array_join(F.array_sort(F.collect_list("refers_to")), ",").alias("refers_to"))
    on = ["table_name", "column_name"]
    return columns.join(F.broadcast(pk), on, "left").join(F.broadcast(fk), on, "left")  # declared keys are few


def of_database(spark: SparkSession, url: str, schema: str | None = None, **options: str) -> tuple[DataFrame, list[Key]]:
    """The columns of a database's tables and views, with types as declared, and its primary and foreign keys, by JDBC
    metadata: a row a column, whatever the tables hold. ``options``: user, password, and what else the driver takes."""
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        meta = connection.getMetaData()

        def rows(found, *columns: str) -> list[tuple]:
            out = []
            while found.next():
                out.append(tuple(found.getObject(c) for c in columns))
            found.close()
            return out

        wanted = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 2)
        wanted[0], wanted[1] = "TABLE", "VIEW"
        kinds = dict(rows(meta.getTables(None, schema, "%", wanted), "TABLE_NAME", "TABLE_TYPE"))
        columns, keys = [], []
        for t, c, kind, size, scale, ordinal, nullable in rows(meta.getColumns(None, schema, "%", "%"), "TABLE_NAME", "COLUMN_NAME", "TYPE_NAME", "COLUMN_SIZE", "DECIMAL_DIGITS", "ORDINAL_POSITION", "NULLABLE"):
            if t in kinds:
                columns.append((t, kinds[t], c, declared(kind, size, scale), ordinal, nullable != 0))
        for t in sorted(kinds):
            own = sorted(rows(meta.getPrimaryKeys(None, schema, t), "KEY_SEQ", "COLUMN_NAME"))
            if own:
                keys.append((t, [c for _, c in own], None, None))
            foreign: dict[tuple, list[tuple]] = {}
            for name, parent, seq, c, pc in rows(meta.getImportedKeys(None, schema, t), "FK_NAME", "PKTABLE_NAME", "KEY_SEQ", "FKCOLUMN_NAME", "PKCOLUMN_NAME"):
                foreign.setdefault((name, parent), []).append((seq, c, pc))
            keys += [(t, [c for _, c, _ in sorted(x)], parent, [pc for *_, pc in sorted(x)]) for (_, parent), x in sorted(foreign.items(), key=str)]
    finally:
        connection.close()
    return spark.createDataFrame(columns, CATALOG), keys


def declared(kind: str, size: int | None, scale: int | None) -> str:
    """A type's text with its length, or its digits and decimals."""
    kind = kind.lower().replace("numeric", "decimal")
    if kind.endswith(("char", "varchar", "varchar2", "raw")) and size:
        return f"{kind}({size})"
    return f"{kind}({size},{scale or 0})" if kind in ("decimal", "number") and size else kind


def held_keys(frames: Mapping[str, DataFrame], keys: list[Key]) -> DataFrame:
    """table_name, kind, columns, refers_to, n_bad: rows against each declared key, as repeated keys or orphans."""
    out = []
    for t, cs, parent, pcs in keys:
        bad = duplicate_keys(frames[t], cs) if parent is None else orphans(frames[t], cs, frames[parent], pcs or [])
        row = bad.agg(F.count(F.lit(1)).alias("n_bad"))
        out.append(row.select(F.lit(t).alias("table_name"), F.lit("FK" if parent else "PK").alias("kind"), F.lit(",".join(cs)).alias("columns"), F.lit(parent).cast("string").alias("refers_to"), "n_bad"))
    return reduce(DataFrame.unionByName, out)


def stats(df: DataFrame, table: str, exact: bool = False) -> DataFrame:
    """table_name, column_name, n_rows, n_null, n_distinct, in one pass. Distinct counts are sketches unless
    ``exact``, which shuffles the rows once for each column."""
    distinct = F.countDistinct if exact else F.approx_count_distinct
    each = (F.struct(F.count(F.when(F.col(c).isNull(), 1)).alias("n_null"), distinct(c).alias("n_distinct")).alias(c) for c in df.columns)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *each)
    rows = one.select("n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in df.columns))).alias("x"))
    return rows.select(F.lit(table).alias("table_name"), "x.column_name", "n_rows", "x.s.n_null", "x.s.n_distinct")


def with_stats(columns: DataFrame, profiles: DataFrame) -> DataFrame:
    return columns.join(profiles, ["table_name", "column_name"], "left")


def bare(name: Column) -> Column:
    """A table's name without what it carries at both ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(name), f"^({'|'.join(PREFIXES)})", ""), f"({'|'.join(SUFFIXES)})$", "")


def _one_to_one(found: DataFrame, a: str, b: str) -> DataFrame:
    """The best pair of each a, and of those the best of each b; by rank, then by name."""
    order = lambda x: Window.partitionBy(x).orderBy("rank", a, b)
    best = found.withColumn("_n", F.row_number().over(order(a))).where("_n = 1")
    return best.withColumn("_n", F.row_number().over(order(b))).where("_n = 1").drop("_n")


def match_tables(sources: DataFrame, targets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """source_table, target_table, rank: equal bare names (1), then the dictionary (word, means) (2)."""
    s, t = sources.select("source_table", bare(F.col("source_table")).alias("b")), targets.select("target_table", bare(F.col("target_table")).alias("b"))
    same = s.join(t, "b").select("source_table", "target_table", F.lit(1).alias("rank"))
    meant = s.join(dictionary.select(F.upper("word").alias("b"), F.upper("means").alias("m")), "b").join(t.select("target_table", F.col("b").alias("m")), "m")
    return _one_to_one(same.unionByName(meant.select("source_table", "target_table", F.lit(2).alias("rank"))), "source_table", "target_table")


def map_columns(sources: DataFrame, targets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """source_column, target_column, rank, expression, for columns of one pair of tables (column_name,
    data_type): the same name (1), the dictionary (2), exchanged endings (3)."""
    s = sources.select(F.col("column_name").alias("source_column"), F.col("data_type").alias("source_type"), F.upper("column_name").alias("u"))
    t = targets.select(F.col("column_name").alias("target_column"), F.col("data_type").alias("target_type"), F.upper("column_name").alias("u"))
    renamed = [s.where(F.col("u").endswith(a)).withColumn("u", F.concat(F.expr(f"left(u, length(u) - {len(a)})"), F.lit(b))) for a, b in ENDINGS]
    endings = renamed[0]
    for r in renamed[1:]:
        endings = endings.unionByName(r)
    meant = s.join(dictionary.select(F.upper("word").alias("u"), F.upper("means").alias("m")), "u").drop("u").withColumnRenamed("m", "u")
    found = s.withColumn("rank", F.lit(1)).unionByName(meant.withColumn("rank", F.lit(2))).unionByName(endings.withColumn("rank", F.lit(3))).join(t, "u").drop("u")
    name, target, kind = F.col("source_column"), F.upper("target_column"), F.lower("source_type")
    expression = (
        F.when(kind.isin("date", "timestamp_ntz") & F.col("target_type").startswith("timestamp") & (kind != F.lower("target_type")), F.concat(F.lit("CAST("), name, F.lit(" AS TIMESTAMP)")))
        .when(target.endswith("_YN") & (kind == "string"), F.concat(F.lit("CASE WHEN "), name, F.lit(" IN ('Y', '1') THEN 'Y' ELSE 'N' END")))
        .when(target.rlike("PHONE|MOBILE|TEL") & (kind == "string"), F.concat(F.lit("regexp_replace("), name, F.lit(", '[^0-9]', '')")))
        .when(target.rlike("_NAME$|_NM$") & (kind == "string"), F.concat(F.lit("TRIM("), name, F.lit(")")))
        .otherwise(name)
    )
    return _one_to_one(found, "target_column", "source_column").select("source_column", "target_column", "rank", expression.alias("expression"))


def family(type_: Column) -> Column:
    """char, number, time, or the base name of a large or raw type."""
    t = F.lower(type_)
    return (
        F.when(t.rlike("^(n?varchar|string|n?char)"), "char")
        .when(t.rlike("^(decimal|number|int|bigint|double|float|smallint|tinyint)"), "number")
        .when(t.rlike("^(date|timestamp)"), "time")
        .when(t.rlike("^(nclob|clob|blob|long raw|long|raw|binary)"), F.regexp_extract(t, "^(nclob|clob|blob|long raw|long|raw|binary)", 1))
        .otherwise("other")
    )


#: Pairs of large and raw types that convert, with the kind of what happens.
LARGE = {
    ("char", "clob"): "fits", ("char", "nclob"): "fits", ("clob", "char"): "lob_truncation", ("nclob", "char"): "lob_truncation",
    ("clob", "nclob"): "charset", ("nclob", "clob"): "charset", ("long", "clob"): "to_lob", ("raw", "blob"): "fits", ("long raw", "blob"): "to_lob",
    ("binary", "blob"): "fits", ("raw", "binary"): "fits",
}
#: Levels of the kinds that don't pass.
LEVELS = {
    "truncation": "ERROR", "overflow": "ERROR", "unsupported": "ERROR", "parse": "WARN", "loses_fraction": "WARN", "format": "WARN", "to_text_short": "WARN",
    "lob_truncation": "WARN", "charset": "WARN", "to_lob": "WARN", "unmeasured": "INFO",
}


def compatibility(pairs: DataFrame) -> DataFrame:
    """``pairs`` with level (PASS, INFO, WARN, ERROR) and kind. Columns used: source_type, target_type,
    target_len, target_digits, max_chars, int_digits (the last two measured)."""
    s, t = family(F.col("source_type")), family(F.col("target_type"))
    length = F.when(F.col("target_len").isNull() | F.col("max_chars").isNull(), "unmeasured").when(F.col("max_chars") > F.col("target_len"), "truncation").otherwise("fits")
    digits = F.when(F.col("target_digits").isNull() | F.col("int_digits").isNull(), "unmeasured").when(F.col("int_digits") > F.col("target_digits"), "overflow").otherwise("fits")
    low = F.lower("source_type")
    declared = F.regexp_extract(low, r"^(?:decimal|number)\(([0-9]+)", 1).try_cast("int")
    precision = F.coalesce(declared, F.when(low == "int", 10).when(low == "bigint", 19), F.lit(38))
    need = precision + F.when(F.regexp_extract(low, r",\s*([0-9]+)\)", 1).try_cast("int") > 0, 2).otherwise(1)
    large = F.lit(None).cast("string")
    for (a, b), kind in LARGE.items():
        large = F.when((s == a) & (t == b), F.lit(kind)).otherwise(large)
    kind = (
        F.when((s == "other") | (t == "other"), "unsupported")
        .when((s == "char") & (t == "char"), length)
        .when((s == "number") & (t == "number"), digits)
        .when((s == "time") & (t == "time"), F.when(low.startswith("timestamp") & F.lower("target_type").startswith("date"), "loses_fraction").otherwise("fits"))
        .when((s == "number") & (t == "char"), F.when(F.col("target_len") < need, "to_text_short").otherwise("to_text"))
        .when((s == "time") & (t == "char"), "format")
        .when((s == "char") & t.isin("number", "time"), "parse")
        .when(s == t, "fits")
        .otherwise(F.coalesce(large, F.lit("unsupported")))
    )
    level = F.lit("PASS")
    for k, v in LEVELS.items():
        level = F.when(F.col("kind") == k, F.lit(v)).otherwise(level)
    return pairs.withColumn("kind", kind).withColumn("level", level)
