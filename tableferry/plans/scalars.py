"""Scalar functions and predicates (B, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..sources.scan import tables
from .fixtures import SRC
from .registry import query


def src(spark, sf_dir):
    tables(spark, sf_dir, "customer")
    return spark.sql(SRC)


@query(f"""WITH src AS ({SRC}) SELECT c_custkey, nullif(trim(c_name), '') AS trimmed, nullif(ltrim(c_name, ' C'), '') AS ltrimmed, nullif(rtrim(c_name, '0123456789'), '') AS rtrimmed,
    upper(c_name) AS up, lower(c_name) AS low,
    CASE WHEN length(trim(c_name)) >= 3 THEN substr(trim(c_name), 2, 3) END AS sub, CASE WHEN length(c_name) >= 4 THEN substr(c_name, length(c_name) - 3) END AS tail,
    nullif(replace(c_name, '#', ''), '') AS replaced, length(nullif(c_name, '')) AS len, lpad(c_mktsegment, 12, '*') AS padded, rpad(c_mktsegment, 5, '*') AS cut,
    nullif(coalesce(c_name, '') || '/' || coalesce(c_phone, ''), '') AS joined FROM src""")
def fn_string(spark, sf_dir):
    x, t = F.col("c_name"), F.trim("c_name")
    return src(spark, sf_dir).select(
        "c_custkey", ft.trim(x).alias("trimmed"), ft.trim(x, " C", "left").alias("ltrimmed"), ft.trim(x, "0123456789", "right").alias("rtrimmed"),
        F.upper(x).alias("up"), F.lower(x).alias("low"), F.when(F.char_length(t) >= 3, ft.substr(t, 2, 3)).alias("sub"), ft.substr(x, -4).alias("tail"),
        ft.null_if_empty(F.replace(x, F.lit("#"), F.lit(""))).alias("replaced"), F.char_length(ft.null_if_empty(x)).cast("bigint").alias("len"),
        F.lpad("c_mktsegment", 12, "*").alias("padded"), F.rpad("c_mktsegment", 5, "*").alias("cut"), ft.concat(x, F.lit("/"), F.col("c_phone")).alias("joined"),
    )


@query("SELECT n_nationkey, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) || '-' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name FROM (SELECT n_nationkey, regexp_replace(n_name, '[^A-Za-z]', '', 'g') AS n_name FROM nation)")
def fn_initcap(spark, sf_dir):
    """A word starts after a hyphen too."""
    n = F.regexp_replace("n_name", "[^A-Za-z]", "")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", ft.initcap(F.concat(F.lower(n), F.lit("-"), F.upper(n))).alias("name"))


@query(f"WITH src AS ({SRC}) SELECT c_custkey, coalesce(c_name, 'none') AS nvl, CASE WHEN c_phone IS NOT NULL THEN 'has' ELSE 'lacks' END AS nvl2, coalesce(c_phone, c_name, 'x') AS first, CASE WHEN c_phone IS NULL THEN 'null' WHEN c_phone = '(02)555-1001' THEN 'one' ELSE 'other' END AS decoded, CASE WHEN c_name IS NOT NULL AND c_phone IS NOT NULL THEN greatest(c_name, c_phone) END AS top FROM src")
def fn_null(spark, sf_dir):
    return src(spark, sf_dir).select(
        "c_custkey", F.nvl("c_name", F.lit("none")).alias("nvl"), F.nvl2("c_phone", F.lit("has"), F.lit("lacks")).alias("nvl2"), F.coalesce("c_phone", "c_name", F.lit("x")).alias("first"),
        F.expr("decode(c_phone, NULL, 'null', '(02)555-1001', 'one', 'other')").alias("decoded"), ft.greatest(F.col("c_name"), F.col("c_phone")).alias("top"),
    )


@query(f"WITH src AS ({SRC}) SELECT c_custkey, nullif(regexp_replace(c_phone, '[^0-9]', '', 'g'), '') AS digits, nullif(regexp_replace(c_name, '[0-9]+', '', 'g'), '') AS letters, nullif(regexp_extract(c_phone, '[0-9]+$'), '') AS tail FROM src")
def fn_regex(spark, sf_dir):
    return src(spark, sf_dir).select("c_custkey", ft.regexp_replace(F.col("c_phone"), "[^[:digit:]]").alias("digits"), ft.regexp_replace(F.col("c_name"), "[[:digit:]]+").alias("letters"), ft.regexp_substr(F.col("c_phone"), "[[:digit:]]+$").alias("tail"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, strftime(o_orderdate, '%Y%m') AS month, strftime(date_trunc('day', o_orderdate) + INTERVAL 7 DAY, '%Y/%m/%d') AS week_on, strftime(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d'), '%Y-%m-%d') AS parsed, o_orderkey % 2 = 0 AS bad FROM orders")
def fn_date(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.lit("not a date")).otherwise(ft.to_char(d, "YYYYMMDD"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", ft.to_char(d, "YYYY-MM-DD HH24:MI:SS").alias("text"), ft.to_char(d, "YYYYMM").alias("month"),
        ft.to_char(F.date_trunc("DAY", d) + F.expr("make_dt_interval(7)"), "YYYY/MM/DD").alias("week_on"),
        ft.to_char(ft.to_date(ft.to_char(d, "YYYYMMDD"), "YYYYMMDD"), "YYYY-MM-DD").alias("parsed"), ft.failed(text, ft.to_date(text, "YYYYMMDD")).alias("bad"),
    )


@query("WITH x AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(15,2)) AS b FROM customer) SELECT c_custkey, CAST(round(b, 1) AS DOUBLE) AS rounded, CAST(trunc(b) AS DOUBLE) AS cut, CAST(trunc(b * 10) / 10 AS DOUBLE) AS cut1, CAST(abs(b) AS DOUBLE) AS size, CAST(c_custkey % 7 AS BIGINT) AS rest, CAST(-c_custkey % 7 AS BIGINT) AS minus_rest, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS DOUBLE) / (c_custkey % 5) END AS ratio FROM x")
def fn_math(spark, sf_dir):
    b = F.col("c_acctbal").cast("decimal(15,2)")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", F.round(b, 1).cast("double").alias("rounded"), ft.trunc(b).cast("double").alias("cut"), ft.trunc(b, 1).cast("double").alias("cut1"), F.abs(b).cast("double").alias("size"),
        (F.col("c_custkey") % 7).alias("rest"), (-F.col("c_custkey") % 7).alias("minus_rest"), F.try_divide(F.col("c_custkey").cast("double"), F.col("c_custkey") % 5).alias("ratio"),
    )


@query(f"WITH src AS ({SRC}), x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE ' ' || c_custkey || '.50 ' END AS t, c_acctbal FROM src) SELECT c_custkey, CAST(TRY_CAST(trim(t) AS DECIMAL(20,2)) AS DOUBLE) AS number, TRY_CAST(trim(t) AS DECIMAL(20,2)) IS NULL AS bad, rpad(CAST(c_custkey AS VARCHAR), 8, ' ') AS fixed, CASE WHEN CAST(c_acctbal AS VARCHAR) LIKE '%.%' THEN rtrim(rtrim(CAST(c_acctbal AS VARCHAR), '0'), '.') ELSE CAST(c_acctbal AS VARCHAR) END AS text FROM x")
def fn_convert(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".50 ")))
    n = ft.to_number(t, "decimal(20,2)")
    return src(spark, sf_dir).select("c_custkey", n.cast("double").alias("number"), ft.failed(t, n).alias("bad"), F.rpad(F.col("c_custkey").cast("string"), 8, " ").alias("fixed"), ft.number_text(F.col("c_acctbal"), 2).alias("text"))


@query("SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT AS h, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 1024 AS bucket FROM customer")
def fn_hash(spark, sf_dir):
    h = ft.hash32(F.col("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", h.alias("h"), (h % 1024).alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || chr(31) || rtrim(o_orderstatus || '  ') || chr(31) || strftime(o_orderdate, '%Y%m%d%H%M%S') || chr(31) || CASE WHEN CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) LIKE '%.%' THEN rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR), '0'), '.') END END AS k FROM orders")
def normalize_key(spark, sf_dir):
    """Number, fixed-length text, date and amount; a key with a NULL part is NULL."""
    key = ft.normalised_key([
        (F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")), "bigint"),
        (F.concat("o_orderstatus", F.lit("  ")), "char(3)"),
        (F.col("o_orderdate"), "date"),
        (F.col("o_totalprice").cast("decimal(15,2)"), "decimal(15,2)"),
    ])
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", key.alias("k"))


_PREDICATES = {
    "p_and_or_not": "(c_phone IS NULL OR c_acctbal > 0) AND NOT c_custkey = 5",
    "p_compare": "c_acctbal >= 100 AND c_name <> 'x' AND c_custkey < 900",
    "p_is_null": "c_name IS NULL",
    "p_like": "c_name LIKE '%00_1%'",
    "p_not_like": "c_name NOT LIKE '%7'",
    "p_in": "c_nationkey IN (1, 2, 3)",
    "p_not_in": "c_nationkey NOT IN (1, NULL)",
    "p_between": "c_acctbal BETWEEN 0 AND 5000",
    "p_case": "CASE c_mktsegment WHEN 'BUILDING' THEN c_custkey % 2 = 0 ELSE c_acctbal < 0 END",
    "p_arithmetic": "c_custkey * 2 + 1 - 3 > 100",
}


@query(f"WITH src AS ({SRC}) SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in _PREDICATES.items())} FROM src")
def expr_predicates(spark, sf_dir):
    return src(spark, sf_dir).select("c_custkey", *(F.expr(e).alias(n) for n, e in _PREDICATES.items()))
