"""Scans, set operations and SELECT sources (A1-A8, C1-C3, D1-D3, F, G)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import incremental
from ..sources import scan
from ..spec import Mapping
from .fixtures import sql_source
from .registry import ORACLE_SQL, QUERIES, query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(c: str, name: str | None = None):
    return F.date_format(c, STAMP).alias(name or c)


def sql_stamp(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name or c}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def scan_scope(spark, sf_dir):
    scan.tables(spark, sf_dir, "orders")
    m = Mapping("t", (), ("o_orderkey",), table="orders", where="o_orderstatus = 'F' AND o_totalprice > 100000")
    return scan.source(spark, m).select("o_orderkey", "o_custkey", "o_totalprice")


_JOINED = "SELECT o.o_orderkey, c.c_name, o.o_orderstatus, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


@query(f"SELECT o_orderkey AS order_no, trim(c_name) AS member_name, o_totalprice AS total_amt FROM ({_JOINED}) S WHERE o_orderstatus <> 'P'")
def scan_sql_source(spark, sf_dir):
    scan.tables(spark, sf_dir, "orders", "customer")
    m = Mapping("t", (), ("order_no",), sql=_JOINED, where="o_orderstatus <> 'P'")
    return scan.source(spark, m).select(F.col("o_orderkey").alias("order_no"), F.trim("c_name").alias("member_name"), F.col("o_totalprice").alias("total_amt"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 5000 AND o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01'")
def scan_sql_binds(spark, sf_dir):
    scan.tables(spark, sf_dir, "orders")
    m = Mapping("t", (), ("o_orderkey",), sql="SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > :LAST_ID AND o_orderstatus = :STATUS AND o_orderdate >= :FROM_DT")
    return scan.source(spark, m, {"LAST_ID": 5000, "STATUS": "O", "FROM_DT": dt.datetime(1995, 1, 1)})


@query("SELECT event_id, user_id, event_id AS __cp FROM events WHERE event_id > 4000")
def scan_incremental(spark, sf_dir):
    return scan.after(events(spark, sf_dir), "event_id", 4000).select("event_id", "user_id", F.col("event_id").alias("__cp"))


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-19 23:55:00'")
def scan_lag_window(spark, sf_dir):
    last = dt.datetime(2024, 1, 10)
    upper = incremental.upper_bound(dt.datetime(2024, 1, 20), 300, last)
    return scan.after(events(spark, sf_dir), "ts", last, upper).select("event_id", "user_id")


@query("WITH b AS (SELECT o_orderkey, ntile(4) OVER (ORDER BY o_orderkey) AS bucket FROM orders) SELECT bucket, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM b GROUP BY bucket")
def scan_ranges(spark, sf_dir):
    """Each range of the plan is read by its own predicate; together they are the table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    plan = scan.range_plan(orders, "o_orderkey", 4).orderBy("bucket").collect()  # a row a worker
    parts = [
        scan.in_range(orders, "o_orderkey", plan[k - 1]["high"] if k else r["low"], r["high"], k == 0).withColumn("bucket", F.lit(r["bucket"]).cast("bigint"))
        for k, r in enumerate(plan)
    ]
    read = parts[0]
    for p in parts[1:]:
        read = read.unionByName(p)
    return read.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("SELECT o_orderkey, o_orderpriority, upper(o_orderpriority) AS priority FROM orders ORDER BY o_orderkey LIMIT 20")
def preview_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", F.upper("o_orderpriority").alias("priority"))
    return scan.preview(df, ["o_orderkey"], 20)


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS n_table, (SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c_acctbal < 0) AS n_sql")
def scope_count(spark, sf_dir):
    scan.tables(spark, sf_dir, "orders", "customer")
    a = scan.source(spark, Mapping("t", (), ("k",), table="orders", where="o_totalprice > 200000")).agg(F.count(F.lit(1)).alias("n_table"))
    b = scan.source(spark, Mapping("t", (), ("k",), sql="SELECT c_acctbal FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", where="c_acctbal < 0")).agg(F.count(F.lit(1)).alias("n_sql"))
    return a.crossJoin(b)  # one row each


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderkey BETWEEN 100 AND 9000")
def filter_where(spark, sf_dir):
    scan.tables(spark, sf_dir, "orders")
    df = scan.source(spark, Mapping("t", (), ("k",), table="orders", where="o_orderpriority LIKE '1%'"))
    return df.where(F.col("o_orderkey").between(100, 9000)).select("o_orderkey", "o_totalprice")


# SELECT sources. Each runs as a mapping: the SELECT with its binds, a filter over it, and the mapped columns
# (name:type, or name:type:expression); the oracle has the wrapped text written out.
SELECTS: dict[str, tuple[str, str, str, str | None, dict, str]] = {
    "sql_join_inner": (
        "SELECT o_orderkey, c_name, l_linenumber, l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > :least",
        "orders customer lineitem", "o_orderkey:bigint c_name:string:trim(c_name) l_linenumber:int l_quantity:double", "l_linenumber < 6", {"least": 45},
        "SELECT o_orderkey, trim(c_name) AS c_name, l_linenumber, l_quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE l_linenumber < 6",
    ),
    "sql_join_left": (
        "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < :region) g ON c_nationkey = n_nationkey",
        "customer nation", "c_custkey:bigint c_name:string n_name:string:upper(n_name)", "c_custkey % 3 <> 0", {"region": 2},
        "SELECT c_custkey, c_name, upper(n_name) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) g ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0",
    ),
    "sql_join_cross": (
        "SELECT n_name, r_name FROM nation, region WHERE n_nationkey < :keys", "nation region", "n_name:string r_name:string", "r_name <> 'ASIA'", {"keys": 10},
        "SELECT n_name, r_name FROM nation, region WHERE n_nationkey < 10 AND r_name <> 'ASIA'",
    ),
    "sql_group_by": (
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top, MIN(o_totalprice) AS low FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING COUNT(*) > :least",
        "orders", "o_orderstatus:string o_orderpriority:string n:bigint top:double low:double", "o_orderstatus <> 'P'", {"least": 10},
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n, MAX(o_totalprice) AS top, MIN(o_totalprice) AS low FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus, o_orderpriority HAVING COUNT(*) > 10",
    ),
    "sql_distinct": (
        "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "lineitem", "l_returnflag:string l_linestatus:string l_linenumber:int", "l_linenumber > 1", {},
        "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_linenumber > 1",
    ),
    "sql_count_distinct": (
        "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_quantity <= :most GROUP BY l_returnflag",
        "lineitem", "l_returnflag:string parts:bigint suppliers:bigint", None, {"most": 40},
        "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_quantity <= 40 GROUP BY l_returnflag",
    ),
    "sql_union": (
        "SELECT c_nationkey AS k, 'C' AS kind FROM customer UNION SELECT s_nationkey, 'S' FROM supplier UNION ALL SELECT n_nationkey, 'N' FROM nation",
        "customer supplier nation", "k:int kind:string:lower(kind)", "k < 20", {},
        "SELECT k, lower(kind) AS kind FROM (SELECT c_nationkey AS k, 'C' AS kind FROM customer UNION SELECT s_nationkey, 'S' FROM supplier UNION ALL SELECT n_nationkey, 'N' FROM nation) S WHERE k < 20",
    ),
    "sql_minus": (
        "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > :price", "customer orders", "k:bigint", "k % 2 = 0", {"price": 150000},
        "SELECT k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000) S WHERE k % 2 = 0",
    ),
    "sql_intersect": (
        "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer supplier", "k:int", "k > 3", {},
        "SELECT k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) S WHERE k > 3",
    ),
    "limit_n": (
        "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25", "customer", "c_custkey:bigint c_name:string", None, {},
        "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25",
    ),
    "cap_rows": (
        "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000) S", "lineitem", "n:bigint", None, {},
        "SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 1000) S",
    ),
    "sql_rollup": (
        "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", "customer", "c_mktsegment:string c_nationkey:int n:bigint", "n > 1", {},
        "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) HAVING COUNT(*) > 1",
    ),
}
for _name, (*_source, _sql) in SELECTS.items():
    QUERIES[_name], ORACLE_SQL[_name] = sql_source(*_source), _sql


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders QUALIFY position <= 1000")
def order_by_checkpoint(spark, sf_dir):
    """The first rows in checkpoint order, numbered in that order."""
    first = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(1000)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("position"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|s'), c_custkey LIMIT 100")
def sample_n(spark, sf_dir):
    return scan.sample_n(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), ["c_custkey"], 100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 5")
def sample_percent(spark, sf_dir):
    return scan.sample_percent(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


@query(f"SELECT ntile_ AS bucket, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS low, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS high, count(*) AS n FROM (SELECT ts, CAST(ntile(7) OVER (ORDER BY ts) AS INTEGER) AS ntile_ FROM events WHERE event_type <> 'none') GROUP BY ntile_")
def range_plan_ntile(spark, sf_dir):
    plan = scan.range_plan(events(spark, sf_dir).where("event_type <> 'none'"), "ts", 7)
    return plan.select("bucket", stamp("low"), stamp("high"), "n")
