"""Loads and their bookkeeping (A9-A17, B1, B2, B6, C4, C5, E2, E3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import load, profile
from ..operators import mapping as mp
from ..run import History, run_job
from ..spec import ColumnMapping, Job, Mapping, Strategy
from ..sources.scan import tables
from ..storage import SnapshotTable, new_root
from .fixtures import MEMBER, MEMBER_OUT, MERGED, RUN_TS, WITH, member_out, members
from .registry import query

KEY = ["member_id"]


@query(f"{WITH} SELECT {MEMBER_OUT} FROM ({MERGED}) x")
def load_merge(spark, sf_dir):
    m = members(spark, sf_dir)
    table = m.table()
    load.apply(table, "MERGE", m.good, KEY, run_id="r1")
    return member_out(table.read())


@query(f"{WITH} SELECT {MEMBER_OUT} FROM (SELECT * FROM tgt UNION ALL SELECT o.*, NULL, NULL FROM ok o WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE t.member_id = o.member_id)) x")
def load_insert_only(spark, sf_dir):
    m = members(spark, sf_dir)
    table = m.table()
    load.apply(table, "INSERT_ONLY", m.good, KEY)
    return member_out(table.read())


@query(f"{WITH} SELECT {MEMBER_OUT} FROM (SELECT o.*, NULL AS mobile_no, NULL AS del_yn FROM ok o) x".replace("NULL AS mobile_no", "CAST(NULL AS VARCHAR) AS mobile_no").replace("NULL AS del_yn", "CAST(NULL AS VARCHAR) AS del_yn"))
def load_truncate_insert(spark, sf_dir):
    m = members(spark, sf_dir)
    table = m.table()
    load.apply(table, "TRUNCATE_INSERT", m.good, KEY)
    return member_out(table.read())


@query(f"{WITH} SELECT {MEMBER_OUT} FROM (SELECT t.* FROM tgt t WHERE t.member_id NOT IN (SELECT member_id FROM ok) UNION ALL SELECT o.*, NULL, NULL FROM ok o) x")
def load_delete_insert(spark, sf_dir):
    m = members(spark, sf_dir)
    table = m.table()
    load.apply(table, "DELETE_INSERT", m.good, KEY)
    return member_out(table.read())


@query(f"{WITH} SELECT 'r1' AS run_id, member_id, err_num, err_col, member_name FROM rej")
def reject_rows(spark, sf_dir):
    """Rejects are appended to the error table, by run."""
    m = members(spark, sf_dir)
    path = new_root(spark, "ERR_member")
    m.rejects.withColumn("run_id", F.lit("r1")).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.parquet(path).select(F.col("run_id").cast("string").alias("run_id"), "member_id", "err_num", "err_col", "member_name")


@query(f"{WITH} SELECT member_id, member_name, member_grade, CAST(balance AS DOUBLE) AS balance FROM m")
def map_columns(spark, sf_dir):
    return members(spark, sf_dir).mapped.withColumn("balance", F.col("balance").cast("double"))


RULES = Mapping(
    "t",
    (
        ColumnMapping("id", "c_custkey", "bigint"),
        ColumnMapping("allowed", "c_phone", "string", "ALLOW"),
        ColumnMapping("filled", "c_phone", "string", "DEFAULT", "'none'"),
        ColumnMapping("filled_number", "CASE WHEN c_custkey % 3 = 0 THEN c_custkey END", "bigint", "DEFAULT", "-1"),
        ColumnMapping("empty_default", "c_phone", "string", "DEFAULT", "''"),
        ColumnMapping("emptied", "c_phone", "string", "EMPTY"),
        ColumnMapping("custom", "c_phone", "string", "CUSTOM", "concat('id ', c_custkey)"),
        ColumnMapping("stamped", None, "timestamp", "SYSDATE"),
        ColumnMapping("constant", None, "string", "DEFAULT", "Y"),
        ColumnMapping("unwritten", None, "string", "ALLOW"),
    ),
    ("id",),
    table="customer",
)


@query(
    f"{WITH} SELECT c_custkey AS id, c_phone AS allowed, coalesce(c_phone, 'none') AS filled, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 END AS filled_number, c_phone AS empty_default, coalesce(c_phone, '') AS emptied, coalesce(c_phone, 'id ' || c_custkey) AS custom, '{RUN_TS}' AS stamped, 'Y' AS constant FROM src"
)
def null_rules(spark, sf_dir):
    rows = members(spark, sf_dir).source
    return mp.map_columns(rows, RULES, RUN_TS).withColumn("stamped", F.date_format("stamped", "yyyy-MM-dd HH:mm:ss"))


@query(f"{WITH} SELECT member_id, err_num, err_col FROM chk")
def constraint_check(spark, sf_dir):
    return members(spark, sf_dir).checked.select("member_id", "err_num", "err_col")


#: Orders as texts, of which some are no numbers, too large, empty or no dates.
RAW = """SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 11 = 0 THEN 'abc' WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '123456789012.5' ELSE CAST(o_custkey AS STRING) || '.25' END AS amount,
    CASE WHEN o_orderkey % 19 = 0 THEN '2024-13-45' WHEN o_orderkey % 23 = 0 THEN NULL ELSE '2024-01-' || CAST(10 + o_orderkey % 19 AS STRING) END AS day,
    CASE WHEN o_orderkey % 29 = 0 THEN '12x' ELSE CAST(o_custkey AS STRING) END AS code FROM orders"""
CONVERTED = Mapping(
    "amounts",
    (
        ColumnMapping("id", "id", "bigint", not_null=True),
        ColumnMapping("amount", "amount", "decimal(9,2)", "DEFAULT", "7", max_digits=6),
        ColumnMapping("day", "to_date(day, 'yyyy-MM-dd')", "date", "DEFAULT", "'2000-01-01'"),
        ColumnMapping("code", "CASE WHEN id % 2 = 0 THEN CAST(code AS INT) + 1 END", "int"),
    ),
    ("id",),
    sql=RAW,
)


@query(f"""WITH raw AS ({RAW}), c AS (SELECT id,
        CASE WHEN amount = 'abc' THEN 1722 WHEN amount = '123456789012.5' THEN 1438 WHEN day = '2024-13-45' THEN 1861 WHEN code = '12x' AND id % 2 = 0 THEN 1722 END AS err_num,
        CASE WHEN amount IN ('abc', '123456789012.5') THEN 'amount' WHEN day = '2024-13-45' THEN 'day' WHEN code = '12x' AND id % 2 = 0 THEN 'code' END AS err_col,
        CASE WHEN amount = '' THEN 7 ELSE TRY_CAST(amount AS DECIMAL(9,2)) END AS amount, CASE WHEN day IS NULL THEN '2000-01-01' ELSE day END AS day, CASE WHEN id % 2 = 0 THEN TRY_CAST(code AS INTEGER) + 1 END AS code FROM raw)
    SELECT id, CAST(err_num AS INTEGER) AS err_num, err_col, CASE WHEN err_num IS NULL THEN CAST(amount AS DOUBLE) END AS amount, CASE WHEN err_num IS NULL THEN day END AS day, CASE WHEN err_num IS NULL THEN CAST(code AS INTEGER) END AS code FROM c""")
def convert_rejects(spark, sf_dir):
    """A load of texts that don't all convert: rows that don't are rejects with their error, whatever default their
    column has, and the others are loaded."""
    tables(spark, sf_dir, "orders")
    table = SnapshotTable(spark, new_root(spark, "amounts"), ["id"])
    table.commit(spark.createDataFrame([], "id bigint, amount decimal(9,2), day date, code int"))
    run_job(spark, Job("amounts", (CONVERTED,)), {"amounts": table}, "r1", dt.datetime.fromisoformat(RUN_TS))
    rejects = spark.read.parquet(f"{table.root}/rejects/run_id=r1").select("id", "err_num", "err_col")
    loaded = table.read().select("id", F.col("amount").cast("double").alias("amount"), F.col("day").cast("string").alias("day"), "code")
    return loaded.unionByName(rejects, allowMissingColumns=True).select("id", "err_num", "err_col", "amount", "day", "code")


@query(f"{WITH} SELECT CASE WHEN t.member_id IS NULL THEN 'insert' WHEN o.member_id IS NULL THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM tgt t FULL OUTER JOIN ok o ON t.member_id = o.member_id GROUP BY 1")
def merge_match(spark, sf_dir):
    m = members(spark, sf_dir)
    both = m.target.select("member_id").withColumn("_t", F.lit(1)).join(m.good.select("member_id").withColumn("_s", F.lit(1)), "member_id", "full_outer")
    return both.groupBy(F.when(F.col("_t").isNull(), "insert").when(F.col("_s").isNull(), "keep").otherwise("update").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT count(*) AS n_updated FROM tgt WHERE member_id IN (SELECT member_id FROM ok)")
def existing_keys(spark, sf_dir):
    m = members(spark, sf_dir)
    return load.existing_keys(m.target, m.good, KEY).agg(F.count(F.lit(1)).alias("n_updated"))


@query(f"{WITH} SELECT (SELECT count(*) FROM chk) AS n_read, (SELECT count(*) FROM rej) AS n_rejected, (SELECT count(*) FROM ok WHERE member_id IN (SELECT member_id FROM tgt)) AS n_updated, (SELECT count(*) FROM ok WHERE member_id NOT IN (SELECT member_id FROM tgt)) AS n_inserted")
def dry_run_estimate(spark, sf_dir):
    m = members(spark, sf_dir)
    return load.estimate(m.target, m.checked, KEY)


@query(f"{WITH} SELECT 1 AS version, -1 AS batch_id, NULL AS watermark, (SELECT count(*) FROM tgt) AS n UNION ALL SELECT 2, 0, CAST((SELECT max(member_id) FROM ok) AS VARCHAR), (SELECT count(*) FROM ({MERGED}) x)")
def checkpoint_commit(spark, sf_dir):
    """Versions of a table, each with the watermark that was committed with it."""
    m = members(spark, sf_dir)
    table = m.table()
    last = m.good.agg(F.max("member_id")).first()[0]
    load.apply(table, "MERGE", m.good, KEY, batch_id=0, watermark=str(last))
    parts = [table.read(v).agg(F.lit(v).alias("version"), F.lit(f["batch_id"]).alias("batch_id"), F.lit(f["watermark"]).cast("string").alias("watermark"), F.count(F.lit(1)).alias("n")) for v in table.versions() for f in [table.manifest(v)]]
    return parts[0].unionByName(parts[1])


_RUN = "(SELECT count(*) FROM chk) AS n_read, (SELECT count(*) FROM ok WHERE member_id NOT IN (SELECT member_id FROM tgt)) AS n_inserted, (SELECT count(*) FROM ok WHERE member_id IN (SELECT member_id FROM tgt)) AS n_updated, (SELECT count(*) FROM rej) AS n_rejected"


@query(f"{WITH} SELECT 'r2' AS run_id, 'members' AS task, 'failed' AS status, {_RUN}, 'nowhere' AS message UNION ALL SELECT 'r2', 'member', 'done', {_RUN}, NULL UNION ALL SELECT 'r2', 'nowhere', 'failed', 0, 0, 0, 0, 'error'")
def run_history(spark, sf_dir):
    """A job of two mappings, of which one fails: the run, its tasks and their counts, as the history has them."""
    m = members(spark, sf_dir)
    lost = Mapping("nowhere", (ColumnMapping("id", "id", "bigint"),), ("id",), table="no_such_table")
    job = Job("members", (lost, MEMBER), Strategy(workers=2))
    history = History(spark, new_root(spark, "runs"))
    run_job(spark, job, {"member": m.table(), "nowhere": m.table()}, "r2", dt.datetime.fromisoformat(RUN_TS), history=history)
    said = F.when(F.col("task") == "nowhere", F.lit("error")).otherwise(F.col("message"))
    return history.latest().where("NOT contains(task, '#')").select("run_id", "task", "status", "n_read", "n_inserted", "n_updated", "n_rejected", said.alias("message"))


ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


#: Lines of which some have no order number: a key with a NULL in it equals none.
NULLED = "SELECT CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate FROM lineitem"


@query(f"WITH s AS ({NULLED}) SELECT l_orderkey IS NULL AS no_key, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM (SELECT * FROM s WHERE l_orderkey IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in ORDER.split(', '))}) = 1 UNION ALL SELECT * FROM s WHERE l_orderkey IS NULL) GROUP BY 1")
def dedup_null_keys(spark, sf_dir):
    """The last row of each whole key, and all rows without one."""
    tables(spark, sf_dir, "lineitem")
    df = mp.dedup_last(spark.sql(NULLED), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ORDER.split(", ")])
    return df.groupBy(F.col("l_orderkey").isNull().alias("no_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in ORDER.split(', '))}) = 1")
def dedup_last(spark, sf_dir):
    df = mp.dedup_last(_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ORDER.split(", ")])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"SELECT CASE WHEN rn > 1 THEN 1 END AS err_num, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM (SELECT l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER}) AS rn FROM lineitem) GROUP BY 1")
def dedup_first_reject(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumns({"err_num": F.lit(None).cast("int"), "err_col": F.lit(None).cast("string")})
    marked = mp.first_wins(df, ["l_orderkey", "l_linenumber"], [F.col(c) for c in ORDER.split(", ")])
    return marked.groupBy("err_num").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


@query(f"{WITH} SELECT CAST(count(*) FILTER (err_num = 1400) AS BIGINT) AS n_not_null, CAST(count(*) FILTER (err_num IS NULL AND member_id IN (SELECT member_id FROM tgt)) AS BIGINT) AS n_existing FROM chk")
def expected_rejects(spark, sf_dir):
    m = members(spark, sf_dir)
    known = m.target.select("member_id").distinct().withColumn("_known", F.lit(True))
    return m.checked.join(known, "member_id", "left").agg(
        F.count(F.when(F.col("err_num") == mp.NOT_NULL, 1)).alias("n_not_null"),
        F.count(F.when(F.col("err_num").isNull() & F.col("_known"), 1)).alias("n_existing"),
    )


@query(f"{WITH} SELECT CAST(err_num AS INTEGER) AS err_num, min(err_col) AS err_col, count(*) AS n FROM rej GROUP BY err_num")
def reject_summary(spark, sf_dir):
    return members(spark, sf_dir).rejects.groupBy("err_num").agg(F.min("err_col").alias("err_col"), F.count(F.lit(1)).alias("n"))


@query(f"{WITH} SELECT err_num, n FROM (SELECT err_num, count(*) AS n FROM rej GROUP BY err_num) ORDER BY n DESC, err_num LIMIT 2")
def top_rejects(spark, sf_dir):
    return members(spark, sf_dir).rejects.groupBy("err_num").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "err_num").limit(2)


@query("SELECT CAST(o_orderkey % 4 AS BIGINT) AS run, count(*) AS n_written, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_done, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 3) AS percent FROM orders GROUP BY 1")
def run_totals(spark, sf_dir):
    """Totals and percent done of runs; orders stand for the rows that tasks report."""
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    n = F.count(F.lit(1))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy((F.col("o_orderkey") % 4).alias("run")).agg(n.alias("n_written"), done.alias("n_done"), F.round(100.0 * done / n, 3).alias("percent"))


@query("SELECT cycle, n, CAST(sum(n) OVER (ORDER BY cycle) AS BIGINT) AS total FROM (SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS cycle, count(*) AS n FROM events GROUP BY 1)")
def sync_cycle_totals(spark, sf_dir):
    """Running totals over cycles: one row a cycle (here a day), so one window partition is small."""
    cycles = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("cycle")).agg(F.count(F.lit(1)).alias("n"))
    return cycles.withColumn("total", F.sum("n").over(Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)))


_VOLUME = "SELECT count(*) AS n, sum({0}) AS b FROM {1}"
_SIZES = {"orders": (28, ["o_orderstatus", "o_orderpriority"]), "lineitem": (60, ["l_returnflag", "l_linestatus"])}
_BYTES = " UNION ALL ".join(_VOLUME.format(" + ".join([str(w), *(f"coalesce(octet_length(encode({c})), 0)" for c in cs)]), t) for t, (w, cs) in _SIZES.items())


@query(f"WITH v AS ({_BYTES}), t AS (SELECT CAST(ceil(sum(b) * 1.35) AS BIGINT) AS bytes FROM v) SELECT bytes, CASE WHEN bytes > 1000000000000 THEN 'ERROR' WHEN bytes > 700000000000 THEN 'WARN' ELSE 'PASS' END AS level FROM t")
def volume_estimate(spark, sf_dir):
    """Measured row sizes (texts by their bytes, other columns by their width) with room for blocks, against a
    capacity of 1 TB."""
    sizes = [profile.volume(_table.select(*columns)) for _table, columns in _sized(spark, sf_dir)]
    total = sizes[0].unionByName(sizes[1]).agg(F.ceil(F.sum("bytes") * F.lit(1.35).cast("decimal(3,2)")).cast("bigint").alias("bytes"))
    level = F.when(F.col("bytes") > 10**12, "ERROR").when(F.col("bytes") > 7 * 10**11, "WARN").otherwise("PASS")
    return total.withColumn("level", level)


def _sized(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    yield read("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date")]
    yield read("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
