"""Sources and targets derived from the given tables, as SQL text that Spark and the oracle share.

The tables have no load target of their own, so one is derived: some of the customers with stale values,
and rows whose keys the source does not have.
"""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mapping as mp
from ..sources.scan import source, tables
from ..spec import ColumnMapping, Mapping
from ..storage import SnapshotTable, new_root

RUN_TS = "2024-02-01 00:00:00"

SRC = """SELECT c_custkey,
    CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN '   '
         WHEN c_custkey % 83 = 0 THEN c_name || ' with a very long tail' ELSE '  ' || c_name END AS c_name,
    c_nationkey, CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal, c_mktsegment,
    CASE WHEN c_custkey % 61 = 0 THEN NULL ELSE '(02)555-' || CAST(1000 + c_custkey % 9000 AS STRING) END AS c_phone
    FROM customer"""
JOINED = f"SELECT s.*, n.n_name FROM ({SRC}) s LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON s.c_nationkey = n.n_nationkey"
TGT = """SELECT c_custkey AS member_id, 'OLD ' || c_name AS member_name, 'OLD' AS member_grade,
    CAST(0 AS DECIMAL(13,2)) AS balance, '010-' || CAST(c_custkey AS STRING) AS mobile_no,
    CASE WHEN c_custkey % 70 = 0 THEN 'Y' ELSE 'N' END AS del_yn FROM customer WHERE c_custkey % 10 < 6
    UNION ALL SELECT c_custkey + 1000000, 'GONE ' || c_name, 'OLD', CAST(0 AS DECIMAL(13,2)), NULL,
    CASE WHEN c_custkey % 100 = 0 THEN 'Y' ELSE 'N' END FROM customer WHERE c_custkey % 50 = 0"""

MEMBER = Mapping(
    target="member",
    sql=JOINED,
    key=("member_id",),
    mode="MERGE",
    checkpoint="c_custkey",
    columns=(
        ColumnMapping("member_id", "c_custkey", "bigint", not_null=True),
        ColumnMapping("member_name", "trim(c_name)", "string", "REJECT", not_null=True, max_len=30),
        ColumnMapping("member_grade", "n_name", "string", "DEFAULT", "'NONE'"),
        ColumnMapping("balance", "c_acctbal * 1.05", "decimal(13,2)", max_digits=4),
        ColumnMapping("mobile_no", None, "string"),
        ColumnMapping("del_yn", None, "string"),
    ),
)

#: The same mapping in plain SQL, for the oracle.
WITH = f"""WITH src AS ({SRC}), tgt AS ({TGT}),
    m AS (SELECT c_custkey AS member_id, nullif(trim(c_name), '') AS member_name, coalesce(n_name, 'NONE') AS member_grade,
          CAST(c_acctbal * 1.05 AS DECIMAL(13,2)) AS balance
          FROM src LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20),
    chk AS (SELECT *, CASE WHEN member_name IS NULL THEN 1400 WHEN length(member_name) > 30 THEN 12899 WHEN abs(balance) >= 10000 THEN 1438 END AS err_num,
          CASE WHEN member_name IS NULL OR length(member_name) > 30 THEN 'member_name' WHEN abs(balance) >= 10000 THEN 'balance' END AS err_col FROM m),
    ok AS (SELECT member_id, member_name, member_grade, balance FROM chk WHERE err_num IS NULL),
    rej AS (SELECT * FROM chk WHERE err_num IS NOT NULL)"""
MERGED = """SELECT coalesce(t.member_id, o.member_id) AS member_id,
    CASE WHEN o.member_id IS NULL THEN t.member_name ELSE o.member_name END AS member_name,
    CASE WHEN o.member_id IS NULL THEN t.member_grade ELSE o.member_grade END AS member_grade,
    CASE WHEN o.member_id IS NULL THEN t.balance ELSE o.balance END AS balance, t.mobile_no, t.del_yn
    FROM tgt t FULL OUTER JOIN ok o ON t.member_id = o.member_id"""
MEMBER_OUT = "member_id, member_name, member_grade, CAST(balance AS DOUBLE) AS balance, mobile_no, del_yn"


@dataclasses.dataclass
class Members:
    spark: SparkSession
    source: DataFrame
    mapped: DataFrame
    checked: DataFrame
    good: DataFrame
    rejects: DataFrame
    target: DataFrame

    def table(self) -> SnapshotTable:
        """A target that exists, written to the shared folder, in buckets by key."""
        table = SnapshotTable(self.spark, new_root(self.spark, "member"), ["member_id"], buckets=8)
        table.commit(self.target)
        return table


def members(spark: SparkSession, sf_dir: str) -> Members:
    tables(spark, sf_dir, "customer", "nation")
    rows = source(spark, MEMBER)
    mapped = mp.map_columns(rows, MEMBER, RUN_TS)
    checked = mp.constraint_check(mp.map_columns(rows, MEMBER, RUN_TS, checked=True), MEMBER)
    good, rejects = mp.split(checked)
    return Members(spark, rows, mapped, checked, good, rejects, spark.sql(TGT))


def member_out(df: DataFrame) -> DataFrame:
    return df.withColumn("balance", F.col("balance").cast("double")).select("member_id", "member_name", "member_grade", "balance", "mobile_no", "del_yn")


def sql_source(text: str, names: str, columns: str, where: str | None, binds: dict[str, Any]):
    """A mapping whose source is a SELECT with binds, under a filter of its own and a projection."""
    spec = tuple(ColumnMapping(name, expr or name, type_) for name, type_, expr in ((c.split(":") + [""])[:3] for c in columns.split()))
    m = Mapping("t", spec, (), sql=text, where=where)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir, *names.split())
        return mp.map_columns(source(spark, m, binds), m, RUN_TS)

    return run
