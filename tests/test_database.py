"""A database as a source: its catalog with keys, and reads split by ranges. The one that comes with Spark, in memory."""

import pytest

from tableferry.operators import catalog
from tableferry.sources import scan

URL = "jdbc:derby:memory:tableferry;create=true"


@pytest.fixture(scope="module")
def database(spark):
    connection = spark._jvm.java.sql.DriverManager.getConnection(URL)
    statement = connection.createStatement()
    for sql in (
        "CREATE TABLE CUSTOMER (ID BIGINT NOT NULL PRIMARY KEY, NAME VARCHAR(20), BALANCE DECIMAL(9,2))",
        "CREATE TABLE LINES (A INT NOT NULL, B INT NOT NULL, CUSTOMER_ID BIGINT REFERENCES CUSTOMER (ID), NOTE CHAR(3), PRIMARY KEY (B, A))",
        "CREATE TABLE PARTS (ID INT, A INT, B INT, FOREIGN KEY (B, A) REFERENCES LINES (B, A))",
        "CREATE VIEW RICH AS SELECT ID, NAME FROM CUSTOMER WHERE BALANCE > 100",
        *(f"INSERT INTO CUSTOMER VALUES ({k}, 'n{k}', {k * 3}.50)" for k in range(60)),
    ):
        statement.execute(sql)
    connection.close()
    return URL


def test_the_catalog_of_a_database_has_its_keys(spark, database):
    columns, keys = catalog.of_database(spark, database, "APP")
    got = {(r["table_name"], r["column_name"]): (r["kind"], r["data_type"], r["ordinal"], r["nullable"]) for r in columns.collect()}
    assert got["CUSTOMER", "BALANCE"] == ("TABLE", "decimal(9,2)", 3, True) and got["CUSTOMER", "ID"] == ("TABLE", "bigint", 1, False)
    assert got["RICH", "NAME"] == ("VIEW", "varchar(20)", 2, True) and got["LINES", "NOTE"][1] == "char(3)" and len(got) == 12
    assert sorted(keys, key=str) == sorted([
        ("CUSTOMER", ["ID"], None, None), ("LINES", ["B", "A"], None, None), ("LINES", ["CUSTOMER_ID"], "CUSTOMER", ["ID"]), ("PARTS", ["B", "A"], "LINES", ["B", "A"]),
    ], key=str)
    said = {(r["table_name"], r["column_name"]): (r["pk_position"], r["refers_to"]) for r in catalog.with_keys(spark, columns, keys).collect()}
    assert said["LINES", "A"] == (2, None) and said["LINES", "CUSTOMER_ID"] == (None, "CUSTOMER.ID") and said["PARTS", "B"] == (None, "LINES.B")


def test_a_table_is_read_in_ranges(spark, database):
    whole = scan.jdbc(spark, database, "APP.CUSTOMER")
    predicates = scan.range_predicates(scan.range_plan(whole, "ID", 4), "ID")
    parts = scan.jdbc(spark, database, "APP.CUSTOMER", predicates)
    assert parts.rdd.getNumPartitions() == 4 and sorted(parts.collect()) == sorted(whole.collect())
    plan = whole.where("ID > 50")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(ID,50)" in plan
