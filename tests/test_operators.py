import datetime as dt

import pytest
from pyspark.sql import functions as F

from tableferry.functions import text as ft
from tableferry.operators import catalog, incremental, load, mapping, profile, reconcile, validate
from tableferry.sources import scan
from tableferry.spec import ColumnMapping, Job, Mapping, Strategy
from tableferry.storage import SnapshotTable, new_root

STRICT = Mapping("strict", (ColumnMapping("id", "id", "bigint"), ColumnMapping("name", "name", "string", not_null=True, max_len=20)), ("id",), table="s")


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_job_survives_json():
    job = Job("j", (STRICT,), Strategy(workers=2))
    assert Job.from_json(job.to_json()) == job


def test_bad_specs_are_refused():
    with pytest.raises(ValueError):
        Mapping("t", (), ("id",))
    with pytest.raises(ValueError):
        ColumnMapping("a", "a", null_rule="NEVER")


def test_strict_target_rejects_half(spark):
    rows = spark.range(100).selectExpr("id", "rpad('n', IF(id % 2 = 0, 30, 10), 'x') AS name")
    good, rejects = mapping.split(mapping.constraint_check(mapping.map_columns(rows, STRICT, "2024-01-01"), STRICT))
    assert good.count() == 50 and rejects.count() == 50
    assert rejects.select("err_num").distinct().first()[0] == mapping.TOO_LONG


def test_merge_twice_is_merge_once(spark):
    target = spark.createDataFrame([(1, "a", "k"), (2, "b", None)], "id long, name string, extra string")
    rows = spark.createDataFrame([(2, "B"), (3, "C")], "id long, name string")
    once = load.merge(target, rows, ["id"])
    assert values(once, "id", "name", "extra") == values(load.merge(once, rows, ["id"]), "id", "name", "extra")
    assert ("k",) in values(once.where("id = 1"), "extra")
    assert once.where("id = 3").first()["name"] == "C"


def test_insert_only_rejects_known_keys(spark):
    target = spark.createDataFrame([(1, "a")], "id long, name string")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    out, rejects = load.insert_only(target, rows, ["id"])
    assert values(out, "id", "name") == [(1, "a"), (2, "y")]
    assert values(rejects, "id", "err_num") == [(1, mapping.DUPLICATE)]


def test_truncate_insert_refuses_a_watermark(spark):
    df = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(ValueError):
        load.truncate_insert(df, df, watermark=5)


def test_first_wins_and_last_wins(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, cp long, v string")
    assert values(mapping.dedup_last(rows, ["id"], [F.col("cp")]), "v") == [("b",), ("c",)]
    checked = rows.withColumns({"err_num": F.lit(None).cast("int"), "err_col": F.lit(None).cast("string")})
    assert values(mapping.first_wins(checked, ["id"], [F.col("cp")]).where("err_num = 1"), "v") == [("b",)]


@pytest.mark.parametrize("workers", [1, 3, 7])
def test_ranges_cover_ties_once(spark, workers):
    rows = spark.createDataFrame([(k // 5,) for k in range(83)], "cp long")
    plan = scan.range_plan(rows, "cp", workers).orderBy("bucket").collect()
    sizes = [r["n"] for r in plan]
    assert sum(sizes) == 83 and max(sizes) - min(sizes) <= 1
    read = sum(scan.in_range(rows, "cp", plan[k - 1]["high"] if k else r["low"], r["high"], k == 0).count() for k, r in enumerate(plan))
    assert read == 83
    assert len(scan.range_predicates(scan.range_plan(rows, "cp", workers), "cp")) == len(plan)


def test_ranges_of_nothing(spark):
    assert scan.range_plan(spark.createDataFrame([], "cp long"), "cp", 4).count() == 0


def test_reconcile_fixture(spark):
    source = spark.createDataFrame([(k, "ab ") for k in range(1, 21)], "id long, code string")
    target = spark.createDataFrame([(k, "ab  ", "Y" if k in (5, 23) else "N") for k in range(1, 24)], "id long, code string, del_yn string")
    key = ft.normalised_key([(F.col("id"), "bigint"), (F.col("code"), "char(5)")])
    diff = reconcile.key_diff(source.select(key.alias("k")), target.select(key.alias("k"), (F.col("del_yn") == "Y").alias("marked"), F.struct("id", "code").alias("key")))
    counts = {r["action"]: r["count"] for r in diff.groupBy("action").count().collect()}
    assert counts == {"mark": 2, "unmark": 1, "already": 1}
    table = SnapshotTable(spark, new_root(spark, "t"), ["id", "code"])
    table.commit(target)
    reconcile.mark(table, diff, "del_yn")
    assert [r["id"] for r in table.read().where("del_yn = 'Y'").orderBy("id").collect()] == [21, 22, 23]


def test_cap_blocks_an_empty_source(spark):
    empty = spark.createDataFrame([], "k string")
    target = spark.createDataFrame([("1", False)], "k string, marked boolean")
    assert reconcile.cap(reconcile.key_diff(empty, target), empty, target).first()["blocked"]


def test_seeded_defects_are_found(spark):
    parent = spark.createDataFrame([(1, "ok")], "id long, nm string")
    child = spark.createDataFrame([(1, 1, "12345"), (2, 9, "1234567890"), (2, 9, "dup"), (3, 9, None)], "id long, pid long, note string")
    assert profile.orphans(child, ["pid"], parent, ["id"]).count() == 3
    assert values(profile.duplicate_keys(child, ["id"]), "id", "n") == [(2, 2)]
    row = profile.column_profile(child, ["note"]).first()
    assert (row["n_null"], row["max_chars"]) == (1, 10)


@pytest.mark.parametrize("defect, check", [("none", None), ("value", "P05_checksum"), ("missing", "P02_missing_keys"), ("double", "P03_duplicate_keys")])
def test_post_suite_finds_the_defect(spark, defect, check):
    rows = spark.range(50).selectExpr("id", "concat('n', id) AS name", "CAST(id AS DECIMAL(12,2)) AS amount")
    target = {
        "none": rows,
        "value": rows.withColumn("name", F.when(F.col("id") == 7, "x").otherwise(F.col("name"))),
        "missing": rows.where("id <> 7"),
        "double": rows.union(rows.where("id = 7")),
    }[defect]
    none = rows.limit(0)
    found = validate.post_suite(rows, target, none, ["id"], ["name", "amount"], rows, ["name", "amount"])
    bad = {r["check_name"] for r in found.where("level <> 'PASS'").collect()}
    assert (check in bad) if check else not bad
    assert validate.verdict(found).first()["level"] == ("ERROR" if check else "PASS")


def test_commit_is_one_version_with_its_watermark(spark):
    table = SnapshotTable(spark, new_root(spark, "t"))
    assert table.manifest()["version"] == 0
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, ts timestamp_ntz")
    table.commit(rows)
    more = spark.createDataFrame([(2, dt.datetime(2024, 1, 2))], "id long, ts timestamp_ntz")
    state = incremental.run_cycle(table, more, ["id"], "ts", batch_id=0, last=None)
    again = incremental.run_cycle(table, more, ["id"], "ts", batch_id=0, last=None)
    assert state == again and state["version"] == 2 and table.read().count() == 2
    assert table.read(1).count() == 1


def test_source_dialect_functions(spark):
    row = spark.range(1).select(
        ft.initcap(F.lit("su-an o'neil")).alias("a"), ft.concat(F.lit(None), F.lit("")).alias("b"), ft.substr(F.lit("abc"), -9).alias("c"), ft.substr(F.lit("abc"), 0, 2).alias("d"),
        ft.trunc(F.lit(-1.29), 1).cast("double").alias("e"), ft.number_text(F.lit(100000000.0)).alias("f"), ft.greatest(F.lit(1), F.lit(None)).alias("g"), ft.trim(F.lit("  ")).alias("h"),
    ).first()
    assert tuple(row) == ("Su-An O'Neil", None, None, "ab", -1.2, "100000000", None, None)


def test_catalog_matching(spark):
    s = spark.createDataFrame([("SRC_ORDER",), ("SRC_CUSTOMER",), ("SRC_X",)], "source_table string")
    t = spark.createDataFrame([("TB_ORDER",), ("TB_MEMBER",)], "target_table string")
    words = spark.createDataFrame([("CUSTOMER", "MEMBER")], "word string, means string")
    assert values(catalog.match_tables(s, t, words), "source_table", "target_table") == [("SRC_CUSTOMER", "TB_MEMBER"), ("SRC_ORDER", "TB_ORDER")]


def test_ranges_are_read_from_a_database(spark):
    """A Derby database in memory: each range of a plan is a partition, and together they are the table."""
    url, driver = "jdbc:derby:memory:ferry;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(60).selectExpr("id", "IF(id % 9 = 0, NULL, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, id)) AS ts", "concat('it''s ', id) AS name")
    rows.write.jdbc(url, "src", mode="overwrite", properties=driver)
    whole = scan.jdbc(spark, url, "src", **driver)
    for column in ("id", "ts"):
        predicates = scan.range_predicates(scan.range_plan(whole, column, 4), f'"{column}"')
        read = scan.jdbc(spark, url, "src", predicates, **driver)
        assert read.rdd.getNumPartitions() == 4 == len(predicates)
        assert values(read, "id", "name") == values(rows, "id", "name")
    with pytest.raises(ValueError):
        scan.range_plan(whole, "name", 4)
    assert scan.sql_literal("it's") == "'it''s'" and scan.sql_literal(dt.date(2024, 1, 2)) == "{d '2024-01-02'}"
    assert scan.range_predicates(scan.range_plan(whole.where("id < 0"), "id", 4), "id") == ["1 = 1"]


def test_dedup_keeps_rows_without_a_whole_key(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, None, 2), (None, 2, 1), (3, 4, 1), (3, 4, 2)], "a int, b int, cp int")
    assert values(mapping.dedup_last(rows, ["a", "b"], [F.col("cp")]).fillna(0), "a", "b", "cp") == [(0, 2, 1), (1, 0, 1), (1, 0, 2), (3, 4, 2)]


def test_large_types_convert_by_their_own_rules(spark):
    pairs = [("clob", "varchar(20)", "WARN"), ("clob", "clob", "PASS"), ("string", "clob", "PASS"), ("clob", "nclob", "WARN"), ("long", "clob", "WARN"), ("raw(16)", "blob", "PASS"), ("blob", "clob", "ERROR"), ("clob", "date", "ERROR"), ("interval", "clob", "ERROR")]
    df = spark.createDataFrame([(*p, None, None, None, None) for p in pairs], "source_type string, target_type string, want string, target_len int, target_digits int, max_chars long, int_digits long")
    assert all(r["level"] == r["want"] for r in catalog.compatibility(df).collect())
