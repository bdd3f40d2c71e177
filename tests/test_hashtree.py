"""Descent through a tree of range hashes, bucket-first comparison, and what they leave unread."""

import random

import pytest
from pyspark.sql import functions as F

from tableferry.operators import hashtree, profile, reconcile, validate
from tableferry.storage import SnapshotTable, new_root


def sides(spark, n=5000):
    rng = random.Random(3)
    a = {k: f"v{k}" for k in range(-200, n)}
    b = dict(a)
    changed, gone, more = {1, n // 2, n - 3}, {77, -150}, {n + 40: "new", -900: "new"}
    b |= dict.fromkeys(changed, "other") | more
    for k in gone:
        b.pop(k)
    frame = lambda d: spark.createDataFrame(sorted(d.items(), key=lambda _: rng.random()), "id long, v string").repartition(3)
    return frame(a), frame(b), changed, gone, set(more)


@pytest.mark.parametrize("text_key", [False, True])
@pytest.mark.parametrize("most", [256, 0])
def test_differences_are_found_below_unequal_ranges_only(spark, monkeypatch, text_key, most):
    monkeypatch.setattr(hashtree, "MOST_FILTERS", most)
    a, b, changed, gone, more = sides(spark)
    shape = {"leaf": 8, "levels": 4, "fanout": 8}
    if text_key:
        a, b = (x.select(F.concat(F.lit("k"), "id").alias("id"), "v") for x in (a, b))
        shape = {"leaf": 1 << 50, "levels": 3, "fanout": 8}
    found = {r["id"]: r["action"] for r in hashtree.differences(a, b, ["id"], **shape).collect()}
    name = (lambda k: f"k{k}") if text_key else (lambda k: k)
    assert found == {name(k): "update" for k in changed} | {name(k): "insert" for k in gone} | {name(k): "delete" for k in more}
    levels = [x.collect() for x in hashtree.descend(a, b, ["id"], **shape)]
    assert len(levels) == shape["levels"] and all(0 < len(x) <= 7 for x in levels)
    for upper, lower in zip(levels, levels[1:]):
        assert {r["node"] // 8 for r in lower} <= {r["node"] for r in upper}


def test_equal_tables_take_one_pass(spark):
    a, *_ = sides(spark, 300)
    assert len(hashtree.descend(a, a, ["id"])) == 1 and hashtree.differences(a, a, ["id"]).count() == 0
    none = a.limit(0)
    assert hashtree.differences(none, none, ["id"]).count() == 0
    assert {r["action"] for r in hashtree.differences(a, none, ["id"]).collect()} == {"insert"}


def test_ranges_reach_the_scan(spark):
    path = new_root(spark, "x")
    spark.range(10_000).selectExpr("id", "id AS v").write.parquet(path)
    df = hashtree.within(spark.read.parquet(path), ["id"], [3, 4, 9], 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,300)" in plan and "LessThan(id,500)" in plan and df.count() == 300


def test_repair_merges_only_rows_that_differ(spark):
    a, b, changed, gone, more = sides(spark, 1000)
    loose = spark.createDataFrame([(None, "loose")], "id long, v string")
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"])
    table.commit(b.unionByName(loose))
    hashtree.repair(table, a.unionByName(loose), leaf=4)
    assert sum(f["rows"] for f in table.files() if f["columns"] is not None) == len(changed) + len(gone)
    want = sorted(map(tuple, a.collect())) + [(k, "new") for k in more]
    assert sorted(tuple(r) for r in table.read().where("id IS NOT NULL").collect()) == sorted(want)
    assert table.read().where("id IS NULL").count() == 1


def test_only_keys_of_unequal_buckets_meet(spark):
    a = spark.range(20_000).withColumn("x", F.lit(1))
    b = spark.range(20_000).where("id NOT IN (5, 17000)").selectExpr("CAST(id AS INT) AS id")
    some, other = profile.unequal_parts(a.select("id"), b.selectExpr("CAST(id AS BIGINT) AS id"), ["id"])
    assert 2 <= some.count() < 100 and other.count() == some.count() - 2
    assert sorted(r[0] for r in validate.missing_keys(a, b, ["id"]).collect()) == [5, 17000]
    rejects = spark.createDataFrame([(5,)], "id long")
    assert [r[0] for r in validate.missing_keys(a, b, ["id"], rejects).collect()] == [17000]
    target = spark.range(2, 20_002).selectExpr("CAST(id AS STRING) AS k", "id IN (7, 20001) AS marked")
    diff = reconcile.key_diff(spark.range(20_000).selectExpr("CAST(id AS STRING) AS k"), target)
    assert {r["k"]: r["action"] for r in diff.collect()} == {"0": "source_only", "1": "source_only", "7": "unmark", "20000": "mark", "20001": "already"}
