"""A stream that runs a job's cycles, profiles by file, and samples of whole files."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tableferry.operators import fileprofile
from tableferry.run import History
from tableferry.spec import ColumnMapping, Job, Mapping, Strategy
from tableferry.storage import SnapshotTable, new_root
from tableferry.streaming.sync import StreamSync

NAMES = "id long, name string, ts timestamp_ntz"
COLUMNS = (ColumnMapping("id", "id", "bigint", not_null=True), ColumnMapping("name", "name", "string", max_len=5), ColumnMapping("del_yn", None))


def at(minute):
    return dt.datetime(2024, 1, 1, 12, minute)


class Source:
    """A folder that files arrive in, and what the source has by now."""

    def __init__(self, spark):
        self.spark, self.folder, self.rows = spark, new_root(spark, "arrivals"), []

    def add(self, *rows):
        self.rows += rows
        self.spark.createDataFrame(list(rows), NAMES).coalesce(1).write.mode("append").parquet(self.folder)
        self.show()

    def drop(self, key):
        self.rows = [r for r in self.rows if r[0] != key]
        self.show()

    def show(self):
        self.spark.createDataFrame(self.rows, NAMES).createOrReplaceTempView("stream_source")

    def stream(self):
        return self.spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 1).parquet(self.folder)


def made(spark, clock, **strategy):
    m = Mapping("t", COLUMNS, ("id",), table="stream_source", checkpoint="ts", delete_mode="MARK", mark_column="del_yn", delete_approved=True)
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=4)
    table.commit(spark.createDataFrame([], "id long, name string, del_yn string"))
    inbox, history = SnapshotTable(spark, new_root(spark, "inbox")), History(spark, new_root(spark, "runs"))
    return StreamSync(Job("s", (m,), Strategy("SYNC", lag_seconds=300, delete_ratio=1.0, **strategy)), table, inbox, clock, history)


def held(sync):
    return {r["id"]: (r["name"], r["del_yn"]) for r in sync.table.read().collect()}


def test_rows_wait_for_the_lag_and_deletions_for_their_time(spark):
    source, now = Source(spark), [at(10)]
    sync, checkpoint = made(spark, lambda: now[0], reconcile_minutes=10), new_root(spark, "c")
    source.add((1, "a", at(1)), (2, "b", at(8)), (3, "toolong", at(2)))
    sync.start(source.stream(), checkpoint).awaitTermination()
    assert held(sync) == {1: ("a", None)}  # 2 is within the lag, 3 a reject
    source.drop(1)
    now[0] = at(15)
    source.add((4, "late", at(6)), (2, "b2", at(9)))
    sync.start(source.stream(), checkpoint).awaitTermination()
    assert held(sync) == {1: ("a", None), 2: ("b2", None), 4: ("late", None)}  # a reconciliation isn't due yet
    assert sync.table.manifest()["watermark"] == str(at(10)) and sync.inbox.read().count() <= 5
    now[0] = at(21)
    sync.cycle()
    assert held(sync)[1] == ("a", "Y") and sync.table.manifest()["reconciled"] == str(at(21))
    done = sync.history.events().where("task = 't' AND status = 'done'").agg(F.sum("n_read"), F.sum("n_rejected")).first()
    assert tuple(done) == (4, 1)  # of rows with a key the last


def test_a_batch_that_comes_again_adds_nothing(spark):
    source, now = Source(spark), [at(30)]
    sync = made(spark, lambda: now[0], reconcile_minutes=9999)
    source.add((1, "a", at(1)), (2, "b", at(2)))
    batch = spark.createDataFrame(source.rows, NAMES)
    for _ in range(2):
        sync.take(batch, 0)
    assert sync.inbox.manifest()["batch_id"] == 0 and held(sync) == {1: ("a", None), 2: ("b", None)}
    assert sync.inbox.files() == []  # all lies before the watermark
    sync.table.fold()
    broken = sync.table.merge
    sync.table.merge = lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        sync.take(spark.createDataFrame([(5, "e", at(26))], NAMES), 1)
    sync.table.merge, now[0] = broken, at(40)
    sync.take(spark.createDataFrame([(5, "e", at(26))], NAMES), 1)
    assert held(sync)[5] == ("e", None) and len(held(sync)) == 3


def test_rows_behind_the_watermark_are_taken_but_undo_nothing(spark):
    source, now = Source(spark), [at(30)]
    sync, checkpoint = made(spark, lambda: now[0], reconcile_minutes=9999), new_root(spark, "c")
    sync.table.merge(spark.createDataFrame([(9, "held", None)], "id long, name string, del_yn string"))  # before the stream
    source.add((1, "a", at(10)), (2, "b", at(20)), (6, "soon", at(29)))
    sync.start(source.stream(), checkpoint).awaitTermination()
    assert sync.table.manifest()["watermark"] == str(at(25))
    # Late: a new key, a newer row, an older row, one of a key that was there before, and one that is late twice.
    source.add((3, "c", at(1)), (1, "a2", at(11)), (2, "old", at(5)), (9, "new?", at(2)), (4, "d2", at(4)), (4, "d", at(3)))
    forget, sync.inbox.forget = sync.inbox.forget, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(StreamingQueryException):
        sync.start(source.stream(), checkpoint).awaitTermination()
    sync.inbox.forget = forget
    want = {1: ("a2", None), 2: ("b", None), 3: ("c", None), 4: ("d2", None), 9: ("held", "Y")}  # the source had no 9 yet
    assert held(sync) == want
    sync.start(source.stream(), checkpoint).awaitTermination()  # the batch comes again
    assert held(sync) == want and sync.table.manifest()["watermark"] == str(at(25))
    now[0] = at(40)
    source.add((4, "d1", at(3)), (6, "late", at(28)))
    sync.start(source.stream(), checkpoint).awaitTermination()
    assert held(sync) == want | {6: ("soon", None)}
    done = sync.history.events().where("task = 't' AND status = 'done'").agg(F.sum("n_read")).first()
    assert done[0] == 6 and sync.inbox.files() == []  # each row that counts once


def test_a_stream_marks_any_number_of_rows_that_left(spark):
    now = [at(10)]
    sync = made(spark, lambda: now[0], reconcile_minutes=10)

    def rows(n):
        return spark.range(n).selectExpr("id", "'n' AS name", "TIMESTAMP_NTZ '2024-01-01 12:01:00' AS ts")

    rows(200_100).createOrReplaceTempView("stream_source")
    sync.take(rows(200_100), 0)
    assert sync.table.read().where("del_yn IS NULL").count() == 200_100
    rows(50).createOrReplaceTempView("stream_source")
    now[0] = at(21)
    sync.cycle()
    found = sync.table.read()
    assert found.where("del_yn = 'Y' AND id >= 50").count() == 200_050 and found.where("del_yn IS NULL AND id < 50").count() == 50 and found.count() == 200_100
    assert [r["message"] for r in sync.history.events().where("task = 't reconciled'").orderBy("seq").collect()] == [None, None]  # nothing was blocked


def test_a_profile_follows_files_that_come_and_go(spark):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=1)
    assert_rows = lambda: {r["column_name"]: r for r in fileprofile.merged(table).collect()}
    make = lambda a, b: spark.range(a, b, 1, 1).selectExpr("id", "IF(id % 4 = 0, NULL, concat('n', id % 50)) AS name", "CAST(NULL AS DOUBLE) AS x", "id % 2 = 0 AS even", "DATE '2024-01-01' AS day")
    table.commit(make(0, 0))
    assert {r["n_rows"] for r in assert_rows().values()} <= {0}
    table.insert(make(0, 1000))
    assert fileprofile.update(table) == 1 and fileprofile.update(table) == 0
    table.insert(make(1000, 3000))
    got = assert_rows()
    assert (got["id"]["n_rows"], got["name"]["n_null"], got["name"]["max_chars"], got["x"]["n_null"], got["x"]["median"]) == (3000, 750, 3, 3000, None)
    assert abs(got["id"]["n_distinct"] - 3000) < 150 and got["even"]["n_distinct"] == 2 and got["day"]["n_distinct"] == 1 and abs(got["id"]["median"] - 1500) < 60
    table.commit(make(0, 10))
    assert assert_rows()["id"]["n_rows"] == 10


def test_samples_open_files_in_proportion(spark):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=1)
    table.commit(spark.range(0).selectExpr("id", "'a' AS name"))
    for k in range(20):
        table.insert(spark.range(k * 100, k * 100 + 100, 1, 1).selectExpr("id", "'a' AS name"))
    assert [len(table.sample(p).inputFiles()) for p in (1, 10, 50, 100)] == [1, 2, 10, 20]
    assert sorted(table.sample(10).collect()) == sorted(table.sample(10).collect()) != sorted(table.sample(10, seed="other").collect())
    table.merge(spark.range(0, 5000, 50).selectExpr("id", "'b' AS name"))
    some = table.sample(10)
    assert some.count() == 200 and some.where("name = 'b'").count() == 4 and some.where("id >= 2000").count() == 0
    assert table.sample(0).count() == 0
