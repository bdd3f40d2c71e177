"""Versioned tables: commits of several writers, deltas, buckets that grow, files that aren't read."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tableferry.operators import load
from tableferry.storage import Conflict, SnapshotTable, Versions, ancestor, meet, new_root

NAMES = "id long, name string"


def table_of(spark, n=1000, buckets=16, **more):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=buckets, **more)
    table.commit(spark.range(n).selectExpr("id", "concat('n', id) AS name", "CAST(NULL AS STRING) AS note"))
    return table


def held(table, version=None):
    return {r["id"]: (r["name"], r["note"]) for r in table.read(version).collect()}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), NAMES)


def deltas(table):
    return [f for f in table.files() if f["columns"] is not None]


def base_files(table):
    return {f["path"] for f in table.files() if f["columns"] is None}


# -- commits ----------------------------------------------------------------------------------
def test_a_version_is_there_whole_or_not_at_all(spark):
    versions = Versions(spark, new_root(spark, "v"))
    versions.put(1, {"a": 1})
    with pytest.raises(Conflict):
        versions.put(1, {"a": 2})
    versions.write("private-left-by-a-dead-writer", '{"a"')
    assert versions.latest() == (1, {"a": 1}) and versions.names() == ["0000000001", "private-left-by-a-dead-writer"]


def test_only_one_of_many_threads_has_a_number(spark):
    versions, won = Versions(spark, new_root(spark, "v")), []

    def write(k):
        for number in range(1, 6):
            try:
                versions.put(number, {"by": k})
                won.append((number, k))
            except Conflict:
                pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in won) == [1, 2, 3, 4, 5] and all(versions.get(n)["by"] == k for n, k in won)


def test_a_writer_that_is_paused_before_its_commit_loses_no_rows(spark, monkeypatch):
    """A has written its manifest aside, and B commits; then A goes on: B's rows and A's are there."""
    table, other = table_of(spark, 10, buckets=4), None
    other = SnapshotTable(spark, table.root)
    paused, go_on, errors = threading.Event(), threading.Event(), []
    link = os.link

    def slow(source, target):
        if threading.current_thread().name == "A" and not paused.is_set():
            paused.set()
            go_on.wait(60)
        link(source, target)

    monkeypatch.setattr(os, "link", slow)

    def insert(t, low):
        try:
            t.insert(spark.range(low, low + 5).selectExpr("id", "'new' AS name", "CAST(NULL AS STRING) AS note"))
        except Exception as e:
            errors.append(e)

    a = threading.Thread(target=insert, args=(table, 100), name="A")
    a.start()
    assert paused.wait(60)
    insert(other, 200)
    assert table.read().count() == 15  # A shows nothing yet
    go_on.set()
    a.join()
    assert errors == [] and table.versions() == [1, 2, 3]
    assert sorted(held(table)) == [*range(10), *range(100, 105), *range(200, 205)]


def test_who_relied_on_what_others_changed_fails(spark):
    table = table_of(spark, 10)
    base = table.manifest()
    _, buckets = table.near(rows(spark, (50, "a")))
    table.merge(rows(spark, (50, "other")))
    new = spark.createDataFrame([(50, "a", None)], NAMES + ", note string")
    with pytest.raises(Conflict, match="same buckets"):
        table.insert(new, buckets, base)
    free = [b for b in range(16) if b not in buckets]
    assert table.insert(new.where("id < 0"), free, base)["version"] == 3  # other buckets: it goes after the other commit
    table.publish(watermark="5", batch_id=3)
    with pytest.raises(Conflict, match="watermark"):
        table.merge(rows(spark, (1, "late")), base=base, watermark="4")
    with pytest.raises(Conflict):
        table.commit(new, base)
    assert table.merge(rows(spark, (1, "blind")), base=base)["watermark"] == "5" and held(table)[1][0] == "blind"


def test_an_insert_is_made_anew_where_others_were_first(spark, monkeypatch):
    table = table_of(spark, 3)
    insert, calls = SnapshotTable.insert, []

    def late(self, *a, **b):
        calls.append(1)
        if len(calls) == 1:
            insert(SnapshotTable(spark, table.root), spark.createDataFrame([(7, "first", None)], NAMES + ", note string"))
        return insert(self, *a, **b)

    monkeypatch.setattr(SnapshotTable, "insert", late)
    _, known = load.apply(table, "INSERT_ONLY", rows(spark, (7, "second"), (8, "new")), ["id"])
    assert len(calls) == 2 and held(table) == {**{k: (f"n{k}", None) for k in range(3)}, 7: ("first", None), 8: ("new", None)}
    assert [r["id"] for r in known.collect()] == [7]


# -- deltas -----------------------------------------------------------------------------------
def test_scattered_keys_write_no_base_file(spark):
    table = table_of(spark, 100_000)
    before = base_files(table)
    load.apply(table, "MERGE", spark.range(0, 100_000, 1000).selectExpr("CAST(id AS INT) AS id", "'m' AS name"), ["id"])
    load.apply(table, "MERGE", rows(spark, (7, "seven"), (200_000, "more")), ["id"])
    load.apply(table, "INSERT_ONLY", rows(spark, (1, "x"), (200_000, "x"), (500_000, "new")), ["id"])
    assert before < base_files(table) and sum(f["rows"] for f in deltas(table)) == 102
    now = held(table)
    assert (now[7][0], now[1000][0], now[200_000][0], now[500_000][0], now[1][0], len(now)) == ("seven", "m", "more", "new", "n1", 100_002)
    assert table.read(1).count() == 100_000


@pytest.mark.parametrize("limit", ["10485760", "-1"])
def test_the_last_written_value_of_each_column_counts(spark, limit):
    table, want = table_of(spark, 40, buckets=4), {k: (f"n{k}", None) for k in range(40)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for step in range(12):
            keys = range(step, 60, 7)
            if step % 3 == 2:
                table.merge(spark.createDataFrame([(k, f"note{step}") for k in keys], "id long, note string"))
                want |= {k: (want.get(k, (None,))[0], f"note{step}") for k in keys}
            else:
                value = None if step == 6 else f"name{step}"
                table.merge(rows(spark, *((k, value) for k in keys)))
                want |= {k: (value, want.get(k, (None, None))[1]) for k in keys}
            if step in (4, 9):  # deltas that wrote the same columns in a row are joined; too many runs are folded
                table.fold(most=3, share=9)
                assert len({f["seq"] for f in deltas(table)}) == (3 if step == 4 else 0)
            assert held(table) == want
        assert held(table, 1) == {k: (f"n{k}", None) for k in range(40)}
        table.fold(share=0.0)
        assert deltas(table) == [] and held(table) == want
        buckets = table.touched(rows(spark, (3, "")))
        some = {r["id"] for r in table.read(buckets=buckets).collect()}
        assert 3 in some and some == {k for k in want if table.touched(rows(spark, (k, ""))) == buckets}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_a_whole_key_are_kept_as_they_are(spark):
    table = table_of(spark, 2, buckets=4)
    for _ in range(2):
        table.merge(rows(spark, (None, "loose"), (1, "one")))
    count = lambda: sorted((str(r["id"]), r["name"]) for r in table.read().collect())
    want = [("0", "n0"), ("1", "one"), ("None", "loose"), ("None", "loose")]
    assert count() == want
    table.fold(most=1, share=9)
    assert len({f["seq"] for f in deltas(table)}) == 1 and count() == want
    table.fold(share=0.0)
    assert deltas(table) == [] and count() == want


def test_folding_does_not_undo_what_is_committed_meanwhile(spark, monkeypatch):
    table = table_of(spark, 20, buckets=4)
    table.merge(rows(spark, (1, "a"), (30, "b")))
    write = SnapshotTable._write

    def slow(self, *a, **b):
        out = write(self, *a, **b)
        monkeypatch.setattr(SnapshotTable, "_write", write)
        SnapshotTable(spark, table.root).merge(rows(spark, (1, "later")))
        return out

    monkeypatch.setattr(SnapshotTable, "_write", slow)
    table.fold(share=0.0)
    assert held(table)[1][0] == "later" and held(table)[30][0] == "b" and len(held(table)) == 21
    gone = [f["path"] for f in table.files()]
    base = table.manifest()
    table.fold(share=0.0)
    with pytest.raises(Conflict, match="replaced"):
        table._commit(base, [], table.read().schema, {}, gone, same=True)


def test_marks_and_deletes(spark):
    table = table_of(spark, 5)
    table.merge(spark.createDataFrame([(2, "note")], "id long, note string"))
    load.apply(table, "DELETE_INSERT", rows(spark, (2, "two"), (9, "nine")), ["id"])
    assert (held(table)[2], held(table)[9], len(held(table))) == (("two", None), ("nine", None), 6)
    load.apply(table, "TRUNCATE_INSERT", rows(spark, (3, "only")), ["id"])
    assert held(table) == {3: ("only", None)} and len(table.files()) == 1


def test_keys_of_other_types_and_clashing_names(spark):
    table = SnapshotTable(spark, new_root(spark, "t"), ["_k0", "bucket"], buckets=8)
    table.commit(spark.createDataFrame([(0.0, "a", 1), (1.5, "b", 2), (float("nan"), "c", 3)], "_k0 double, bucket string, _seq long"))
    found, _ = table.near(spark.createDataFrame([(-0.0, "a")], "_k0 double, bucket string"))
    assert [r["_seq"] for r in found.collect() if r["_k0"] == 0.0] == [1]
    assert SnapshotTable(spark, new_root(spark, "t"), ["id"]).versions() == []
    with pytest.raises(ValueError, match="nothing has been committed"):
        SnapshotTable(spark, new_root(spark, "t"), ["id"]).read()


# -- buckets and files ------------------------------------------------------------------------
def test_buckets_grow_and_files_keep_their_size(spark):
    """A load of a thousand times as many rows: files stay near the target size, and old files are found."""
    target = 16 << 10
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=2, bucket_bytes=target)
        make = lambda a, b: spark.range(a, b, 1, 150).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS name", "CAST(NULL AS STRING) AS note")
        table.commit(make(0, 60))
        table.insert(make(60, 60_000))
        grown = table.manifest()["buckets"]
        sizes = [f["bytes"] for f in table.files()]
        assert grown > 100 and len(sizes) > 50 and max(sizes) < 4 * target
        table.insert(make(60_000, 90_000))
        assert table.manifest()["buckets"] > grown and table.read().count() == 90_000
        find = lambda k: (lambda part, buckets: ([r["id"] for r in part.where(F.col("id") == k).collect()], len(table.wanted(table.manifest(), buckets))))(*table.near(rows(spark, (k, ""))))
        before = [find(k) for k in (5, 59_999, 89_999)]
        table.fold()  # what was written for few buckets is written for many
        after = [find(k) for k in (5, 59_999, 89_999)]
        assert [x for x, _ in before] == [x for x, _ in after] == [[5], [59_999], [89_999]]
        assert min(n for _, n in before) > 100 and max(n for _, n in after) < 20
        assert table.read().count() == 90_000 and all(f["n"] * 4 > table.manifest()["buckets"] for f in table.files())
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")


def test_a_bucket_comes_from_the_one_it_was_split_from():
    for n in range(1, 40):
        for m in range(1, n + 1):
            for h in range(300):
                address = lambda k: (lambda half: h % (2 * half) if h % (2 * half) < k else h % half)(1 << (k.bit_length() - 1))  # noqa: E731, B023
                assert ancestor(address(n), m) == address(m)
    assert meet([5], 8, [1], 4) and not meet([5], 8, [2], 4)


def test_late_rows_and_keys_open_few_files(spark):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=1)
    day = lambda d: spark.range(d * 100, d * 100 + 100, 1, 1).selectExpr("id", f"TIMESTAMP_NTZ '2024-01-{d + 1:02d} 12:00:00' + make_dt_interval(0, 0, 0, id % 100) AS ts", "CAST(id AS STRING) AS name")
    table.commit(day(0))
    for d in range(1, 10):
        table.insert(day(d))
    late = {"ts": ("2024-01-09 12:00:50", None)}
    opened = table.wanted(table.manifest(), where=late)
    assert len(table.files()) == 10 and len(opened) == 2
    assert table.read(where=late).where("ts > TIMESTAMP_NTZ '2024-01-09 12:00:50'").count() == 149
    part, _ = table.near(spark.createDataFrame([(512,), (530,)], "id int"))
    assert len(part.inputFiles()) == 1 and part.where("id IN (512, 530)").count() == 2
    table.merge(spark.createDataFrame([(5, "2024-01-10 13:00:00")], "id long, ts string"))  # an early row is late now
    assert table.read(where=late).where("ts > TIMESTAMP_NTZ '2024-01-09 12:00:50'").count() == 150


def test_keys_are_looked_for_in_small_files_that_may_have_them(spark):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id", "x"], buckets=1)
    make = lambda k: spark.range(k, 20_000, 20, 1).selectExpr("id", "concat('x', id % 3) AS x", "1 AS n")
    for k in range(20):
        (table.insert if k else table.commit)(make(k))
    assert all(f["filter"] for f in table.files())
    hits = [len(table.near(spark.createDataFrame([(k, f"x{k % 3}")], "id int, x string"))[0].inputFiles()) for k in (7, 1003, 19_999)]
    assert all(1 <= n <= 4 for n in hits)
    part, _ = table.near(spark.createDataFrame([(7, "x1"), (None, "x1"), (12_345, "x0"), (99_999, "x0")], "id long, x string"))
    assert sorted(r["id"] for r in part.where("id IN (7, 12345)").collect()) == [7, 12_345] and len(part.inputFiles()) < 10
    large = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=1)
    large.commit(spark.range(0, 9000, 1, 1))
    assert large.files()[0]["filter"] is None and large.near(spark.range(5, 6))[0].count() == 9000


def test_many_commits_stay_cheap_to_read(spark, monkeypatch):
    monkeypatch.setattr("tableferry.storage.MOST_LISTS", 4)
    table = table_of(spark, 10, buckets=2)
    for k in range(10, 18):
        table.insert(spark.createDataFrame([(k, "x", None)], NAMES + ", note string"))
        assert len(table.manifest()["lists"]) <= 5
    assert table.read().count() == 18 and len(table.files()) >= 9
    table.fold(most=3)
    assert len(table.files()) <= 2 and table.read().count() == 18


def test_vacuum_leaves_what_a_writer_has_not_committed_yet(spark):
    table = table_of(spark, 10, buckets=2)
    for k in range(10, 13):
        table.insert(spark.createDataFrame([(k, "x", None)], NAMES + ", note string"))
    pending = table._write(spark.createDataFrame([(99, "pending", None)], NAMES + ", note string"), table.manifest())
    table.fold(most=1)
    assert table.vacuum(keep=1) == 0  # all is young
    base = table.manifest()
    table._commit(base, pending, table.read().schema, {})
    assert table.vacuum(keep=1, hours=0) > 0 and len(table.versions()) == 1 and table.read().count() == 14
    assert table.vacuum(keep=1, hours=0) == 0
