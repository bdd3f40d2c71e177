import dataclasses
import datetime as dt

import pytest

from tableferry.operators import incremental, load, reconcile
from tableferry.run import History, in_order, reconcile_mapping, run_job, run_mapping, run_sync
from tableferry.spec import ColumnMapping, Job, Mapping, Strategy
from tableferry.storage import SnapshotTable, new_root

COLUMNS = (ColumnMapping("id", "id", "bigint", not_null=True), ColumnMapping("name", "name", "string", not_null=True, max_len=5))


def target(spark, rows=()):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=4)
    table.commit(spark.createDataFrame(list(rows), "id long, name string, note string"))
    return table


def view(spark, rows):
    spark.createDataFrame(rows, "id long, name string, ts timestamp_ntz").createOrReplaceTempView("run_source")


def at(minute):
    return dt.datetime(2024, 1, 1, 12, minute)


def base_files(table):
    return {f["path"] for f in table.files() if f["columns"] is None}


def held(table):
    return {r["id"]: r["name"] for r in table.read().collect()}


ROWS = [(1, "a", at(1)), (1, "b", at(2)), (2, "toolong", at(1)), (3, None, at(1)), (4, "d", at(3))]


@pytest.mark.parametrize(
    "mode, want, counts",
    [
        ("MERGE", {1: "b", 4: "d", 9: "z"}, (1, 1, 2)),
        ("INSERT_ONLY", {1: "x", 4: "d", 9: "z"}, (1, 0, 4)),
        ("TRUNCATE_INSERT", {1: "b", 4: "d"}, (2, 0, 2)),
        ("DELETE_INSERT", {1: "b", 4: "d", 9: "z"}, (2, 0, 2)),
    ],
)
def test_write_modes(spark, mode, want, counts):
    view(spark, ROWS)
    table = target(spark, [(1, "x", "kept"), (9, "z", None)])
    m = Mapping("t", COLUMNS, ("id",), table="run_source", mode=mode, checkpoint="ts")
    dry = run_mapping(spark, m, table, dry=True)
    assert held(table) == {1: "x", 9: "z"}
    done = run_mapping(spark, m, table, run_id="r1")
    assert held(table) == want
    for got in (dry, done):
        assert (got["n_inserted"], got["n_updated"], got["n_rejected"]) == counts
    assert spark.read.parquet(f"{table.root}/rejects/run_id=r1").count() == counts[2]


def test_incremental_runs_take_late_rows_within_the_lag(spark):
    table = target(spark)
    m = Mapping("t", COLUMNS, ("id",), table="run_source", checkpoint="ts")
    job, strategy = "j", Strategy(mode="INCREMENTAL", lag_seconds=300)
    view(spark, [(1, "a", at(1)), (2, "b", at(8))])
    run_job(spark, Job(job, (m,), strategy), {"t": table}, now=at(10))
    assert held(table) == {1: "a"} and table.manifest()["watermark"] == str(at(5))
    view(spark, [(1, "a", at(1)), (2, "b", at(8)), (3, "late", at(6)), (4, "c", at(14))])
    run_job(spark, Job(job, (m,), strategy), {"t": table}, now=at(20))
    assert held(table) == {1: "a", 2: "b", 3: "late", 4: "c"}
    before = held(table)
    run_job(spark, Job(job, (m,), strategy), {"t": table}, now=at(16))  # the clock went back
    assert held(table) == before and table.manifest()["watermark"] == str(at(15))


def test_truncate_insert_stops_before_it_touches_anything(spark):
    view(spark, ROWS)
    table = target(spark, [(9, "z", None)])
    m = Mapping("t", COLUMNS, ("id",), table="run_source", mode="TRUNCATE_INSERT", checkpoint="ts")
    run_mapping(spark, m, table, Strategy(mode="INCREMENTAL"), now=at(30))
    with pytest.raises(ValueError):
        run_mapping(spark, m, table, Strategy(mode="INCREMENTAL"), now=at(40))
    assert held(table) == {1: "b", 4: "d"}


def test_number_checkpoints_resume_after_the_last_key(spark):
    table = target(spark)
    m = Mapping("t", COLUMNS, ("id",), table="run_source", checkpoint="id")
    view(spark, [(1, "a", None), (2, "b", None)])
    run_mapping(spark, m, table, Strategy(mode="INCREMENTAL"))
    assert table.manifest()["watermark"] == "2"
    view(spark, [(1, "x", None), (3, "c", None)])
    run_mapping(spark, m, table, Strategy(mode="INCREMENTAL"))
    assert held(table) == {1: "a", 2: "b", 3: "c"}


def test_rows_without_a_whole_key_are_neither_lost_nor_matched(spark):
    view(spark, [(None, "a", at(1)), (None, "b", at(2)), (1, "c", at(1)), (1, "d", at(2))])
    columns = (ColumnMapping("id", "id", "bigint"), COLUMNS[1])
    for mode in ("MERGE", "INSERT_ONLY"):
        table = target(spark, [(1, "x", None), (None, "z", None)])
        done = run_mapping(spark, Mapping("t", columns, ("id",), table="run_source", mode=mode, checkpoint="ts"), table)
        names = sorted(r["name"] for r in table.read().collect())
        assert names == (["a", "b", "d", "z"] if mode == "MERGE" else ["a", "b", "x", "z"])
        assert done["n_read"] == 4 if mode == "INSERT_ONLY" else done["n_inserted"] == 2


# -- jobs -------------------------------------------------------------------------------------
def numbered(spark, n, name="run_numbers"):
    spark.range(n).selectExpr("id", "concat('n', id) AS name", "TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(0, 0, 0, id) AS ts").createOrReplaceTempView(name)


def test_a_stopped_load_resumes_with_the_ranges_that_are_left(spark):
    numbered(spark, 100)
    table, seen = target(spark), []
    m = Mapping("t", COLUMNS, ("id",), table="run_numbers", checkpoint="id")

    def stop_at_two(task, counts):
        seen.append(task)
        if len(seen) == 2:
            raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        run_mapping(spark, m, table, Strategy(workers=4), on_task=stop_at_two)
    assert table.read().count() == 50 and table.manifest()["watermark"] is None
    assert [t["done"] for t in table.manifest()["tasks"]] == [True, True, False, False]
    marks = incremental.watermarks(incremental.checkpoints(spark, {"t": table})).collect()
    assert [tuple(r) for r in marks] == [("t", "24")]  # the range that lags
    went_on = run_mapping(spark, m, table, Strategy(workers=4), resume=True, on_task=lambda t, c: seen.append(t))
    assert seen == ["t#1", "t#2", "t#3", "t#4"] and (went_on["base_rows"], went_on["n_inserted"]) == (50, 50)
    assert table.read().count() == 100 and table.manifest()["watermark"] == "99"
    again = run_mapping(spark, m, table, Strategy(workers=4), resume=True)  # nothing is left: a run of its own
    assert (again["base_rows"], again["n_updated"], table.read().count()) == (0, 100, 100)


@pytest.mark.parametrize("policy, second", [("STOP", "skipped"), ("CONTINUE", "done")])
def test_error_policies_and_history(spark, policy, second):
    numbered(spark, 5)
    bad = Mapping("bad", COLUMNS, ("id",), table="no_such_table")
    good = Mapping("good", COLUMNS, ("id",), table="run_numbers")
    history = History(spark, new_root(spark, "runs"))
    tables = {"bad": target(spark), "good": target(spark)}
    out = run_job(spark, Job("j", (bad, good), Strategy(error_policy=policy)), tables, "r7", history=history)
    assert (out["bad"]["status"], out["good"]["status"]) == ("failed", second)
    said = {r["task"]: r for r in history.latest().collect()}
    assert {t: r["status"] for t, r in said.items()} == {"j": "failed", "bad": "failed", "good": second}
    assert said["good"]["n_inserted"] == (5 if second == "done" else 0) and "no_such_table" in said["bad"]["message"]


def test_a_mapping_is_tried_again_from_its_checkpoint(spark):
    numbered(spark, 100)
    table, seen, waits = target(spark), [], []

    def on_task(task, counts):
        seen.append(task)
        if len(seen) == 2:
            raise ConnectionError("connection lost")

    m = Mapping("t", COLUMNS, ("id",), table="run_numbers", checkpoint="id")
    history = History(spark, new_root(spark, "runs"))
    job = Job("j", (m,), Strategy(workers=4, error_policy="RETRY"))
    out = run_job(spark, job, {"t": table}, "r8", on_task=on_task, history=history, wait=waits.append)["t"]
    assert out["status"] == "done" and seen == ["t#1", "t#2", "t#3", "t#4"] and (out["base_rows"], out["n_inserted"]) == (50, 50)
    assert waits == [1.0] and table.read().count() == 100
    assert [r["status"] for r in history.events().where("task = 't'").orderBy("seq").collect()] == ["running", "retrying", "done"]
    waits.clear()
    lost = Mapping("t", COLUMNS, ("id",), table="no_such_table")
    assert run_job(spark, Job("j", (lost,), job.strategy), {"t": table}, wait=waits.append)["t"]["status"] == "failed" and waits == []


def test_parents_are_loaded_before_children():
    m = lambda name, *parents: Mapping(name, COLUMNS, ("id",), table="x", parents=parents)
    given = [m("line", "order", "part"), m("order", "customer"), m("customer", "customer"), m("part"), m("a", "b"), m("b", "a")]
    assert [x.target for x in in_order(given)] == ["customer", "order", "part", "line", "a", "b"]
    job = Job("j", (m("child", "parent"), m("parent")))
    assert Job.from_json(job.to_json()) == job


def test_many_events_are_joined(spark, monkeypatch):
    monkeypatch.setattr(History, "MOST", 5)
    history = History(spark, new_root(spark, "runs"))
    for k in range(8):
        history.put("r", f"t{k % 3}", "running" if k < 6 else "done", "FULL", {"n_read": k})
    history.join()
    assert len(history.files.names()) == 1
    assert {r["task"]: (r["status"], r["n_read"]) for r in history.latest().collect()} == {"t0": ("done", 6), "t1": ("done", 7), "t2": ("running", 5)}


MARKED = dataclasses.replace(
    Mapping("t", (*COLUMNS, ColumnMapping("del_yn", None)), ("id",), table="run_numbers", checkpoint="ts"), delete_mode="MARK", mark_column="del_yn", delete_approved=True
)


def marks(table):
    return sorted(r["id"] for r in table.read().where("del_yn = 'Y'").collect())


def filled(spark, n, gone=()):
    table = SnapshotTable(spark, new_root(spark, "t"), ["id"], buckets=8)
    table.commit(spark.range(n).selectExpr("id", "concat('n', id) AS name", f"IF(id IN ({','.join(map(str, gone)) or 'NULL'}), 'Y', 'N') AS del_yn"))
    return table


def test_reconciling_marks_what_is_gone_and_unmarks_what_came_back(spark):
    spark.range(20).where("id NOT IN (3, 4)").selectExpr("id", "'n' AS name", "TIMESTAMP_NTZ '2024-01-01 12:00:00' AS ts").createOrReplaceTempView("run_numbers")
    table = filled(spark, 23, gone=(5, 22))
    waits = run_waiting(spark, dataclasses.replace(MARKED, delete_approved=False), table)
    assert waits["n_marked"] == 0 and waits["samples"] == ["20", "21", "3", "4"] and marks(table) == [5, 22]
    before = base_files(table)
    done = run_waiting(spark, MARKED, table)
    assert (done["n_marked"], done["n_unmarked"], done["blocked"]) == (4, 1, None)
    assert marks(table) == [3, 4, 20, 21, 22] and base_files(table) == before
    assert run_waiting(spark, MARKED, table)["n_marked"] == 0


def run_waiting(spark, m, table, **strategy):
    return reconcile_mapping(spark, m, table, Strategy(**strategy))


def test_marks_are_blocked_where_they_look_wrong(spark, monkeypatch):
    numbered(spark, 100)
    table = filled(spark, 130)
    assert "over the cap of 13" in run_waiting(spark, MARKED, table)["blocked"]
    assert run_waiting(spark, MARKED, table, delete_ratio=0.5)["n_marked"] == 30
    numbered(spark, 0)
    assert run_waiting(spark, MARKED, filled(spark, 3))["blocked"] == "the source has no keys"
    numbered(spark, 100)
    monkeypatch.setattr(reconcile, "MOST", 5)
    assert "at once" in run_waiting(spark, MARKED, filled(spark, 108))["blocked"]
    spark.sql("SELECT * FROM run_numbers").limit(90).createOrReplaceTempView("run_fewer")
    counted = run_waiting(spark, dataclasses.replace(MARKED, table="run_fewer", delete_mode="NONE"), filled(spark, 108))
    assert (counted["n_source"], counted["n_target"], counted["surplus"]) == (90, 108, 18)


def test_any_number_of_rows_is_marked_unless_a_limit_is_set(spark):
    numbered(spark, 50)
    table, n = filled(spark, 200_100), 200_050
    held_back = run_waiting(spark, MARKED, table, delete_ratio=1.0, most_marks=200_000)
    assert "at once" in held_back["blocked"] and held_back["n_marked"] == 0 and marks(table) == []
    done = run_waiting(spark, MARKED, table, delete_ratio=1.0)
    assert (done["n_mark"], done["n_marked"], done["blocked"]) == (n, n, None)
    assert table.read().where("del_yn = 'Y' AND id >= 50").count() == table.read().where("del_yn = 'Y'").count() == n
    again = run_waiting(spark, MARKED, table, delete_ratio=1.0)
    assert (again["n_mark"], again["n_marked"], again["blocked"]) == (0, 0, None)
    numbered(spark, 200_100)  # all come back
    assert run_waiting(spark, MARKED, table)["n_unmarked"] == n and table.read().where("del_yn = 'Y'").isEmpty()


class Clock:
    """Time that passes only by waiting."""

    def __init__(self, now):
        self.now, self.waits = now, []

    def __call__(self):
        return self.now

    def wait(self, seconds):
        self.waits.append(seconds)
        self.now += dt.timedelta(seconds=seconds)


def test_a_sync_follows_changes_and_reconciles_when_due(spark):
    def rows(n, but):
        ts = "TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(0, 0, 10 * CAST(id AS INT)) AS ts"
        spark.range(n).where(f"id <> {but}").selectExpr("id", "concat('n', id) AS name", ts).createOrReplaceTempView("run_numbers")

    rows(30, -1)
    table, clock = filled(spark, 0), Clock(dt.datetime(2024, 1, 1, 16, 50))
    strategy = Strategy("SYNC", poll_seconds=600, lag_seconds=0, reconcile_minutes=15, max_hours=1, delete_ratio=1.0)

    def wait(seconds):
        clock.wait(seconds)
        rows(30 + len(clock.waits), len(clock.waits))

    said = run_sync(spark, Job("j", (MARKED,), strategy), {"t": table}, clock=clock, wait=wait)
    assert said["state"] == "done" and said["cycles"] == 7 and clock.waits == [600.0] * 6
    assert len(said["reconciled"]) == 4 and [r["t"]["n_marked"] for r in said["reconciled"]] == [0, 1, 1, 1]
    assert said["n_inserted"] == table.read().count() == 36 and marks(table) == [6]


def test_a_sync_marks_any_number_of_rows_that_left(spark):
    def rows(n):
        spark.range(n).selectExpr("id", "'n' AS name", "TIMESTAMP_NTZ '2024-01-01 12:00:00' AS ts").createOrReplaceTempView("run_numbers")

    rows(200_100)
    table, clock = filled(spark, 0), Clock(dt.datetime(2024, 2, 1))
    strategy = Strategy("SYNC", lag_seconds=300, reconcile_minutes=0, max_hours=0, delete_ratio=1.0)

    def wait(seconds):
        clock.wait(seconds)
        rows(50)

    said = run_sync(spark, Job("j", (MARKED,), strategy), {"t": table}, clock=clock, wait=wait, stopped=lambda: len(clock.waits) == 2)
    assert [(r["t"]["n_marked"], r["t"]["blocked"]) for r in said["reconciled"]] == [(0, None), (200_050, None)]
    found = table.read()
    assert found.where("del_yn = 'Y' AND id >= 50").count() == 200_050 and found.where("del_yn IS NULL AND id < 50").count() == 50 and found.count() == 200_100


def test_a_sync_waits_longer_after_transient_errors_and_gives_up(spark):
    table, clock = filled(spark, 0), Clock(at(1))
    spark.sql("DROP VIEW IF EXISTS run_gone")
    m = dataclasses.replace(MARKED, table="run_gone")
    strategy = Strategy("SYNC", poll_seconds=60, max_hours=1)
    said = run_sync(spark, Job("j", (m,), strategy), {"t": table}, clock=clock, wait=clock.wait)
    assert said["state"] == "failed" and said["cycles"] == 1 and clock.waits == []  # no error that goes away
    sql = "SELECT id, name, ts, raise_error('connection reset') AS x FROM run_numbers"
    numbered(spark, 3)
    broken = dataclasses.replace(MARKED, table=None, sql=sql, where="x IS NULL")
    said = run_sync(spark, Job("j", (broken,), strategy), {"t": table}, clock=clock, wait=clock.wait)
    assert said["state"] == "failed" and clock.waits == [60.0, 120.0, 240.0, 480.0, 960.0]
    calls = []
    said = run_sync(spark, Job("j", (MARKED,), strategy), {"t": table}, clock=clock, wait=calls.append, stopped=lambda: len(calls) == 2)
    assert (said["state"], said["cycles"], table.manifest()["watermark"]) == ("stopped", 2, str(clock.now - dt.timedelta(seconds=300)))
