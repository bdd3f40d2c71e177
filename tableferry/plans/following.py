"""Incremental and continuous loads (I)."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import incremental, load
from ..operators.mapping import dedup_last
from ..run import History, reconcile_mapping, run_job, run_mapping, run_sync
from ..sources import scan
from ..spec import ColumnMapping, Job, Mapping, Strategy
from ..storage import SnapshotTable, new_root
from ..streaming.sync import StreamSync, follow
from .registry import query

#: A target that follows events: the last event of each user.
FIRST = dt.datetime(2024, 1, 8)
SECOND = dt.datetime(2024, 1, 18)
TO_SECOND = "ts <= TIMESTAMP '2024-01-18'"
_ROWS = "SELECT user_id, event_id, event_type, value, ts FROM events"
_LAST = "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def last_of(where: str) -> str:
    return f"{_ROWS} WHERE {where} {_LAST}"


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value", "ts")


def begun(spark, sf_dir):
    """A target as of the first instant, committed with its watermark."""
    first = dedup_last(events(spark, sf_dir).where(F.col("ts") <= F.lit(FIRST)), ["user_id"], [F.col("ts"), F.col("event_id")])
    table = incremental.start(spark, new_root(spark, "last_event"), first, ["user_id"])
    table.publish(watermark=str(FIRST), batch_id=0)
    return table


def out(df):
    return df.select("user_id", "event_id", "event_type", "value")


_OUT = "user_id, event_id, event_type, value"


def cycle(table, rows, batch_id, upper):
    """One cycle past the committed watermark, up to ``upper``."""
    state = table.manifest()
    if batch_id <= state["batch_id"]:
        return state
    last = dt.datetime.fromisoformat(state["watermark"])
    new = dedup_last(scan.after(rows, "ts", last, upper), ["user_id"], [F.col("ts"), F.col("event_id")])
    mark = incremental.advanced(last, upper, None, failed=False)
    return load.apply(table, "MERGE", new, ["user_id"], state, batch_id=batch_id, watermark=str(mark))[0]


@query(f"SELECT {_OUT} FROM ({last_of(TO_SECOND)})")
def incremental_load(spark, sf_dir):
    table = begun(spark, sf_dir)
    cycle(table, events(spark, sf_dir), 1, SECOND)
    return out(table.read())


@query(f"SELECT {_OUT} FROM ({last_of(TO_SECOND)})")
def replay_merge(spark, sf_dir):
    """The same rows merged again, after a run that stopped before its checkpoint was saved, change nothing."""
    table = begun(spark, sf_dir)
    rows = events(spark, sf_dir)
    cycle(table, rows, 1, SECOND)
    table.publish(watermark=str(FIRST))  # the checkpoint was lost
    cycle(table, rows, 2, SECOND)
    return out(table.read())


@query(f"WITH a AS ({last_of(TO_SECOND)}) SELECT count(*) AS n, 3 AS version, 1 AS batch_id, '2024-01-18 00:00:00' AS watermark FROM a")
def exactly_once(spark, sf_dir):
    """A batch that is delivered twice is committed once."""
    table = begun(spark, sf_dir)
    rows = events(spark, sf_dir)
    cycle(table, rows, 1, SECOND)
    cycle(table, rows, 1, dt.datetime(2024, 1, 30))
    state = table.manifest()
    return table.read().agg(F.count(F.lit(1)).alias("n"), F.lit(state["version"]).alias("version"), F.lit(state["batch_id"]).alias("batch_id"), F.lit(state["watermark"]).alias("watermark"))


#: Events as rows of a target of their own.
EVENT = Mapping(
    "event",
    (ColumnMapping("event_id", "event_id", "bigint", not_null=True), ColumnMapping("user_id", "user_id", "bigint"), ColumnMapping("event_type", "event_type"), ColumnMapping("value", "value", "double")),
    ("event_id",),
    table="events",
    checkpoint="event_id",
)


def event_table(spark, marked: bool = False):
    return incremental.start(spark, new_root(spark, "event"), spark.createDataFrame([], "event_id bigint, user_id bigint, event_type string, value double" + ", del_yn string" * marked), ["event_id"])


class Stopped(RuntimeError):
    pass


_TILES = "SELECT event_id, ntile(4) OVER (ORDER BY event_id) AS tile FROM events"


def stopped_after(spark, sf_dir, n: int):
    """A load in four ranges that stops after ``n`` of them."""
    scan.tables(spark, sf_dir, "events")
    table, done = event_table(spark), []

    def on_task(task, counts):
        done.append(task)
        if len(done) == n:
            raise Stopped(task)

    try:
        run_mapping(spark, EVENT, table, Strategy(workers=4), "r1", SECOND, on_task=on_task)
    except Stopped:
        pass
    return table


@query(f"WITH t AS ({_TILES}) SELECT count(*) FILTER (tile <= 2) AS base_rows, count(*) FILTER (tile > 2) AS n_read, count(*) AS n_target, CAST(max(event_id) AS VARCHAR) AS watermark, 4 AS n_tasks FROM t")
def resume_load(spark, sf_dir):
    """A load that stopped after two of four ranges goes on with the others; earlier rows count in the totals."""
    table = stopped_after(spark, sf_dir, 2)
    went_on = run_mapping(spark, EVENT, table, Strategy(workers=4), "r1", SECOND, resume=True)
    state = table.manifest()
    facts = [F.lit(went_on[c]).cast("bigint").alias(c) for c in ("base_rows", "n_read")]
    return table.read().agg(*facts, F.count(F.lit(1)).alias("n_target"), F.lit(state["watermark"]).alias("watermark"), F.lit(len(state["tasks"])).alias("n_tasks"))


@query(f"WITH t AS ({_TILES}) SELECT 'event#' || tile AS task, CASE WHEN tile <= 3 THEN CAST(max(event_id) AS VARCHAR) END AS value, CASE WHEN tile <= 3 THEN count(*) ELSE 0 END AS rows_done FROM t GROUP BY tile")
def checkpoint_tasks(spark, sf_dir):
    """The records of a run's ranges after it stopped in the fourth."""
    return incremental.checkpoints(spark, {"event": stopped_after(spark, sf_dir, 3)})


@query(f"WITH t AS ({_TILES}), h AS (SELECT o_orderpriority AS p, max(o_orderdate) AS top FROM orders GROUP BY 1), d AS (SELECT l_returnflag AS f, max(l_partkey) AS top FROM lineitem GROUP BY 1) SELECT 'event' AS mapping_id, CAST(max(event_id) AS VARCHAR) AS watermark FROM t WHERE tile = 1 UNION ALL SELECT 'orders', strftime(min(top), '%Y-%m-%d %H:%M:%S') FROM h UNION ALL SELECT 'lines', CAST(min(top) AS VARCHAR) FROM d UNION ALL SELECT 'single', CAST(max(event_id) AS VARCHAR) FROM events")
def watermark_min(spark, sf_dir):
    """Least watermark over range records, as numbers or times; a single record goes first. The records are those of
    a stopped load, and the last keys of ranges of orders and lines."""
    own = incremental.checkpoints(spark, {"event": stopped_after(spark, sf_dir, 3)}).select("task", "value")
    scan.tables(spark, sf_dir, "orders", "lineitem", "events")
    more = spark.sql("""SELECT 'orders#' || o_orderpriority AS task, date_format(max(o_orderdate), 'yyyy-MM-dd HH:mm:ss') AS value FROM orders GROUP BY o_orderpriority
        UNION ALL SELECT 'lines#' || l_returnflag, CAST(max(l_partkey) AS STRING) FROM lineitem GROUP BY l_returnflag
        UNION ALL SELECT 'single', CAST(max(event_id) AS STRING) FROM events UNION ALL SELECT 'single#1', CAST(min(event_id) AS STRING) FROM events""")
    return incremental.watermarks(own.unionByName(more))


@query("SELECT strftime(greatest(max(ts) - INTERVAL 300 SECOND, TIMESTAMP '2024-01-10'), '%Y-%m-%d %H:%M:%S') AS upper, (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2024-01-10' AND ts <= (SELECT max(ts) - INTERVAL 300 SECOND FROM events)) AS n FROM events")
def lag_window(spark, sf_dir):
    rows = events(spark, sf_dir)
    now, wm = rows.agg(F.max("ts")).first()[0], dt.datetime(2024, 1, 10)
    upper = incremental.upper_bound(now, 300, wm)
    return scan.after(rows, "ts", wm, upper).agg(F.lit(upper.strftime("%Y-%m-%d %H:%M:%S")).alias("upper"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'bounded' AS run, '2024-01-18' AS watermark UNION ALL SELECT 'by_key', (SELECT CAST(max(event_id) AS VARCHAR) FROM events) UNION ALL SELECT 'failed', '7' UNION ALL SELECT 'no_rows', '7'")
def watermark_advance(spark, sf_dir):
    last = events(spark, sf_dir).agg(F.max("event_id")).first()[0]
    cases = [("bounded", incremental.advanced("2024-01-10", "2024-01-18", None, False)), ("by_key", incremental.advanced(7, None, last, False)), ("failed", incremental.advanced(7, 9, last, True)), ("no_rows", incremental.advanced(7, None, None, False))]
    return spark.createDataFrame([(n, str(v)) for n, v in cases], "run string, watermark string")


@query(f"SELECT {_OUT} FROM ({_ROWS} {_LAST})")
def sync_cycles(spark, sf_dir):
    """Events as a stream of files, one a micro-batch, each merged with its batch id."""
    rows = events(spark, sf_dir)
    arrivals = new_root(spark, "arrivals")
    rows.repartitionByRange(3, "ts").write.parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    table = incremental.start(spark, new_root(spark, "last_event"), rows.limit(0), ["user_id"])
    checkpoint = new_root(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        follow(stream, table, ["user_id"], "ts", checkpoint).awaitTermination()
    return out(table.read())


_GONE = "user_id % 16 = 3"


@query(f"SELECT e.event_id, e.value, CASE WHEN {_GONE} THEN 'Y' END AS del_yn FROM events e WHERE ts <= TIMESTAMP '2024-01-18'")
def sync_reconcile(spark, sf_dir):
    """Sync cycles up to a lagging bound; then some rows leave the source, and the reconciliation that is due marks them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.createOrReplaceTempView("sync_events")
    columns = (*EVENT.columns, ColumnMapping("del_yn", None))
    m = dataclasses.replace(EVENT, columns=columns, table="sync_events", checkpoint="ts", delete_mode="MARK", mark_column="del_yn", delete_approved=True)
    now = [FIRST + dt.timedelta(seconds=300)]

    def wait(seconds):
        now[0] = SECOND + dt.timedelta(seconds=300)
        rows.where(f"NOT ({_GONE}) AND ts <= TIMESTAMP '2024-01-18'").createOrReplaceTempView("sync_events")
        if calls.append(seconds) or len(calls) == 1:
            rows.where("ts <= TIMESTAMP '2024-01-18'").createOrReplaceTempView("sync_events")

    calls: list[float] = []
    table = event_table(spark, marked=True)
    job = Job("events", (m,), Strategy("SYNC", lag_seconds=300, reconcile_minutes=0, max_hours=0, delete_ratio=0.2))
    run_sync(spark, job, {"event": table}, clock=lambda: now[0], wait=wait, stopped=lambda: len(calls) == 3)
    return table.read().select("event_id", "value", "del_yn")


@query(f"SELECT e.event_id, e.value, CASE WHEN {_GONE} THEN 'Y' END AS del_yn, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE ts <= TIMESTAMP '2024-01-18') AS n_read, 2 AS n_reconciled FROM events e WHERE ts <= TIMESTAMP '2024-01-18'")
def sync_stream_reconcile(spark, sf_dir):
    """Events as a stream, a file a micro-batch, up to a lagging bound; the earliest come late, in the second file. The
    stream breaks off in a cycle and is started again; rows left the source meanwhile, and the reconciliation that is due
    marks them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrivals, checkpoint = new_root(spark, "arrivals"), new_root(spark, "stream")
    for part in ("ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'", "ts <= TIMESTAMP '2024-01-10'", "ts > TIMESTAMP '2024-01-20'"):
        rows.where(part).repartition(1).write.mode("append").parquet(arrivals)  # one after the other: streams go by their times
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    rows.createOrReplaceTempView("stream_events")
    columns = (*EVENT.columns, ColumnMapping("del_yn", None))
    m = dataclasses.replace(EVENT, columns=columns, table="stream_events", checkpoint="ts", delete_mode="MARK", mark_column="del_yn", delete_approved=True)
    now = [FIRST + dt.timedelta(seconds=300)]
    table, inbox, history = event_table(spark, marked=True), SnapshotTable(spark, new_root(spark, "inbox")), History(spark, new_root(spark, "runs"))
    job = Job("stream", (m,), Strategy("SYNC", lag_seconds=300, reconcile_minutes=60, delete_ratio=0.2))
    sync = StreamSync(job, table, inbox, clock=lambda: now[0], history=history)
    forget, calls = inbox.forget, []

    def breaking(column, value, version):
        calls.append(value)
        if len(calls) == 2:
            raise Stopped("in the second cycle, after its rows were committed")
        return forget(column, value, version)

    inbox.forget = breaking
    try:
        sync.start(stream, checkpoint).awaitTermination()
    except StreamingQueryException:
        pass
    now[0] = SECOND + dt.timedelta(seconds=300)
    rows.where(f"NOT ({_GONE}) AND ts <= TIMESTAMP '2024-01-18'").createOrReplaceTempView("stream_events")
    sync.start(stream, checkpoint).awaitTermination()
    sync.cycle()  # nothing is left, and no reconciliation is due
    said = history.events()
    n_read = said.where("task = 'event' AND status = 'done'").agg(F.sum("n_read")).first()[0]
    n_reconciled = said.where("task = 'event reconciled'").count()
    return table.read().select("event_id", "value", "del_yn", F.lit(n_read).cast("bigint").alias("n_read"), F.lit(n_reconciled).alias("n_reconciled"))


#: Stretches of events that are committed one after the other.
_STEPS = [dt.datetime(2024, 1, 1) + dt.timedelta(days=5 * k) for k in range(7)]


@query("SELECT event_id, user_id, value, true AS few_files, true AS few_for_keys FROM events WHERE ts > TIMESTAMP '2024-01-25' OR event_id = (SELECT max(event_id) FROM events)")
def file_skipping(spark, sf_dir):
    """Rows after an instant, and a row by its key, from a table that was filled in time order: what files are opened is
    told by the least and greatest values that the manifest has of each."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value", "ts")
    table = SnapshotTable(spark, new_root(spark, "events"), ["event_id"], buckets=8)
    table.commit(rows.where(F.col("ts") <= F.lit(_STEPS[0])))
    for a, b in zip(_STEPS, [*_STEPS[1:], None]):
        part = rows.where(F.col("ts") > F.lit(a))
        table.insert(part.where(F.col("ts") <= F.lit(b)) if b else part)
    said, since = table.manifest(), {"ts": (dt.datetime(2024, 1, 25), None)}
    last = rows.agg(F.max("event_id").alias("event_id"))
    by_key, buckets = table.near(last)
    most = len(table.files()) // 2
    facts = (F.lit(len(table.wanted(said, where=since)) <= most).alias("few_files"), F.lit(len(by_key.inputFiles()) <= most and len(buckets) == 1).alias("few_for_keys"))
    late = table.read(where=since).where("ts > TIMESTAMP_NTZ '2024-01-25'")
    found = late.unionByName(by_key.join(last, "event_id", "left_semi"), allowMissingColumns=True).dropDuplicates(["event_id"])
    return found.select("event_id", "user_id", "value", *facts)


@query(f"WITH t AS ({_TILES}), n AS (SELECT count(*) AS n, count(*) FILTER (tile <= 2) AS half FROM t) SELECT 'r1' AS run_id, half AS n_read, half AS n_inserted, 0 AS n_updated, 0 AS n_rejected, 0 AS base_rows, n AS n_total, round(100.0 * half / n, 3) AS percent FROM n UNION ALL SELECT 'r2', n - half, n - half, 0, 0, half, n, 100.0 FROM n")
def run_totals_resumed(spark, sf_dir):
    """What the history says of a load that stopped after two of four ranges, and of the run that went on."""
    scan.tables(spark, sf_dir, "events")
    table, history, seen = event_table(spark), History(spark, new_root(spark, "runs")), []

    def stop(task, counts):
        seen.append(task)
        if len(seen) == 2:
            raise Stopped(task)

    job = Job("events", (EVENT,), Strategy(workers=4))
    run_job(spark, job, {"event": table}, "r1", SECOND, history=history, on_task=stop)
    run_job(spark, job, {"event": table}, "r2", SECOND, resume=True, history=history)
    return history.totals()


_CYCLES = [(1, "ts <= TIMESTAMP '2024-01-08'"), (2, "ts > TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-18'"), (3, "ts > TIMESTAMP '2024-01-18' AND ts <= TIMESTAMP '2024-01-25'")]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT 's-{k}' AS run_id, count(*) AS n_read, count(*) AS n_inserted, 0 AS n_updated, 0 AS n_rejected FROM events WHERE {w}" for k, w in _CYCLES) + ") SELECT *, CAST(sum(n_read) OVER (ORDER BY run_id) AS BIGINT) AS total_read, CAST(sum(n_inserted) OVER (ORDER BY run_id) AS BIGINT) AS total_inserted, 0 AS total_updated, 0 AS total_rejected FROM c")
def cycle_totals(spark, sf_dir):
    """Cycles of a sync up to three lagging bounds, with running totals, from its history."""
    scan.tables(spark, sf_dir, "events")
    table, history = event_table(spark), History(spark, new_root(spark, "runs"))
    times = [x + dt.timedelta(seconds=300) for x in (FIRST, SECOND, dt.datetime(2024, 1, 25))]
    calls: list[float] = []
    m = dataclasses.replace(EVENT, checkpoint="ts")
    job = Job("events", (m,), Strategy("SYNC", lag_seconds=300, max_hours=0))
    run_sync(spark, job, {"event": table}, "s", clock=lambda: times[min(len(calls), 2)], wait=calls.append, stopped=lambda: len(calls) == 3, history=history)
    return history.cycles("event")


@query("SELECT 'bounded' AS run, '2024-01-08 00:00:00' AS watermark, (SELECT count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-08') AS n_target UNION ALL SELECT 'failed', '2024-01-08 00:00:00', (SELECT count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-08') UNION ALL SELECT 'no_rows', '2024-01-18 00:00:00', (SELECT count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-08') UNION ALL SELECT 'by_key', (SELECT CAST(max(event_id) AS VARCHAR) FROM events), (SELECT count(*) FROM events)")
def watermark_runs(spark, sf_dir):
    """The watermark that each kind of run leaves: a bounded one its bound, a failed one the old one, one without rows its
    bound all the same, and one by a number the last key."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.createOrReplaceTempView("events")
    rows.where("ts <= TIMESTAMP '2024-01-08'").createOrReplaceTempView("few_events")
    strategy = Strategy("INCREMENTAL", lag_seconds=300)
    by_time = dataclasses.replace(EVENT, checkpoint="ts", table="few_events")
    table, keyed, out = event_table(spark), event_table(spark), []

    def ran(name, m, t, now):
        run_job(spark, Job("events", (m,), strategy), {"event": t}, name, now + dt.timedelta(seconds=300))
        out.append(t.read().agg(F.lit(name).alias("run"), F.lit(t.manifest()["watermark"]).alias("watermark"), F.count(F.lit(1)).alias("n_target")))

    ran("bounded", by_time, table, FIRST)
    ran("failed", dataclasses.replace(by_time, where="no_such_column > 1"), table, SECOND)
    ran("no_rows", by_time, table, SECOND)
    ran("by_key", EVENT, keyed, SECOND)
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


_MARKS = "SELECT count(*) FILTER (user_id % 16 = 3) AS gone, count(*) FILTER (user_id % 16 <> 3) AS kept, count(*) AS n FROM events"


@query(f"WITH e AS ({_MARKS}) SELECT 'unapproved' AS setting, gone AS n_mark, 0 AS n_marked, false AS blocked FROM e UNION ALL SELECT 'ratio', gone, 0, true FROM e UNION ALL SELECT 'limit', gone, 0, true FROM e UNION ALL SELECT 'empty source', n, 0, true FROM e UNION ALL SELECT 'approved', gone, gone, false FROM e UNION ALL SELECT 'again', 0, 0, false FROM e")
def reconcile_settings(spark, sf_dir):
    """Reconciliation of rows that left the source: without approval, over the share, over the limit, against an empty
    source, approved, and once more."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    table = event_table(spark, marked=True)
    table.insert(rows.select("event_id", "user_id", "event_type", "value", F.lit("N").alias("del_yn")))
    rows.where(f"NOT ({_GONE})").createOrReplaceTempView("kept_events")
    rows.limit(0).createOrReplaceTempView("no_events")
    m = dataclasses.replace(EVENT, table="kept_events", delete_mode="MARK", mark_column="del_yn", delete_approved=True)
    wide = Strategy(delete_ratio=0.5)
    cases = [
        ("unapproved", dataclasses.replace(m, delete_approved=False), wide), ("ratio", m, Strategy(delete_ratio=0.0001)), ("limit", m, Strategy(delete_ratio=0.5, most_marks=11)),
        ("empty source", dataclasses.replace(m, table="no_events"), wide), ("approved", m, wide), ("again", m, wide),
    ]
    found = [(name, said["n_mark"], said["n_marked"], said["blocked"] is not None) for name, x, s in cases for said in [reconcile_mapping(spark, x, table, s)]]
    return spark.createDataFrame(found, "setting string, n_mark bigint, n_marked bigint, blocked boolean")
