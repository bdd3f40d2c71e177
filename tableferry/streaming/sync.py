"""Following a source with Structured Streaming: each micro-batch is one merge cycle."""

from __future__ import annotations

import dataclasses
import datetime as dt
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.mapping import dedup_last
from ..run import Arrivals, History, reconcile_mapping, run_job, window
from ..spec import Job, Mapping
from ..storage import SnapshotTable


def follow(changes: DataFrame, table: SnapshotTable, key: list[str], order: str, checkpoint_dir: str, seconds: int | None = None) -> StreamingQuery:
    """Merge a stream of changes into the table, the last row of a key by ``order`` winning.

    The batch id is committed with the data, so a batch that is delivered again adds nothing. Rows older
    than what the table has are ignored, whichever batch they come in: a late row can't undo a newer one.
    Without ``seconds`` what is available is taken and the query ends.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        state = table.manifest()
        if batch_id <= state["batch_id"]:
            return
        rows = dedup_last(batch, key, [F.col(order)])
        if state["schema"] is None:
            table.commit(rows, batch_id=batch_id)
            return
        target, buckets = table.near(rows, state)
        old = target.select(*key, F.col(order).alias("_held"))
        newer = rows.join(old, key, "left").where(F.col("_held").isNull() | (F.col(order) >= F.col("_held"))).drop("_held")
        table.merge(newer, buckets, state, batch_id=batch_id)
        table.fold()

    writer = changes.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()


class StreamSync:
    """A sync of a job's mapping whose source comes as a stream.

    A micro-batch is added to the ``inbox``, a table of its own, with its batch id, so that one delivered again adds
    nothing. Then an incremental cycle runs on the inbox: rows past the target's watermark up to now less the lag, with all
    that jobs do (mapping, checks, rejects, history), while later ones wait for a further cycle. Files come in any order:
    rows behind the watermark that came since the last cycle are taken as well, unless the target has a newer one of their
    key. ``taken``, a table of keys next to the inbox, tells; what was in the target before the stream stays. Files of the
    inbox that lie before the watermark are dropped. When due, deletions are reconciled against ``mapping``'s own source, and the
    target says when that was, so a stream that is started again goes on where it stopped, wherever that was.
    """

    def __init__(self, job: Job, table: SnapshotTable, inbox: SnapshotTable, clock: Callable[[], dt.datetime] = dt.datetime.now, history: History | None = None):
        (self.mapping,) = job.mappings
        if self.mapping.checkpoint is None:
            raise ValueError("a stream is followed by a checkpoint")
        self.job, self.table, self.inbox, self.clock, self.history = job, table, inbox, clock, history
        self.spark, self.strategy = table.spark, dataclasses.replace(job.strategy, mode="INCREMENTAL")
        self.taken = SnapshotTable(self.spark, f"{inbox.root}/taken", self.mapping.key)

    def start(self, changes: DataFrame, checkpoint_dir: str, seconds: int | None = None) -> StreamingQuery:
        """Follow until stopped; without ``seconds`` take what is available and end."""
        writer = changes.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint_dir)
        return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()

    def take(self, batch: DataFrame, batch_id: int) -> None:
        state = self.inbox.manifest()
        if state["schema"] is None:
            self.inbox.commit(batch, batch_id=batch_id)
        elif batch_id > state["batch_id"]:
            self.inbox.insert(batch, base=state, batch_id=batch_id)
        self.cycle()

    def cycle(self) -> dict[str, Any]:
        """One cycle on what the inbox has; also for a caller that doesn't want late rows to wait for the next batch."""
        now, state, name = self.clock(), self.table.manifest(), f"inbox_{uuid.uuid4().hex}"
        at, mark, column = self.inbox.manifest()["version"], state["watermark"], self.mapping.checkpoint
        rows = self.inbox.read(at)
        upper = window(rows, self.mapping, self.strategy, state, now)[1]
        # Only files with rows past the watermark up to there are opened, and new ones with rows behind it.
        rows = self.inbox.read(at, where={column: (mark, upper)})
        if mark is not None:
            last = F.lit(mark).cast(dict(rows.dtypes)[column])
            late = self.inbox.read(at, where={column: (None, mark)}, since=state.get("inbox", {}).get(self.inbox.root, 0))
            rows = rows.where(F.col(column) > last).unionByName(late.where(F.col(column) <= last))
        rows.createOrReplaceTempView(name)
        mapping: Mapping = dataclasses.replace(self.mapping, table=name, sql=None)
        run_id = f"{self.job.name}-{now:%Y%m%d%H%M%S}-{state['version']}"
        try:
            done = run_job(self.spark, Job(self.job.name, (mapping,), self.strategy), {mapping.target: self.table}, run_id, now, history=self.history, pass_only=True, arrivals=Arrivals(self.taken, {"inbox": {self.inbox.root: at}}))[mapping.target]
        finally:
            self.spark.catalog.dropTempView(name)
        if done["status"] == "failed":
            raise done["error"]
        self.taken.vacuum(self.strategy.keep_versions, self.strategy.keep_hours)
        mark = self.table.manifest()["watermark"]
        if mark is not None:
            self.inbox.forget(column, mark, at)
        self.reconcile_if_due(now)
        return done

    def reconcile_if_due(self, now: dt.datetime) -> dict[str, Any] | None:
        last = self.table.manifest().get("reconciled")
        if last is not None and now - dt.datetime.fromisoformat(last) < dt.timedelta(minutes=self.strategy.reconcile_minutes):
            return None
        said = reconcile_mapping(self.spark, self.mapping, self.table, self.strategy)
        self.table.publish(reconciled=str(now))
        if self.history:
            self.history.put(f"{self.job.name}-{now:%Y%m%d%H%M%S}", f"{self.mapping.target} reconciled", "done", "SYNC", None, said["blocked"])
        return said
