"""What a job is: mappings from sources to targets, and how to run them. Plain JSON on disk."""

from __future__ import annotations

import dataclasses
import json
from typing import Any

WRITE_MODES = ("INSERT_ONLY", "MERGE", "TRUNCATE_INSERT", "DELETE_INSERT")
NULL_RULES = ("ALLOW", "REJECT", "DEFAULT", "SYSDATE", "EMPTY", "CUSTOM")
DELETE_MODES = ("NONE", "MARK")
RUN_MODES = ("FULL", "INCREMENTAL", "SYNC")
ERROR_POLICIES = ("CONTINUE", "STOP", "RETRY")


@dataclasses.dataclass(frozen=True)
class ColumnMapping:
    """One target column. ``expr`` is SQL over the source row; None leaves the column unwritten unless
    the null rule fills it. ``type`` is a Spark SQL type; lengths and digits are limits of the target."""

    target: str
    expr: str | None
    type: str = "string"
    null_rule: str = "ALLOW"
    fill: str | None = None
    not_null: bool = False
    max_len: int | None = None
    max_digits: int | None = None

    def __post_init__(self) -> None:
        if self.null_rule not in NULL_RULES:
            raise ValueError(f"unknown null rule {self.null_rule}")


@dataclasses.dataclass(frozen=True)
class Mapping:
    """One source, a table or a SELECT, to one target. With ``delete_mode`` MARK, target rows whose key the source
    has no more are marked in ``mark_column``, once somebody has approved that. ``parents``: targets that its foreign
    keys refer to; a job loads them before."""

    target: str
    columns: tuple[ColumnMapping, ...]
    key: tuple[str, ...]
    table: str | None = None
    sql: str | None = None
    mode: str = "MERGE"
    checkpoint: str | None = None
    where: str | None = None
    delete_mode: str = "NONE"
    mark_column: str | None = None
    delete_approved: bool = False
    parents: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if (self.table is None) == (self.sql is None):
            raise ValueError("a mapping has a table or a SELECT")
        if self.mode not in WRITE_MODES or self.delete_mode not in DELETE_MODES:
            raise ValueError("unknown mode")
        if self.delete_mode == "MARK" and not self.mark_column:
            raise ValueError("marking deletions needs a column for the mark")

    @property
    def written(self) -> list[str]:
        return [c.target for c in self.columns if c.expr is not None or c.null_rule in ("DEFAULT", "SYSDATE", "CUSTOM")]


@dataclasses.dataclass(frozen=True)
class Strategy:
    """How a job runs. After a mapping's error CONTINUE goes on with the others, STOP skips them, and RETRY first tries
    again, from the last checkpoint, if the error may be gone by then. SYNC repeats incremental cycles every
    ``poll_seconds`` for ``max_hours`` (0: until it is stopped). A reconciliation that would mark more than ``delete_ratio``
    of the live rows, or change more than ``most_marks`` rows (None: any number), changes none. After each run a target is
    folded, and what only versions before the last ``keep_versions`` need is deleted once it is ``keep_hours`` old."""

    mode: str = "FULL"
    workers: int = 4
    poll_seconds: int = 60
    max_hours: int = 24
    lag_seconds: int = 300
    reconcile_minutes: int = 60
    delete_ratio: float = 0.1
    most_marks: int | None = None
    error_policy: str = "CONTINUE"
    keep_versions: int = 20
    keep_hours: float = 24.0

    def __post_init__(self) -> None:
        if self.mode not in RUN_MODES or self.error_policy not in ERROR_POLICIES:
            raise ValueError("unknown run mode or error policy")


@dataclasses.dataclass(frozen=True)
class Job:
    name: str
    mappings: tuple[Mapping, ...]
    strategy: Strategy = Strategy()

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Job:
        d: dict[str, Any] = json.loads(text)
        mappings = tuple(
            Mapping(**m | {"columns": tuple(ColumnMapping(**c) for c in m["columns"]), "key": tuple(m["key"]), "parents": tuple(m.get("parents", ()))}) for m in d["mappings"]
        )
        return Job(d["name"], mappings, Strategy(**d["strategy"]))
