"""A log of a stream's progress: every k-th batch with its rate and the time that is left, in the shared folder."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..runtime import make_folder, write_file

SCHEMA = "query string, batch long, rows long, total long, seconds double, rows_per_second double, left_seconds double, ended boolean"


class ProgressLog(StreamingQueryListener):
    """Writes progress-<query>-<batch>.json after every k-th batch with rows, and one more when the query ends.

    total is how many rows there are to come in all, null if nobody knows; left_seconds goes by the mean rate since the start. Queries are told apart by
    name, so one listener serves a session; `only` names the query to log, else all are.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = 1, total: int | None = None, only: str | None = None) -> None:
        self.spark, self.folder, self.every, self.total, self.only = spark, make_folder(spark, folder), every, total, only
        self.start: dict[str, float] = {}
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        name = event.name or str(event.id)
        self.names[str(event.runId)] = name
        self.start.setdefault(name, time.monotonic())
        self.rows.setdefault(name, 0)
        self.batches.setdefault(name, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = self.names.get(str(p.runId))
        if name is None or not p.numInputRows:
            return
        self.rows[name] += p.numInputRows
        self.batches[name] += 1
        if self.batches[name] % self.every == 0:
            self._write(name, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name is not None:
            self._write(name, True)

    def _write(self, name: str, ended: bool) -> None:
        if self.only not in (None, name):
            return
        n, spent = self.rows[name], max(time.monotonic() - self.start[name], 1e-9)
        left = None if self.total is None else max(0, self.total - n) * spent / n if n else None
        line = {"query": name, "batch": self.batches[name], "rows": n, "total": self.total, "seconds": round(spent, 3), "rows_per_second": round(n / spent, 3), "left_seconds": left if left is None else round(left, 3), "ended": ended}
        write_file(self.spark, f"{self.folder}/progress-{name}-{'end' if ended else f'{self.batches[name]:08}'}.json", json.dumps(line).encode())


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a log so far (SCHEMA)."""
    return spark.read.schema(SCHEMA).json(folder)
