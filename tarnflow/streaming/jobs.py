"""Lifecycle of streaming jobs: start, stop, cancel, remove, status and listing, with live figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.job_definition import Job
from .runner import COUNTERS, start_job


class LifecycleError(ValueError):
    """A step that the job's state doesn't allow."""


@dataclass
class _Entry:
    job: Job
    query: StreamingQuery
    folder: str
    spark: SparkSession
    ended: str | None = None


class Jobs:
    """The jobs of a driver by name. State: RUNNING, STOPPED, CANCELLED, FAILED or COMPLETED."""

    def __init__(self) -> None:
        self._jobs: dict[str, _Entry] = {}

    def start(self, job: Job, sources: dict[str, DataFrame], folder: str, kv: Callable[[str], DataFrame] | None = None, available_now: bool = False) -> None:
        """Starts a job, or starts a stopped one again where its checkpoint in folder stands."""
        known = self._jobs.get(job.name)
        if known and self._state(known) in ("RUNNING", "CANCELLED"):
            raise LifecycleError(f"job {job.name!r} is {self._state(known)}")
        self._jobs[job.name] = _Entry(job, start_job(job, sources, folder, kv, available_now), folder, next(iter(sources.values())).sparkSession)

    def _entry(self, name: str) -> _Entry:
        if name not in self._jobs:
            raise LifecycleError(f"no job {name!r}")
        return self._jobs[name]

    def _state(self, e: _Entry) -> str:
        if e.ended:
            return e.ended
        if e.query.isActive:
            return "RUNNING"
        return "FAILED" if e.query.exception() is not None else "COMPLETED"

    def _end(self, name: str, state: str) -> None:
        e = self._entry(name)
        if self._state(e) == "RUNNING":
            e.query.stop()
            e.ended = state

    def stop(self, name: str) -> None:
        """Stops a running job; of one that isn't running nothing changes."""
        self._end(name, "STOPPED")

    def cancel(self, name: str) -> None:
        """Ends a job for good."""
        e = self._entry(name)
        self._end(name, "CANCELLED")
        if e.ended == "STOPPED":
            e.ended = "CANCELLED"

    def remove(self, name: str) -> None:
        if self._state(self._entry(name)) == "RUNNING":
            raise LifecycleError(f"job {name!r} is running")
        del self._jobs[name]

    def status(self, name: str) -> dict:
        """State, and figures of the batches that Spark still remembers; records_out and dropped are of all batches."""
        e = self._entry(name)
        recent = e.query.recentProgress
        last = recent[-1] if recent else None
        error = e.query.exception()
        taken, dropped = self._counted(e)
        told = [(p.observedMetrics or {}).get("late_points") for p in recent]
        late = sum(row["late"] or 0 for row in told if row is not None)
        newest = [m["newest_ms"] for p in recent for k, m in (p.observedMetrics or {}).items() if k.startswith("newest_") and m["newest_ms"] is not None]
        return {
            "watermark_ms": max(newest, default=None), "name": name, "records_out": taken, "dropped": dropped, "late_points": late, "state": self._state(e), "records_in": sum(p.numInputRows for p in recent), "batches": len(recent), "last_batch_ms": last.durationMs.get("triggerExecution", 0) if last else None,
            "rows_a_second": last.processedRowsPerSecond if last else None, "watermark": last.eventTime.get("watermark") if last else None, "error": str(error) if error is not None else None,
        }

    def _counted(self, e: _Entry) -> tuple[int, int]:
        """What the sinks took and dropped, by the counters of every batch that was written."""
        spark, path = e.spark, f"{e.folder}/counters"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return 0, 0
        row = spark.read.schema(COUNTERS).parquet(path).agg(F.sum("taken"), F.sum("dropped")).first()
        return row[0] or 0, row[1] or 0

    def list(self, state: str | None = None) -> list[dict]:
        found = [self.status(n) for n in sorted(self._jobs)]
        return [s for s in found if state is None or s["state"] == state]
