"""Ingest jobs as a stream of events with state: where each job stands, its attempts, and what it failed of.

A job is queued, goes through its stages, and ends completed or failed. A stage only goes forward, only a running job completes or
fails, and a failed one may be queued again up to `ATTEMPTS` times. A job without progress for `PATIENCE` fails by a timer on
event time. What isn't allowed changes nothing and is counted. Events of a job are taken in the order of their time; one
that comes in a later batch though it is older than the job's last step is ignored, too.

Errors are kept without local paths. The events of one job in one batch are sorted in memory, so that a batch should
be bounded (`maxFilesPerTrigger`); jobs themselves are spread over the cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The stages of a job and the length of an error.
STAGES = ["queued", "parsing", "extracting", "resolving", "adjudicating", "storing", "completed", "failed"]
ERROR_CHARS = 300
#: Attempts at most, and microseconds without progress after which a job fails.
ATTEMPTS = 3
PATIENCE = 5 * 86_400 * 1_000_000
TIMED_OUT = "no progress"

STATE = "stage string, status string, attempts int, error string, updated long, accepted int, ignored int"
RESULT = f"job_id long, {STATE}"
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Job:
    """Where a job stands; `updated` is when it last got on, in microseconds."""

    stage: str | None = None
    status: str | None = None
    attempts: int = 0
    error: str | None = None
    updated: int = 0
    accepted: int = 0
    ignored: int = 0

    @property
    def runs(self) -> bool:
        return self.status in ("queued", "processing")


def sanitized(error: str | None) -> str:
    """An error's text as users may see it."""
    return re.sub(r"/\S*", "<path>", error or "unknown error")[:ERROR_CHARS]


def expired(job: Job, now: int, patience: int = PATIENCE) -> Job:
    """The job at `now`, when nothing has happened since."""
    late = job.runs and now - job.updated > patience
    return replace(job, stage="failed", status="failed", error=TIMED_OUT, updated=job.updated + patience) if late else job


def stepped(job: Job, at: int, action: str, stage: str | None, error: str | None, patience: int = PATIENCE) -> Job:
    """The job after an event: `queue`, `step` to a stage, `complete` or `fail`."""
    job = expired(job, at, patience)
    changes: dict = {}
    if at < job.updated:
        pass
    elif action == "queue" and (job.status is None or (job.status == "failed" and job.attempts < ATTEMPTS)):
        changes = {"stage": "queued", "status": "queued", "attempts": job.attempts + 1, "error": None}
    elif action == "step" and job.runs and stage in STAGES[1:6] and STAGES.index(stage) >= STAGES.index(job.stage):
        changes = {"stage": stage, "status": "processing"}
    elif action == "complete" and job.status == "processing":
        changes = {"stage": "completed", "status": "completed"}
    elif action == "fail" and job.runs:
        changes = {"stage": "failed", "status": "failed", "error": sanitized(error)}
    return replace(job, updated=at, accepted=job.accepted + 1, **changes) if changes else replace(job, ignored=job.ignored + 1)


def after(job: Job, events: pd.DataFrame, patience: int = PATIENCE) -> Job:
    """The job after a table of events (at in microseconds, event_id, action, stage, error), in the order of their time."""
    for e in events.sort_values(["at", "event_id"]).itertuples(index=False):
        job = stepped(job, int(e.at), e.action, e.stage, e.error, patience)
    return job


class Tracker(StatefulProcessor):
    """Keeps each job's state, and a timer that fires when the watermark has passed its patience."""

    def __init__(self, patience: int = PATIENCE):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _known(self) -> Job:
        return Job(*self.job.get()) if self.job.exists() else Job()

    def _kept(self, key: tuple, job: Job) -> Iterator[pd.DataFrame]:
        self.job.update(astuple(job))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.runs:
            self.handle.registerTimer((job.updated + self.patience) // 1000 + 1)
        yield pd.DataFrame([(key[0], *astuple(job))], columns=["job_id", *Job.__dataclass_fields__])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        yield from self._kept(key, after(self._known(), events.assign(at=events["us"]), self.patience))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._kept(key, expired(self._known(), expiredTimerInfo.getExpiryTimeInMs() * 1000, self.patience))

    def close(self) -> None:
        pass


def tracked(events: DataFrame, delay: str = "10 minutes", patience: int = PATIENCE) -> DataFrame:
    """A stream of job states from a stream of events (job_id, at, event_id, action, stage, error): a row for each job that a batch touches."""
    rows = events.withWatermark("at", delay).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("job_id").transformWithStateInPandas(Tracker(patience), RESULT, "Update", "EventTime")


def run(events: DataFrame, folder: str, delay: str = "10 minutes", patience: int = PATIENCE) -> DataFrame:
    """Runs the stream over all events there are now; the last state of every job. States go to `folder`, a batch at a time, so that a batch which is run again leaves the same."""
    spark = events.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")

    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        query = tracked(events, delay, patience).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before) if before else spark.conf.unset(ROCKS[0])
    return last_states(spark.read.schema(f"{RESULT}, batch int").parquet(f"{folder}/states"))


def last_states(states: DataFrame) -> DataFrame:
    fields = list(Job.__dataclass_fields__)
    return states.groupBy("job_id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("job_id", "s.*")
