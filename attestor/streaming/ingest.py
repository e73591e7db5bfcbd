"""Incremental ingest as a stream of claim files.

Each micro-batch drops the claims that were ingested before, forms the pairs that hold a new
claim and appends claims and relations. A claim's id is its content, so a document that is sent again adds nothing, and
one whose claims come in several batches loses none. One query runs one batch at a time, so ingests
never overlap. A batch that is run again after a failure leaves the same rows, as its output
folder is named after the batch and overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import pairs

#: Bytes of a generated method up to which Java compiles it; longer ones, as all of the gate and adjudication in one, would be interpreted. Spark then
#: evaluates each expression in a method of its own.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

STAGES = ["queued", "parsing", "extracting", "resolving", "adjudicating", "storing", "completed", "failed"]


class IncrementalStore:
    """Claims and relations by batch below a folder; `on_stage` hears what a batch does as it begins to do it."""

    def __init__(self, spark: SparkSession, root: str, on_stage: Callable[[str], None] | None = None):
        self.spark, self.root, self.on_stage = spark, root, on_stage or (lambda stage: None)

    def read(self, table: str, schema=None, before: int | None = None) -> DataFrame | None:
        """All rows of a table, or those of batches before one; null if there are none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        rows = self.spark.read.parquet(f"{self.root}/{table}")
        return rows if before is None else rows.where(F.col("batch") < before)

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        conf = rows.sparkSession.conf
        before = conf.get(METHOD_LIMIT, None)
        conf.set(METHOD_LIMIT, METHOD_BYTES)
        try:
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")
        finally:
            conf.set(METHOD_LIMIT, before) if before is not None else conf.unset(METHOD_LIMIT)

    def ingest(self, claims: DataFrame, batch: int) -> None:
        """One micro-batch: new claims only, then pairs of new with new and new with old."""
        self.on_stage("resolving")
        old = self.read("claims", before=batch)
        claims = claims.dropDuplicates(["fact_id"])
        if old is not None:
            old = old.drop("batch")
            claims = claims.join(old.select("fact_id"), "fact_id", "left_anti")
        claims = claims.persist()
        known = claims.limit(0) if old is None else old.select(*claims.columns)
        self.on_stage("adjudicating")
        self.append("relations", pairs.relations(pairs.delta_pairs(claims, known)), batch)
        self.on_stage("storing")
        self.append("claims", claims, batch)
        claims.unpersist()
        self.on_stage("completed")


def start(source: DataFrame, store: IncrementalStore, checkpoint: str):
    """Starts the stream over whatever is there now and ends when it is ingested."""
    query = source.writeStream.foreachBatch(store.ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.start()


class JobLog(StreamingQueryListener):
    """Jobs by id with their stage and times, as rows."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        self.rows.append({"job_id": str(event.id), "stage": "queued", "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        self.rows.append({"job_id": str(event.progress.id), "stage": "storing", "at": event.progress.timestamp})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.append({"job_id": str(event.id), "stage": "failed" if event.exception else "completed", "at": None})


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: tumbling counts by event type under a watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
