"""The job queue as a stream: state by job with expiry, the landing folder, results by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators.jobs import admitted

TABLE = "job_id long, status string, n_events long, created_at timestamp, updated_at timestamp, expired boolean"


def track(events: DataFrame, max_age_hours: int = 24, lateness: str = "1 hour") -> DataFrame:
    """events (job_id, seq, ts, status) -> (job_id, status, n_events, created_at, updated_at, expired), a row for each change of a job.

    State is the latest event, the first time and the count. A job leaves the table when the watermark is max_age_hours past
    its creation, whatever its status; a later event begins it anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["job_id", "status", "n_events", "created_at", "updated_at", "expired"]
        if state.hasTimedOut:
            status, n, created, updated, _ = state.get
            state.remove()
            yield pd.DataFrame([[key[0], status, n, pd.Timestamp(created, unit="us"), pd.Timestamp(updated, unit="us"), True]], columns=columns)
            return
        status, n, created, updated, seq = state.get if state.exists else (None, 0, None, None, -1)
        for pdf in batches:
            for r in pdf.itertuples():
                at = int(r.ts.value // 1000)
                n, created = n + 1, at if created is None else min(created, at)
                if updated is None or (at, r.seq) > (updated, seq):
                    status, updated, seq = r.status, at, int(r.seq)
        state.update((status, n, created, updated, seq))
        due = created // 1000 + max_age_hours * 3_600_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], status, n, pd.Timestamp(created, unit="us"), pd.Timestamp(updated, unit="us"), False]], columns=columns)

    marked = events.select("job_id", "seq", "ts", "status").withWatermark("ts", lateness)
    return marked.groupBy("job_id").applyInPandasWithState(step, TABLE, "status string, n long, created long, updated long, seq long", "update", GroupStateTimeout.EventTimeTimeout)


def landing(spark: SparkSession, folder: str, files_a_batch: int = 16) -> DataFrame:
    """Uploads as they land: binaryFile rows, files_a_batch at a time, which is the admission limit."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder)


def admit(requests: DataFrame, path: str, checkpoint: str, most: int, active: Callable[[SparkSession], int]):
    """The stream of requests (request_id, at, ..) with the status of each under path. Batches come one after the other, so two
    can't take the same place; active tells how many jobs hold one when a batch begins."""

    def put(batch: DataFrame, number: int) -> None:
        admitted(batch, active(batch.sparkSession), most).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_results(results: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None):
    """Each batch goes, processed, to a folder of its own number, overwritten when the batch is run again: once each."""

    def put(batch: DataFrame, number: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, path: str, checkpoint: str, timeout: int = 300) -> None:
    """All that is there now; changes of each batch under path."""
    query = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream took over {timeout} s")


def current(changes: DataFrame) -> DataFrame:
    """The last change of each job."""
    last = F.max_by(F.struct("status", "n_events", "created_at", "updated_at", "expired"), F.struct("n_events", "expired"))
    return changes.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.status", "s.n_events", "s.created_at", "s.updated_at", "s.expired")
