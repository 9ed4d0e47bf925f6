"""The job table: latest states, capacity, expiry, results, summaries. Events are (job_id, seq, ts, status)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that hold a place in the queue, suffixes in the order results are looked up, media types.
ACTIVE = ("queued", "running")
LOOKUP = (".xml", ".txt")
MEDIA = {".xml": "application/xml", ".txt": "text/plain; charset=utf-8"}


def latest(events: DataFrame) -> DataFrame:
    """(job_id, status, legacy, created_at, updated_at, n_events): an aggregate with partial sums, not a window."""
    g = events.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n_events"))
    return g.select("job_id", "status", F.when(F.col("status") == "done", "success").otherwise(F.col("status")).alias("legacy"), "created_at", "updated_at", "n_events")


def capacity(jobs: DataFrame, most: int) -> DataFrame:
    """One row (n_active, n_pending, has_room)."""
    n = F.count(F.when(F.col("status").isin(*ACTIVE), 1))
    return jobs.agg(n.alias("n_active"), F.count(F.when(F.col("status") == "queued", 1)).alias("n_pending"), (n < most).alias("has_room"))


def unexpired(jobs: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """Jobs created within max_age_hours of now. Any status expires, running jobs too: that is the rule of the job table."""
    return jobs.where(F.col("created_at") >= now - F.expr(f"INTERVAL {max_age_hours} HOURS"))


def orphans(files: DataFrame, now: Column, max_age_hours: int = 24) -> DataFrame:
    """files (path, modificationTime): result files older than the cutoff."""
    return files.where(F.col("path").rlike(r"\.(xml|txt)$") & (F.col("modificationTime") < now - F.expr(f"INTERVAL {max_age_hours} HOURS")))


def result_of(jobs: DataFrame, files: DataFrame, which: str | None = None) -> DataFrame:
    """jobs (job_id, status) and files (job_id, suffix) -> (job_id, code, suffix, media): 400 for a bad kind, 500 failed, 202 not done,
    404 without a file, else 200. Without a kind, xml comes before txt."""
    wanted = [s for s in LOOKUP if which is None or s == f".{which}"]
    if not wanted:
        return jobs.select("job_id", F.lit(400).alias("code"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("media"))
    rank = F.array_position(F.array(*map(F.lit, LOOKUP)), F.col("suffix"))
    found = files.where(F.col("suffix").isin(*wanted)).groupBy(F.col("job_id").alias("f_job")).agg(F.min_by("suffix", rank).alias("suffix"))
    rows = jobs.join(found, F.col("job_id") == F.col("f_job"), "left")
    code = F.when(F.col("status") == "failed", 500).when(F.col("status") != "done", 202).when(F.col("suffix").isNull(), 404).otherwise(200)
    suffix = F.when(code == 200, F.col("suffix"))
    media = F.element_at(F.create_map(*(F.lit(x) for kv in MEDIA.items() for x in kv)), suffix)
    return rows.select("job_id", code.alias("code"), suffix.alias("suffix"), media.alias("media"))


def summary(runs: DataFrame) -> DataFrame:
    """runs (ok, seconds) -> one row (n_ok, n_errors, seconds_per_page)."""
    return runs.agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_errors"), F.avg("seconds").alias("seconds_per_page"))


#: Fixed value: what a refused caller is told to wait, in seconds.
RETRY_AFTER = 5


def admitted(requests: DataFrame, active: int, most: int) -> DataFrame:
    """requests (request_id, at, ..) -> with status 202 for as many as the queue has room for, in order of arrival, else 503 with
    retry_after. Only those that are let in are ordered, most of them at most."""
    room = max(0, most - active)
    if not room:
        return requests.withColumn("status", F.lit(503)).withColumn("retry_after", F.lit(RETRY_AFTER))
    first = requests.orderBy("at", "request_id").limit(room).select(F.col("request_id").alias("a_id"), F.lit(True).alias("let_in"))
    rows = requests.join(F.broadcast(first), F.col("request_id") == F.col("a_id"), "left").drop("a_id")
    return rows.withColumn("status", F.when(F.col("let_in"), 202).otherwise(503)).withColumn("retry_after", F.when(F.col("let_in").isNull(), RETRY_AFTER).otherwise(0)).drop("let_in")


def outcomes(outputs: DataFrame) -> DataFrame:
    """outputs (job_id, key) of finished jobs -> (job_id, status, files, error): a file for each output, by its suffix; a job with an
    output of an unknown kind has failed, with the first such kind."""
    suffix = F.element_at(F.create_map(*(F.lit(x) for kv in {"alto": ".xml", "txt": ".txt"}.items() for x in kv)), F.col("key"))
    g = outputs.groupBy("job_id").agg(F.array_sort(F.collect_set(suffix)).alias("found"), F.min(F.when(suffix.isNull(), F.coalesce("key", F.lit("")))).alias("odd"))
    ok = F.col("odd").isNull()
    files = F.transform("found", lambda x: F.concat(F.col("job_id").cast("string"), x))
    return g.select("job_id", F.when(ok, "done").otherwise("failed").alias("status"), F.when(ok, files).otherwise(F.expr("CAST(array() AS array<string>)")).alias("files"), F.concat(F.lit("unknown output: "), "odd").alias("error"))
