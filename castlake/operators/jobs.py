"""Reads over transcode_jobs, and the job queue's transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .assets import matches, page

KEPT = 500


def by_state(jobs: DataFrame, name: str = "", search: str = "") -> DataFrame:
    """By state or phase, A-Z without case; all where the name is empty or "all". The search covers the paths and the error."""
    low = name.strip().translate(str.maketrans(R.UPPER, R.LOWER))
    if low and low != "all":
        jobs = jobs.where((R.ascii_lower(F.col("state")) == low) | (R.ascii_lower(F.col("phase")) == low))
    return jobs.where(matches(search, *(c for c in ("id", "uuid", "input_path", "output_path", "error") if c in jobs.columns)))


def by_id(jobs: DataFrame, job: str) -> DataFrame:
    return jobs.where(F.col("id") == job)


def in_state(jobs: DataFrame, state: str) -> DataFrame:
    """Active jobs as they were added; ended ones with the last to finish first, those without a time behind them."""
    found = jobs.where(F.col("state") == state)
    return found.orderBy("created_at", "id") if state == "Processing" else found.orderBy(F.desc_nulls_last("finished_at"), "id")


def recent(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.where("state = 'Pending'").orderBy("created_at", "id")


def viewer(jobs: DataFrame, name: str = "", search: str = "", limit: int | None = None, offset: int | None = None) -> DataFrame:
    rows = by_state(jobs, name, search)
    return page(rows.withColumn("input_name", R.basename(F.col("input_path"))), [F.desc("created_at"), F.asc("id")], limit, offset)


def stats(jobs: DataFrame) -> DataFrame:
    """Cancelled jobs count in the total alone."""
    named = {"pending": "Pending", "active": "Processing", "completed": "Completed", "failed": "Failed"}
    return jobs.agg(*(F.count_if(F.col("state") == s).alias(n) for n, s in named.items()), F.count("*").alias("total"))


def newest(jobs: DataFrame, n: int = KEPT) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def claimed(jobs: DataFrame, worker: str, now: Column, lease_secs: int) -> DataFrame:
    """jobs, the oldest claimable of which (pending and queued, or processing with a lease that is over) has worker and lease."""
    open_ = jobs.where(((F.col("state") == "Pending") & (F.col("phase") == "queued")) | ((F.col("state") == "Processing") & (F.col("leased_until") < now)))
    first = open_.orderBy("created_at", "id").limit(1).select("id", F.lit(True).alias("_mine"))
    mine = F.col("_mine").isNotNull()
    values = {  # the stage's text is a fixed value
        "state": F.lit("Processing"),
        "phase": F.lit("probing"),
        "current_stage": F.lit("Claimed by worker"),
        "worker_id": F.lit(worker),
        "leased_until": now + F.expr(f"INTERVAL {lease_secs} SECONDS"),
        "heartbeat_at": now,
        "started_at": F.coalesce("started_at", now),
    }
    return jobs.join(F.broadcast(first), "id", "left").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_mine")


def heartbeats(jobs: DataFrame, beats: DataFrame, now: Column, lease_secs: int) -> DataFrame:
    """The leases of the jobs that beats (id, worker_id) name go on, but for those whose cancelling was asked for. A worker's
    other jobs, and jobs of another worker than the beat's, stay as they are."""
    named = beats.select("id", F.col("worker_id").alias("_w")).distinct().groupBy("id").agg(F.collect_set("_w").alias("_w"))
    hit = F.coalesce(F.array_contains("_w", F.col("worker_id")), F.lit(False)) & ~F.col("cancel_requested")
    values = {"leased_until": now + F.expr(f"INTERVAL {lease_secs} SECONDS"), "heartbeat_at": now}
    return jobs.join(named, "id", "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(jobs.columns)


def cancel_flags(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """beats (id, worker_id) with what each is answered: whether cancelling of the job was asked for; false where the worker
    has no such job."""
    found = jobs.select("id", "worker_id", F.col("cancel_requested").alias("_c"))
    return beats.join(found, ["id", "worker_id"], "left").select("id", "worker_id", F.coalesce("_c", F.lit(False)).alias("cancel_requested"))


def active_by_request(jobs: DataFrame, request_hash: str) -> DataFrame:
    """An active job of the request, the one of the least id; none if there is none."""
    return jobs.where((F.col("request_hash") == request_hash) & F.col("state").isin("Pending", "Processing")).orderBy("id").limit(1)


def cancelled(jobs: DataFrame, which: Column) -> DataFrame:
    """A queued job is cancelled at once, a running one is asked to stop; both read the phase as it was."""
    done = F.col("phase").isin("completed", "failed", "cancelled")
    hit = which & ~done
    queued = F.col("phase") == "queued"
    return jobs.withColumns({
        "state": F.when(hit & queued, "Cancelled").otherwise(F.col("state")),
        "phase": F.when(hit & queued, "cancelled").when(hit, "cancel_requested").otherwise(F.col("phase")),
    })


def recovered(jobs: DataFrame, now: Column) -> DataFrame:
    """After a crash: processing jobs are queued for another attempt while there is one, else failed."""
    lost = F.col("state") == "Processing"
    again = lost & (F.col("attempt") < F.col("max_attempts"))
    # The stages, the error and its category.
    values = {
        "state": (F.lit("Pending"), F.lit("Failed")),
        "phase": (F.lit("queued"), F.lit("failed")),
        "current_stage": (F.lit("Re-queued (stale crash recovery)"), F.lit("Failed")),
        "error": (F.col("error"), F.lit("Worker crashed or lease expired (attempts exhausted)")),
        "error_category": (F.col("error_category"), F.lit("lease_expired")),
        "worker_id": (F.lit(None), F.lit(None)),
        "leased_until": (F.lit(None), F.lit(None)),
        "heartbeat_at": (F.lit(None), F.col("heartbeat_at")),
        "attempt": (F.col("attempt") + 1, F.col("attempt")),
        "finished_at": (F.col("finished_at"), now),
    }
    return jobs.withColumns({c: F.when(again, queued).when(lost, failed).otherwise(F.col(c)) for c, (queued, failed) in values.items()})


def recovery_counts(jobs: DataFrame) -> DataFrame:
    """How many jobs recovered() queues again, and how many it fails."""
    lost, again = F.col("state") == "Processing", F.col("attempt") < F.col("max_attempts")
    return jobs.agg(F.count_if(lost & again).alias("requeued"), F.count_if(lost & ~again).alias("failed_exhausted"))


def valid_states(jobs: DataFrame) -> DataFrame:
    """States and phases that are not known are Pending and queued."""
    phases = [p for ps in R.PHASES_OF.values() for p in ps]
    return jobs.withColumns({"state": F.when(F.col("state").isin(list(R.PHASES_OF)), F.col("state")).otherwise("Pending"), "phase": F.when(F.col("phase").isin(phases), F.col("phase")).otherwise("queued")})


def upserted(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """All columns of changes but created_at, which stays as it was for jobs that exist."""
    new = changes.select(*(F.col(c).alias(f"_{c}") for c in changes.columns))
    hit = F.col("_id").isNotNull()
    out = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in jobs.columns if c != "created_at"}
    out["created_at"] = F.coalesce("created_at", "_created_at")
    return jobs.join(new, F.col("id") == F.col("_id"), "full_outer").select(*(out[c].alias(c) for c in jobs.columns))


def added(jobs: DataFrame, more: DataFrame) -> DataFrame:
    """more, where its id is not there yet."""
    return jobs.unionByName(more.join(jobs, "id", "left_anti"))


def busy_sources(jobs: DataFrame) -> DataFrame:
    """Jobs whose source another pending or processing job uses."""
    others = jobs.where("state IN ('Pending', 'Processing')").groupBy("input_path").agg(F.count("*").alias("n"))
    own = F.col("state").isin("Pending", "Processing").cast("long")
    return jobs.join(others, "input_path").where(F.col("n") - own > 0).drop("n")
