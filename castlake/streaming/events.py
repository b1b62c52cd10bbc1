"""Event envelopes: one stream of JSON text, parsed once, routed to typed outputs and a dead-letter output.

An envelope is {"event": name, "data": {...}}. Each kind of event has its fields; what cannot be read as one goes to the
dead letters with the reason, so that every envelope is in exactly one output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEAD = "dead_letters"
#: Fields of each kind of event, the required ones first; the number behind says how many these are.
KINDS: dict[str, tuple[dict[str, str], int]] = {
    "job_update": ({"id": "string", "stage": "string", "phase": "string"}, 2),
    "progress": (
        {"id": "string", "percent": "double", "stage": "string", "current_time_ms": "bigint", "duration_ms": "bigint", "determinate": "boolean", "fps": "double", "bitrate": "string", "speed": "string"},
        2,
    ),
    "completed": ({"id": "string", "uuid": "string"}, 1),
    "failed": ({"id": "string", "error": "string"}, 2),
}


def envelope(event: Column, data: Column) -> Column:
    """The text of an envelope; data is JSON text, or any other text, which is sent as a string."""
    return F.to_json(F.struct(event.alias("event"), F.coalesce(F.try_parse_json(data), F.try_parse_json(F.to_json(F.struct(data.alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(data.alias("s")))) - 6))).alias("data")))


def parsed(envelopes: DataFrame, value: str = "value") -> DataFrame:
    """envelopes with event, data (a variant) and problem: why it is in no typed output, null where it is in one."""
    rows = envelopes.withColumn("_v", F.try_parse_json(F.col(value)))
    rows = rows.withColumns({"event": F.try_variant_get("_v", "$.event", "string"), "data": F.try_variant_get("_v", "$.data", "variant")})
    missing = [(name, [f for f in list(fields)[:needed]], fields) for name, (fields, needed) in KINDS.items()]
    wrong = F.lit(None).cast("string")
    for name, needed, fields in missing:
        lacks = [F.when(F.try_variant_get("data", f"$.{f}", fields[f]).isNull(), F.lit(f"{f}_missing")) for f in needed]
        wrong = F.when(F.col("event") == name, F.coalesce(*lacks)).otherwise(wrong)
    problem = (
        F.when(F.col("_v").isNull(), "not_json")
        .when(F.col("event").isNull(), "no_event")
        .when(~F.col("event").isin(list(KINDS)), "unknown_event")
        .otherwise(wrong)
    )
    return rows.withColumn("problem", problem).drop("_v")


def routed(rows: DataFrame, kind: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """Rows of parsed() that belong to a kind, with its fields; of DEAD: value, event and problem. kept: further columns."""
    if kind == DEAD:
        return rows.where(F.col("problem").isNotNull()).select(*kept, "value", "event", "problem")
    fields, _ = KINDS[kind]
    mine = rows.where(F.col("problem").isNull() & (F.col("event") == kind))
    return mine.select(*kept, *(F.try_variant_get("data", f"$.{f}", t).alias(f) for f, t in fields.items()))


def dispatched(root: str, kept: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each output of a batch below root/kind/batch=N. A batch that is run again writes the same
    folders again, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = parsed(batch).persist()
        try:
            for kind in (*KINDS, DEAD):
                routed(rows, kind, kept).write.mode("overwrite").parquet(f"{root}/{kind}/batch={number}")
        finally:
            rows.unpersist()

    return write


def fanned_out(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The envelopes that changes of jobs send: an update each, and a completed or failed event at an end. changes: id,
    seq, phase, stage, error; jobs: id, uuid. Gives seq, place (order within a change), value."""
    rows = changes.join(jobs.select("id", "uuid"), "id", "left")
    update = F.struct(F.lit("job_update").alias("event"), F.to_json(F.struct("id", "stage", "phase")).alias("data"))
    done = F.struct(F.lit("completed").alias("event"), F.to_json(F.struct("id", "uuid")).alias("data"))
    lost = F.struct(F.lit("failed").alias("event"), F.to_json(F.struct("id", "error")).alias("data"))
    sent = F.when(F.col("phase") == "completed", F.array(update, done)).when(F.col("phase") == "failed", F.array(update, lost)).otherwise(F.array(update))
    return rows.select("seq", F.posexplode(sent).alias("place", "e")).select("seq", "place", envelope(F.col("e.event"), F.col("e.data")).alias("value"))


def progress_stream(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """The latest progress of each job that is known, as a stream joined with the jobs as they are: id and struct progress.
    events: id, seq and the fields of progress. Ids that are not known are left out; write in complete or update mode."""
    fields = ("percent", "stage", "fps", "bitrate", "speed", "current_time_ms")
    known = events.join(jobs.select("id").distinct(), "id", "left_semi")
    return known.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("progress"))
