"""Details, checks and labels: single records, requests before they change anything, files that may go, what a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R

LONGEST_NAME = 255  # bytes
KEYFRAMES, LINES = 100, 100
# Constants of the three encoders (id, width, height, interlaced, colour space, transfer, primaries, H.264 profile and level).
ENCODERS = [
    ("A", 1920, 1080, False, "bt709", "bt709", "bt709", "high", "4.2"),
    ("B", 1920, 1080, True, "bt709", "bt709", "bt709", "high", "4.2"),
    ("C", 1920, 1080, False, "smpte170m", "smpte170m", "smpte170m", "high", "4.2"),
]
ENCODER_DDL = "profile string, target_width int, target_height int, interlaced boolean, colorspace string, color_trc string, color_primaries string, profile_h264 string, level_h264 string"


# files that may go
def cleanup_decisions(sources: DataFrame, jobs: DataFrame, watch: str, target: str, enabled: bool = True) -> DataFrame:
    """Whether a job's source file is deleted, why (the first reason that holds), and the warning that goes with it.
    sources: job_id, path, is_dir, is_there, final_path, initial_size, initial_mtime, size, mtime. Nulls among the initial
    values are not compared; the watch folder itself is never deleted."""
    waiting = jobs.where("state IN ('Pending', 'Processing')").groupBy(F.col("input_path").alias("path")).agg(F.min("id").alias("_least"), F.max("id").alias("_most"))
    path = R.stripped(F.col("path"))
    other = F.col("_least").isNotNull() & (F.col("job_id").isNull() | (F.col("_least") != F.col("job_id")) | (F.col("_most") != F.col("job_id")))
    # Reasons and warnings.
    says = lambda reason, warning=None: F.struct(F.lit(reason).alias("reason"), (warning if isinstance(warning, Column) else F.lit(warning)).cast("string").alias("warning"))
    changed = lambda what, was, now: F.format_string(f"Source file {what} changed during processing (was %d, now %d)", was, now)
    unsafe = F.regexp_replace(F.regexp_replace(R.purge_path_error(F.col("path")), "^Path", "Source path"), "^Cannot purge", "Cannot delete")
    cases = [
        (unsafe.isNotNull(), says("unsafe_path", unsafe)),
        (F.col("is_dir"), says("source_is_directory", "Refusing to delete directory as source file")),
        (~F.col("is_there"), says("already_removed")),
        (~R.below(path, watch), says("outside_source_root", "Source path is outside configured watch directory root")),
        (path == watch.rstrip("/"), says("source_is_directory", "Refusing to delete watch folder root")),
        (R.below(path, target), says("source_matches_target", "Source path is inside target mezzanine directory")),
        (path == F.col("final_path"), says("source_matches_target", "Source path matches final output mezzanine path")),
        (F.col("size") != F.col("initial_size"), says("source_changed", changed("size", F.col("initial_size"), F.col("size")))),
        (F.col("mtime") != F.col("initial_mtime"), says("source_changed", changed("modification time", F.col("initial_mtime"), F.col("mtime")))),
        (other, says("source_referenced", "Source file is currently referenced by another pending or active transcode job")),
    ]
    said = R.first_of(cases, says("deleted")) if enabled else says("disabled")
    rows = sources.join(waiting, "path", "left").select("job_id", "path", said.alias("s")).select("job_id", "path", "s.reason", "s.warning")
    return rows.withColumns({"enabled": F.lit(enabled), "attempted": F.lit(enabled), "deleted": F.col("reason") == "deleted", "skipped": F.col("reason") != "deleted"})


def orphans(listing: DataFrame, folder: str, now: Column, least_age: int) -> DataFrame:
    """Files in flight directly in folder that have not changed for least_age seconds. listing: path, mtime (in seconds)."""
    name = R.basename(F.col("path"))
    stale = R.is_temp_name(F.col("path")) | name.startswith(".tmp_") | name.endswith(".tmp_json")
    here = F.col("path") == F.concat(F.lit(folder.rstrip("/") + "/"), name)
    return listing.where(here & stale & (now - F.col("mtime") >= least_age))


def flushed(polls: DataFrame, timeout: int) -> DataFrame:
    """path, settled: whether a file had one positive size three times in a row before time ran out. polls: path, at (from
    the start), size (null or 0 where there is none)."""
    w = Window.partitionBy("path").orderBy("at")
    size = F.nullif(F.coalesce(F.col("size"), F.lit(0)), F.lit(0))
    runs = polls.withColumn("_size", size).withColumn("_run", F.sum((~F.col("_size").eqNullSafe(F.lag("_size").over(w))).cast("long")).over(w))
    runs = runs.withColumn("_k", F.row_number().over(Window.partitionBy("path", "_run").orderBy("at")))
    done, late = F.min(F.when(F.col("_size").isNotNull() & (F.col("_k") >= 3), F.col("at"))), F.min(F.when(F.col("at") > timeout, F.col("at")))
    return runs.groupBy("path").agg(F.coalesce(done <= F.coalesce(late, done), F.lit(False)).alias("settled"))


def output_name(stem: Column, uuid: Column, others: Column, taken: Column, millis: Column) -> Column:
    """stem_uuid.mp4 (uuid.mp4 without a stem); where that is taken, the same of the first of others (three uuids) that is
    free, and at last stem_uuid_millis.mp4. taken: an array of names."""
    named = lambda u: F.concat(F.when(stem == "", u).otherwise(F.concat(stem, F.lit("_"), u)), F.lit(".mp4"))
    free = F.filter(F.concat(F.array(named(uuid)), F.transform(F.slice(others, 1, 3), named)), lambda n: ~F.array_contains(taken, n))
    return F.coalesce(F.get(free, F.lit(0)), F.concat(stem, F.lit("_"), uuid, F.lit("_"), millis.cast("string"), F.lit(".mp4")))


# requests
def name_error(name: Column) -> Column:
    return R.first_of([(name == "", "display_name_empty"), (F.octet_length(name) > LONGEST_NAME, "display_name_too_long")])


def move_error(folder: Column) -> Column:
    return F.when(~R.valid_folder(folder), "invalid_virtual_folder")


def subclip_checks(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """requests (parent, name, trim_in, trim_out) with problem, effective_out and warnings. assets: uuid, duration_ms,
    mezzanine_ok, keyframes (an array of ms, or null), fps_num, fps_den, deleted_at. Trashed parents are not found."""
    parents = assets.where("deleted_at IS NULL").select(F.col("uuid").alias("parent"), "duration_ms", "mezzanine_ok", "keyframes", "fps_num", "fps_den", F.lit(True).alias("_there"))
    out = F.when(F.col("trim_out") <= 0, F.col("duration_ms")).otherwise(F.col("trim_out"))
    problem = F.coalesce(
        name_error(F.col("name")),
        F.when(F.col("trim_in") < 0, "trim_in_negative"),
        F.when(F.col("_there").isNull(), "parent_not_found"),
        R.trim_error(F.col("trim_in"), F.col("trim_out"), F.col("duration_ms")),
    )
    apart = F.col("mezzanine_ok") & F.col("keyframes").isNotNull() & ~R.near_keyframe(F.col("keyframes"), F.col("trim_in"), F.col("fps_num"), F.col("fps_den"))
    warnings = F.when(problem.isNull() & apart, F.array(F.lit("trim_in_not_keyframe_aligned"))).otherwise(F.array().cast("array<string>"))
    return requests.join(parents, "parent", "left").select(*requests.columns, problem.alias("problem"), F.when(problem.isNull(), out).alias("effective_out"), warnings.alias("warnings"))


# single records
def json_longs(text: Column) -> Column:
    """An array of whole numbers from JSON text; empty if it is anything else."""
    whole = F.schema_of_variant(F.try_parse_json(text)).isin("ARRAY<BIGINT>", "ARRAY<VOID>")
    parsed = F.from_json(text, "array<bigint>")
    return F.when(whole & ~F.exists(parsed, lambda x: x.isNull()), parsed).otherwise(F.array().cast("array<bigint>"))


def as_response(assets: DataFrame) -> DataFrame:
    """Assets as the API gives them: the uuid also as id, no fingerprint, JSON texts (warnings, keyframe_offsets_json) as
    arrays."""
    kept = [c for c in assets.columns if c not in ("fingerprint", "warnings", "keyframe_offsets_json")]
    return assets.select(*kept, F.col("uuid").alias("id"), R.json_strings(F.col("warnings")).alias("warnings"), json_longs(F.col("keyframe_offsets_json")).alias("keyframe_offsets"))


def asset_detail(assets: DataFrame, uuid: str, files: DataFrame) -> DataFrame:
    """An asset's whole summary, with its first hundred keyframes and the texts that it stands in."""
    from .assets import full_summary

    raw = assets.where(F.col("uuid") == uuid)
    texts = raw.select("uuid", F.slice(json_longs(F.col("keyframe_offsets_json")), 1, KEYFRAMES).alias("keyframe_sample"), F.col("warnings").alias("warnings_json"), "keyframe_offsets_json")
    return full_summary(raw, files).join(texts, "uuid")


def tail(lines: Column, n: int) -> Column:
    """The last n elements of an array."""
    return F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n))


def job_detail(jobs: DataFrame, job: str) -> DataFrame:
    """A job's summary, and the last hundred lines of its log (stderr_log_json)."""
    return with_log(jobs.where(F.col("id") == job)).withColumn("stderr_log_tail", tail(F.col("_lines"), LINES)).drop("_lines", "stderr_log_json")


def with_log(jobs: DataFrame) -> DataFrame:
    lines = R.json_strings(F.coalesce("stderr_log_json", F.lit("[]")))
    named = {"input_name": R.basename(F.col("input_path")), "output_name": R.basename(F.col("output_path"))}
    return jobs.withColumns({**named, "_lines": lines}).withColumn("stderr_lines_count", F.size("_lines").cast("long"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Jobs with the names of input and output (null without one) and the number of lines of the log, without the log, the
    lease and what finds the job again."""
    return with_log(jobs).drop("_lines", "stderr_log_json", "fingerprint", "request_hash", "leased_until", "heartbeat_at", "cancel_requested")


def overview(assets: DataFrame, jobs: DataFrame) -> DataFrame:
    """The counts of assets and jobs, one row; one scan of each."""
    from .assets import overview as of_assets

    names = {"pending_jobs": "Pending", "processing_jobs": "Processing", "completed_jobs": "Completed", "failed_jobs": "Failed", "cancelled_jobs": "Cancelled"}
    counts = jobs.agg(F.count("*").alias("total_jobs"), *(F.count_if(F.col("state") == s).alias(n) for n, s in names.items()))
    return of_assets(assets).join(counts, F.lit(True))


def with_progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """jobs with the latest progress of each; events of jobs that are not known are left out. events: id, seq, percent,
    stage, fps, bitrate, speed, current_time_ms."""
    fields = ("percent", "stage", "fps", "bitrate", "speed", "current_time_ms")
    last = events.groupBy("id").agg(F.max_by(F.struct(*fields), "seq").alias("_p"))
    return jobs.join(last, "id", "left").select(*jobs.columns, *(F.col(f"_p.{c}").alias(f"progress_{c}") for c in fields))


def attempts(runs: DataFrame, most: int) -> DataFrame:
    """State and phase of each job after its runs, tried again while the error is one that may pass, most times in all.
    runs: id, attempt (from 1), error (null for success). Runs behind the one that settles the job do not count."""
    kind = R.error_class(F.col("error"), F.lit(False))
    settles = F.col("error").isNull() | (kind != "Retryable") | (F.col("attempt") >= most)
    end = R.first_of([(F.col("error").isNull(), "completed"), (kind == "Cancelled", "cancelled"), (settles, "failed")], "recoverable")
    each = runs.select("id", "attempt", settles.alias("_settles"), end.alias("phase"))
    # the first run that settles the job, else the last one
    out = each.groupBy("id").agg(F.coalesce(F.min_by("phase", F.when(F.col("_settles"), F.col("attempt"))), F.max_by("phase", "attempt")).alias("phase"), F.coalesce(F.min(F.when(F.col("_settles"), F.col("attempt"))), F.max("attempt")).alias("attempts"))
    return out.withColumn("state", R.state_of(F.col("phase")))


def listed(state: DataFrame, listing: DataFrame) -> DataFrame:
    """The rows of state whose path is still there."""
    return state.join(listing.select("path").distinct(), "path", "left_semi")


# encoders
def encoders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENCODERS, ENCODER_DDL)


def threads(given: Column, cores: Column, logical: Column, concurrency: Column) -> tuple[Column, Column]:
    """Threads of an encode, and of all at once: as given; else the cores (half of the logical ones where 0) by the concurrency."""
    own = F.when(cores > 0, cores).otherwise(F.greatest(F.floor(logical / 2), F.lit(1)))
    each = F.when(given > 0, given).when(concurrency == 0, own).otherwise(F.greatest(F.floor(own / concurrency), F.lit(1))).cast("long")
    return each, (each * F.greatest(concurrency, F.lit(1))).cast("long")


# playout
def hydrated(assets: DataFrame) -> DataFrame:
    """Assets as a rundown takes them: 25/1 without a rate, and an end that lies behind the begin."""
    ok, whole = (F.col("fps_num") > 0) & (F.col("fps_den") > 0), F.col("duration_ms")
    end = F.when((F.col("trim_out_ms") == 0) | (F.col("trim_out_ms") > whole), whole).otherwise(F.col("trim_out_ms"))
    end = F.when(whole > 0, F.when(end <= F.col("trim_in_ms"), whole).otherwise(end)).otherwise(F.col("trim_out_ms"))
    return assets.withColumns({"fps_num": F.when(ok, F.col("fps_num")).otherwise(25), "fps_den": F.when(ok, F.col("fps_den")).otherwise(1), "trim_out_ms": end})


def expected_ms(frames: Column, num: Column, den: Column) -> Column:
    """Length of so many frames; null for none, or without a rate."""
    ms = F.round(frames / (num.cast("double") / F.nullif(den, F.lit(0)).cast("double")) * 1000).cast("long")
    return F.when((num > 0) & (den > 0) & (ms > 0), ms)


# labels; fixed values: their texts and limits
def progress_fields(line: Column) -> dict[str, Column]:
    """frame, fps, bitrate and speed of a line of progress; null where it has none."""
    part = lambda pattern: F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return {"frame": part(r"frame=\s*(\d+)").try_cast("long"), "fps": part(r"fps=\s*([\d.]+)").try_cast("double"), "bitrate": part(r"bitrate=\s*([\d.]+kbits/s)"), "speed": part(r"speed=\s*([\d.]+x)")}


def minutes(secs: Column) -> Column:
    return F.concat(F.floor(secs / 60).cast("string"), F.lit(":"), F.lpad(F.floor(secs % 60).cast("string"), 2, "0"))


def tenths(ms: Column) -> Column:
    """ms / 1000 with one decimal, as a double is rounded: by its exact binary value, ties up. The value is taken apart
    into whole numbers, 2^60 times as great."""
    x = ms / F.lit(1000.0)
    high = F.floor(x * F.lit(2.0**30))
    low = F.floor((x * F.lit(2.0**30) - high) * F.lit(2.0**30))
    exact = high.cast("decimal(20,0)") * F.lit(2**30).cast("decimal(10,0)") + low.cast("decimal(20,0)")
    one, doubled = F.lit(2**60).cast("decimal(19,0)"), exact * F.lit(10).cast("decimal(2,0)") + F.lit(2**59).cast("decimal(18,0)")
    n = ((doubled - doubled % one) / one).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def duration_label(ms: Column) -> Column:
    """Tenths of seconds under a minute, else minutes:seconds; a dash for none."""
    secs = ms / 1000.0
    return F.when(ms.isNull() | (ms <= 0), "—").when(secs < 60, F.concat(tenths(ms), F.lit("s"))).otherwise(minutes(secs))


def uptime_label(ms: Column) -> Column:
    """Hours and minutes, under an hour minutes and seconds."""
    secs = F.floor(ms / 1000)
    h, m = F.floor(secs / 3600), F.floor(secs % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %ds", m, secs % 60))


def eta_label(percent: Column, speed: Column, duration: Column, at: Column) -> Column:
    """Time left at a speed like 1.5x; empty before the begin, at the end, and without speed or duration."""
    rate = F.coalesce(F.nullif(F.regexp_extract(speed, r"^\s*(-?[\d.]+)", 1), F.lit("")).try_cast("double"), F.when(F.coalesce(speed, F.lit("")) == "", 1.0))
    left = (duration - at) / F.nullif(rate, F.lit(0.0))
    secs = F.round(left / 1000)
    known = (percent > 0) & (percent < 100) & (rate > 0) & (duration > 0) & (at != 0) & (left > 0)
    return F.when(F.coalesce(known, F.lit(False)), F.concat(F.when(secs < 60, F.concat(secs.cast("long").cast("string"), F.lit("s"))).otherwise(minutes(secs)), F.lit(" left"))).otherwise("")


def short_error(error: Column) -> Column:
    """The first line, at most 220 signs."""
    first = F.regexp_replace(F.get(F.split(error, "\n"), F.lit(0)), "^\\s+|\\s+$", "")
    return F.when(error.isNull() | (error == ""), "Unknown error").when(F.length(first) > 220, F.concat(F.left(first, F.lit(217)), F.lit("…"))).otherwise(first)


def log_level(line: Column) -> Column:
    return R.first_of([(line.contains("[ERROR]") | line.contains("error:"), "error"), (line.contains("[WARN]"), "warn"), (line.contains("Completed"), "success")], "info")


def window_label(total: Column, limit: int, offset: int) -> tuple[Column, Column]:
    """Numbers of the first and last record of a page."""
    return F.when(total == 0, 0).otherwise(offset + 1).cast("long"), F.least(F.lit(offset + limit).cast("long"), total)


def grid(assets: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    """Assets of a status (all of them for "all") with the term in name or path."""
    from .assets import matches

    return (assets if status == "all" else assets.where(F.col("status") == status)).where(matches(search, "display_name", "current_path"))


def status_counts(assets: DataFrame) -> DataFrame:
    """Assets of each status, and of all."""
    return assets.groupBy("status").agg(F.count("*").alias("n")).unionByName(assets.agg(F.lit("all").alias("status"), F.count("*").alias("n")))
