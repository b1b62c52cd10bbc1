"""Registered queries of details, request checks, cleanups and labels, each beside the SQL that it is held against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import assets as A
from ..operators import details as D
from ..operators import encodes as C
from ..operators import transitions as T
from ..sources.media import first_keyframe_ms, measured_loudness
from .registry import ASSETS, COLS, FULL, JCOLS, JCORE, JOBS, SUB, all_fields, registered, table
from .relations import RELATIONS, relation

N = "CAST(substr(%s, 2) AS BIGINT)"


def view(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """SQL that Spark and DuckDB share; {name} is a table or relation."""
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: relation(spark, sf, n) if n in RELATIONS else table(spark, sf, n) for n in names})


def duck(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


# files that may go
SOURCES = f"""SELECT id AS job_id, CASE k % 11 WHEN 0 THEN ' ' WHEN 1 THEN '/watch/../x.mov' WHEN 2 THEN '/' WHEN 3 THEN '/other/a.mov' WHEN 4 THEN '/watch/out/b.mov' WHEN 5 THEN '/watching/c.mov' WHEN 6 THEN '/watch' WHEN 7 THEN '/watch/a' || chr(92) || '..' || chr(92) || 'd.mov' WHEN 8 THEN chr(9) || '/watch/in/e.mov' || chr(10) ELSE input_path END AS path,
 k % 13 = 0 AS is_dir, k % 17 <> 0 AS is_there, CASE WHEN k % 29 = 0 THEN input_path ELSE '/watch/out/x.mp4' END AS final_path,
 CASE WHEN k % 23 <> 0 THEN CAST(100 AS BIGINT) END AS initial_size, CAST(5 AS BIGINT) AS initial_mtime, CAST(CASE WHEN k % 19 = 0 THEN 101 ELSE 100 END AS BIGINT) AS size, CAST(CASE WHEN k % 31 = 0 THEN 6 ELSE 5 END AS BIGINT) AS mtime
 FROM (SELECT *, {N % "id"} AS k FROM {{transcode_jobs}})"""
OPEN = f"state IN ('Pending', 'Processing') AND {N % 'id'} % 50 = 0"
REASONS = """CASE WHEN p = '' THEN ['unsafe_path', 'Source path is empty'] WHEN contains(replace(p, chr(92), '/'), '/../') THEN ['unsafe_path', 'Source path contains parent directory traversal (..)'] WHEN p = '/' THEN ['unsafe_path', 'Cannot delete root directory']
 WHEN is_dir THEN ['source_is_directory', 'Refusing to delete directory as source file'] WHEN NOT is_there THEN ['already_removed', NULL] WHEN NOT starts_with(p || '/', '/watch/') THEN ['outside_source_root', 'Source path is outside configured watch directory root']
 WHEN p = '/watch' THEN ['source_is_directory', 'Refusing to delete watch folder root'] WHEN starts_with(p || '/', '/watch/out/') THEN ['source_matches_target', 'Source path is inside target mezzanine directory'] WHEN p = final_path THEN ['source_matches_target', 'Source path matches final output mezzanine path']
 WHEN size <> coalesce(initial_size, size) THEN ['source_changed', 'Source file size changed during processing (was ' || initial_size || ', now ' || size || ')'] WHEN mtime <> initial_mtime THEN ['source_changed', 'Source file modification time changed during processing (was ' || initial_mtime || ', now ' || mtime || ')']
 WHEN busy THEN ['source_referenced', 'Source file is currently referenced by another pending or active transcode job'] ELSE ['deleted', NULL] END"""
CLEANUP = f"""SELECT job_id, path, r[1] AS reason, r[2] AS warning, true AS enabled, true AS attempted, r[1] = 'deleted' AS deleted, r[1] <> 'deleted' AS skipped FROM (SELECT job_id, path, {REASONS} AS r
 FROM (SELECT s.*, trim(path, ' ' || chr(9) || chr(10)) AS p, EXISTS (SELECT 1 FROM transcode_jobs o WHERE {OPEN} AND o.input_path = s.path AND o.id <> s.job_id) AS busy FROM ({duck(SOURCES)}) s))"""
registered("m30_cleanup", CLEANUP)(lambda spark, sf: D.cleanup_decisions(view(spark, sf, SOURCES), relation(spark, sf, JOBS).where(OPEN), "/watch/", "/watch/out"))
registered("m30_cleanup_disabled", "SELECT id AS job_id, 'disabled' AS reason, false AS attempted, false AS enabled FROM transcode_jobs")(lambda spark, sf: D.cleanup_decisions(view(spark, sf, SOURCES), relation(spark, sf, JOBS), "/watch", "/watch/out", False).select("job_id", "reason", "attempted", "enabled"))
LISTING = "SELECT CASE event_id % 6 WHEN 0 THEN '/out/a.mp4' WHEN 1 THEN '/out/.tmp_b.mp4' WHEN 2 THEN '/out/c.tmp_json' WHEN 3 THEN '/out/sub/d.part' WHEN 4 THEN '/out/e.PART' ELSE '/out/f.uuid.json' END AS path, event_id AS mtime FROM {events}"
registered("m29_orphans", f"SELECT path, mtime FROM ({duck(LISTING)}) WHERE mtime % 6 IN (1, 2, 4, 5) AND mtime <= 900")(lambda spark, sf: D.orphans(view(spark, sf, LISTING), "/out/", F.lit(1000), 100))
POLLS = "SELECT CAST(user_id AS STRING) AS path, event_id AS at, CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 0 WHEN 'error' THEN NULL ELSE 7 END AS size FROM {events}"
registered("w04_flushed", f'SELECT path, coalesce(min("at") FILTER (size > 0 AND size = one AND size = two) <= coalesce(min("at") FILTER ("at" > 700), 1000000000), false) AS settled FROM (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY "at") AS one, lag(size, 2) OVER (PARTITION BY path ORDER BY "at") AS two FROM ({duck(POLLS)})) GROUP BY path')(
    lambda spark, sf: D.flushed(view(spark, sf, POLLS), 700)
)


def output_names(jobs: DataFrame) -> DataFrame:
    """Jobs with none, one, three or four names taken."""
    j = jobs.select("id", F.expr(N % "id").alias("k")).withColumn("stem", F.when(F.col("k") % 3 == 0, "").otherwise("s"))
    name = lambda u: F.concat(F.when(F.col("stem") == "", "").otherwise("s_"), u, F.lit(".mp4"))
    names = F.array(name(F.col("id")), name(F.lit("x")), name(F.lit("y")), name(F.lit("z")))
    taken = F.slice(names, F.lit(1), F.element_at(F.array(*map(F.lit, (0, 1, 3, 4))), (F.col("k") % 4 + 1).cast("int")))
    return j.select("id", D.output_name(F.col("stem"), F.col("id"), F.array(*map(F.lit, "xyz")), taken, F.lit(77)).alias("name"))


registered("x22_output_names", f"SELECT id, CASE WHEN k % 4 = 3 THEN stem || '_' || id || '_77.mp4' ELSE CASE WHEN stem = '' THEN '' ELSE 's_' END || CASE k % 4 WHEN 0 THEN id WHEN 1 THEN 'x' ELSE 'z' END || '.mp4' END AS name FROM (SELECT id, {N % 'id'} AS k, CASE WHEN {N % 'id'} % 3 = 0 THEN '' ELSE 's' END AS stem FROM transcode_jobs)", JOBS)(output_names)

# requests
REQUESTS = f"""SELECT uuid AS request, CASE WHEN k % 9 = 0 THEN 'none' ELSE uuid END AS parent, CASE WHEN k % 10 = 0 THEN '' WHEN k % 14 = 0 THEN repeat('ä', 128) ELSE repeat('ä', 127) END AS name,
 CASE WHEN k % 7 = 0 THEN CAST(-1 AS BIGINT) ELSE 1980 + k % 60 END AS trim_in, CASE k % 5 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN CAST(1000 AS BIGINT) WHEN 2 THEN duration_ms + 1 ELSE duration_ms END AS trim_out
 FROM (SELECT *, {N % "uuid"} AS k FROM {{media_assets}})"""
CHECKED = f"""SELECT request, parent, name, trim_in, trim_out, problem, CASE WHEN problem IS NULL THEN e END AS effective_out,
 CASE WHEN problem IS NULL AND mezzanine_ok AND fingerprint % 8 <> 0 AND abs(trim_in - 2000) > 500.0 / (CAST(fps_num AS DOUBLE) / fps_den) THEN ['trim_in_not_keyframe_aligned'] ELSE CAST([] AS VARCHAR[]) END AS warnings
 FROM (SELECT *, CASE WHEN name = '' THEN 'display_name_empty' WHEN octet_length(encode(name)) > 255 THEN 'display_name_too_long' WHEN trim_in < 0 THEN 'trim_in_negative' WHEN uuid IS NULL THEN 'parent_not_found'
  WHEN duration_ms <= 0 THEN 'no_duration' WHEN e <= trim_in THEN 'trim_out_not_after_trim_in' WHEN e > duration_ms THEN 'trim_out_exceeds_duration' END AS problem
  FROM (SELECT r.*, a.uuid, a.duration_ms, a.mezzanine_ok, a.fingerprint, a.fps_num, a.fps_den, CASE WHEN trim_out <= 0 THEN duration_ms ELSE trim_out END AS e FROM ({duck(REQUESTS)}) r LEFT JOIN (SELECT * FROM media_assets WHERE deleted_at IS NULL) a ON a.uuid = r.parent))"""
registered("f19_subclip_checks", CHECKED)(
    lambda spark, sf: D.subclip_checks(view(spark, sf, REQUESTS), relation(spark, sf, ASSETS).withColumn("keyframes", F.when(F.col("fingerprint") % 8 != 0, F.array(*(F.lit(x).cast("long") for x in (0, 2000, 4000))))))
)
registered("f20_rename_and_move", "SELECT uuid, CASE fingerprint % 3 WHEN 0 THEN 'display_name_empty' WHEN 1 THEN 'display_name_too_long' END AS name_problem, CASE WHEN fingerprint % 4 IN (0, 1, 2) THEN 'invalid_virtual_folder' END AS folder_problem FROM media_assets", ASSETS)(
    lambda a: a.select("uuid", D.name_error(F.when(F.col("fingerprint") % 3 == 0, "").when(F.col("fingerprint") % 3 == 1, F.repeat(F.lit("x"), 256)).otherwise("x")).alias("name_problem"), D.move_error(F.element_at(F.array(*map(F.lit, ("a", "/a/", "/../a", "/a"))), (F.col("fingerprint") % 4 + 1).cast("int"))).alias("folder_problem"))
)


# single records
def with_json(assets: DataFrame) -> DataFrame:
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (F.col("fingerprint") % len(texts) + 1).cast("int"))
    return assets.withColumns({"warnings": pick('["a","b"]', "bad", "[]"), "keyframe_offsets_json": pick("[0,2000]", '[1,"x"]', "[]", "[1.5]", "[null]")})


RESPONSE = f"""SELECT * EXCLUDE (fingerprint, warnings, keyframe_offsets_json), CASE WHEN fingerprint % 2 = 0 THEN 'None' ELSE 'tp' || fingerprint END AS tp, uuid AS id, CASE WHEN fingerprint % 3 = 0 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS warnings, CASE WHEN fingerprint % 5 = 0 THEN CAST([0, 2000] AS BIGINT[]) ELSE CAST([] AS BIGINT[]) END AS keyframe_offsets
 FROM (SELECT {FULL} FROM (SELECT {COLS}, fps_num, fps_den FROM media_assets))"""


@registered("f07_responses", RESPONSE, ASSETS)
def responses(assets: DataFrame) -> DataFrame:
    """Every field that the API gives of an asset, of all assets."""
    tp = F.when(F.col("fingerprint") % 2 == 0, "None").otherwise(F.concat(F.lit("tp"), F.col("fingerprint").cast("string")))
    return D.as_response(with_json(all_fields(assets).withColumn("tp", tp)))


SUMMARY = f"uuid, status, current_path, {SUB} OR contains(lower(display_name), 'subclip') OR contains(lower(display_name), 'sub-clip') AS is_subclip, regexp_extract(current_path, '[^/]*$') AS display_path, CASE WHEN fingerprint % 3 = 0 THEN ['a', 'b'] ELSE CAST([] AS VARCHAR[]) END AS warnings, CASE WHEN fingerprint % 5 = 0 THEN CAST(2 AS BIGINT) ELSE 0 END AS keyframe_count, CAST(NULL AS VARCHAR) AS parent_uuid, fingerprint % 4 < 2 AS sidecar_exists"
SUMMED = ["uuid", "status", "current_path", "is_subclip", "display_path", "warnings", "keyframe_count", "parent_uuid", "sidecar_exists"]


def sidecar_files(assets: DataFrame) -> DataFrame:
    """Sidecars of half of the assets: at their place, or beside the file."""
    beside = F.regexp_replace("current_path", "mp4$", "uuid.json")
    return assets.where("fingerprint % 4 < 2").select(F.when(F.col("fingerprint") % 4 == 0, R.sidecar_path(F.col("current_path"))).otherwise(beside).alias("path")).unionByName(assets.select(F.col("current_path").alias("path")))


def with_texts(assets: DataFrame) -> DataFrame:
    return assets.select("uuid", "fingerprint", "status", "current_path", "display_name", "trim_in_ms", "trim_out_ms", "duration_ms").join(with_json(assets).select("uuid", "warnings", "keyframe_offsets_json"), "uuid")


registered("f08_full_summary", f"SELECT {SUMMARY} FROM media_assets", ASSETS)(lambda a: A.full_summary(with_texts(a), sidecar_files(a)).select(SUMMED))
registered("f11_asset_detail", f"SELECT {SUMMARY}, CASE WHEN fingerprint % 5 = 0 THEN CAST([0, 2000] AS BIGINT[]) ELSE CAST([] AS BIGINT[]) END AS keyframe_sample, CASE fingerprint % 3 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN 'bad' ELSE '[]' END AS warnings_json, ['[0,2000]', '[1,\"x\"]', '[]', '[1.5]', '[null]'][fingerprint % 5 + 1] AS keyframe_offsets_json FROM media_assets WHERE uuid = 'a000000000036'", ASSETS)(
    lambda a: D.asset_detail(with_texts(a), "a000000000036", sidecar_files(a)).select(*SUMMED, "keyframe_sample", "warnings_json", "keyframe_offsets_json")
)
LOG = f"list_transform(range(0, {N % 'id'} % 7 * 30), lambda x: 'l' || CAST(x AS VARCHAR))"
JSUMMARY = f"id, state, input_path, output_path, regexp_extract(input_path, '[^/]*$') AS input_name, regexp_extract(output_path, '[^/]*$') AS output_name, len({LOG}) AS stderr_lines_count"


def with_lines(jobs: DataFrame) -> DataFrame:
    n = (F.expr(N % "id") % 7 * 30).cast("int")
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.concat(F.lit("l"), x.cast("string"))))
    return jobs.select("id", "state", "input_path", "output_path", "fingerprint", "leased_until", "heartbeat_at", "cancel_requested").withColumn("stderr_log_json", F.to_json(lines))


registered("f09_job_summary", f"SELECT {JSUMMARY} FROM transcode_jobs", JOBS)(lambda j: D.job_summary(with_lines(j)))
registered("f12_job_detail", f"SELECT {JSUMMARY}, fingerprint, leased_until, heartbeat_at, cancel_requested, {LOG}[-100:] AS stderr_log_tail FROM transcode_jobs WHERE id = 'j000000000006'", JOBS)(lambda j: D.job_detail(with_lines(j), "j000000000006"))
FILES = "SELECT current_path AS path FROM {media_assets} WHERE fingerprint % 3 > 0 UNION ALL SELECT replace(replace(current_path, '/videos/', '/sidecars/'), '.mp4', '.uuid.json') FROM {media_assets} WHERE fingerprint % 4 > 0"
GOES = "(deleted_at IS NOT NULL AND fingerprint % 5 > 0 OR fingerprint % 10 = 0)"
OUTCOME = f"""SELECT uuid, current_path, refs = 0 AND fingerprint % 20 > 0 AND fingerprint % 3 > 0 AS media_removed, refs = 0 AND fingerprint % 20 > 0 AND fingerprint % 4 > 0 AS sidecar_removed, refs > 0 AS skipped_referenced,
 CASE WHEN refs > 0 THEN 'Physical media retained because ' || refs || ' other reference(s) still point to it' WHEN fingerprint % 20 = 0 THEN 'Physical file cleanup skipped: Path is outside managed target directory root' END AS warning
 FROM (SELECT uuid, fingerprint, CASE WHEN fingerprint % 20 = 0 THEN '/else' ELSE '' END || current_path AS current_path, (SELECT COUNT(*) FROM media_assets o WHERE o.current_path = a.current_path AND NOT {GOES.replace('deleted_at', 'o.deleted_at').replace('fingerprint', 'o.fingerprint')}) AS refs FROM media_assets a WHERE {GOES})"""


def moved_some(assets: DataFrame) -> DataFrame:
    return assets.withColumn("current_path", F.when(F.col("fingerprint") % 20 == 0, F.concat(F.lit("/else"), "current_path")).otherwise(F.col("current_path")))


registered("m14_purge_outcome", OUTCOME)(lambda spark, sf: T.purge_outcome(moved_some(relation(spark, sf, ASSETS)), F.expr(GOES), view(spark, sf, FILES), "/watch", "/target"))
registered("m14_purge_result", f"SELECT 'purge_asset' AS operation, COUNT(*) AS rows_deleted, coalesce(bool_or(refs = 0 AND fingerprint % 3 > 0), false) AS media_removed, coalesce(bool_or(refs = 0 AND fingerprint % 4 > 0), false) AS sidecar_removed, coalesce(list(current_path) FILTER (refs > 0), []) AS skipped_referenced_files, CAST([] AS VARCHAR[]) AS cleanup_failures, coalesce(list('Physical media retained because ' || refs || ' other reference(s) still point to it') FILTER (refs > 0), []) AS warnings FROM (SELECT *, (SELECT COUNT(*) FROM media_assets o WHERE o.current_path = a.current_path AND o.uuid <> a.uuid) AS refs FROM media_assets a WHERE uuid = 'a000000000039')")(
    lambda spark, sf: T.purge_one(relation(spark, sf, ASSETS), "a000000000039", view(spark, sf, FILES), "/watch", "/target")
)
registered("o06_tails", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST([] AS BIGINT[]) WHEN 1 THEN CAST([1, 2] AS BIGINT[]) ELSE CAST([3, 4, 5] AS BIGINT[]) END AS kept FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", D.tail(F.when(F.col("event_id") % 3 == 0, F.array().cast("array<bigint>")).when(F.col("event_id") % 3 == 1, F.sequence(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))), 3).alias("kept"))
)
registered(
    "a01_overview_with_jobs",
    f"SELECT a.*, greatest(total - subclips, 0) AS master, j.* FROM (SELECT COUNT(*) FILTER (deleted_at IS NULL) AS total, COUNT(*) FILTER (deleted_at IS NULL AND {SUB}) AS subclips, COUNT(deleted_at) AS trashed, COUNT(*) FILTER (deleted_at IS NULL AND status = 'ready') AS ready, COUNT(*) FILTER (deleted_at IS NULL AND status = 'processing') AS processing, COUNT(*) FILTER (deleted_at IS NULL AND status = 'error') AS error, COUNT(*) FILTER (deleted_at IS NULL AND mezzanine_ok) AS mezzanine_ok FROM media_assets) a, (SELECT COUNT(*) AS total_jobs, COUNT(*) FILTER (state = 'Pending') AS pending_jobs, COUNT(*) FILTER (state = 'Processing') AS processing_jobs, COUNT(*) FILTER (state = 'Completed') AS completed_jobs, COUNT(*) FILTER (state = 'Failed') AS failed_jobs, COUNT(*) FILTER (state = 'Cancelled') AS cancelled_jobs FROM transcode_jobs) j",
    ASSETS, JOBS,
)(D.overview)
PROGRESS = "SELECT 'j' || lpad(CAST(user_id AS STRING), 12, '0') AS id, event_id AS seq, CAST(event_id % 101 AS DOUBLE) AS percent, event_type AS stage, value AS fps, 'k' || CAST(event_id AS STRING) AS bitrate, '1x' AS speed, event_id * 40 AS current_time_ms FROM {events}"
registered("j11_progress", f"SELECT {JCOLS}, percent AS progress_percent, stage AS progress_stage, fps AS progress_fps, bitrate AS progress_bitrate, speed AS progress_speed, current_time_ms AS progress_current_time_ms FROM transcode_jobs LEFT JOIN (SELECT * FROM ({duck(PROGRESS)}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) USING (id)")(
    lambda spark, sf: D.with_progress(relation(spark, sf, JOBS).select(JCORE), view(spark, sf, PROGRESS))
)
RUNS = "SELECT user_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS attempt, CASE event_type WHEN 'view' THEN 'ffmpeg exited with code 1' WHEN 'error' THEN 'Probe: bad' WHEN 'signup' THEN 'cancelled by user' WHEN 'click' THEN 'file locked' END AS error FROM {events}"
registered("t08_attempts", f"""WITH e AS (SELECT *, error IS NULL OR error IN ('Probe: bad', 'cancelled by user') OR attempt >= 3 AS settles FROM ({duck(RUNS)})),
 p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY NOT settles, CASE WHEN settles THEN attempt ELSE -attempt END) AS k FROM e)
 SELECT id, attempt AS attempts, CASE WHEN error IS NULL THEN 'completed' WHEN error = 'cancelled by user' THEN 'cancelled' WHEN settles THEN 'failed' ELSE 'recoverable' END AS phase, CASE WHEN error IS NULL THEN 'Completed' WHEN error = 'cancelled by user' THEN 'Cancelled' WHEN settles THEN 'Failed' ELSE 'Processing' END AS state FROM p WHERE k = 1""")(
    lambda spark, sf: D.attempts(view(spark, sf, RUNS), 3)
)
registered("j08_listed", "SELECT uuid, current_path FROM media_assets WHERE current_path IN (SELECT current_path FROM media_assets WHERE status = 'ready')", ASSETS)(lambda a: D.listed(a.select("uuid", F.col("current_path").alias("path")), a.where("status = 'ready'").select(F.col("current_path").alias("path"))).select("uuid", F.col("path").alias("current_path")))

# encoders
registered("j09_encoders", "SELECT p_partkey, profile, 1920 AS target_width, 1080 AS target_height, profile = 'B' AS interlaced, CASE WHEN profile = 'C' THEN 'smpte170m' ELSE 'bt709' END AS colorspace, CASE WHEN profile = 'C' THEN 'smpte170m' ELSE 'bt709' END AS color_trc, CASE WHEN profile = 'C' THEN 'smpte170m' ELSE 'bt709' END AS color_primaries, 'high' AS profile_h264, '4.2' AS level_h264 FROM (SELECT p_partkey, CASE WHEN p_size * 40 > 900 AND p_brand LIKE '%1' THEN 'B' WHEN p_size * 40 > 900 THEN 'A' ELSE 'C' END AS profile FROM part)")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", R.profile(F.col("p_size") * 40, F.when(F.col("p_brand").endswith("1"), "tff").otherwise("progressive")).alias("profile")).join(F.broadcast(D.encoders(spark)), "profile")
)
LOUD = """SELECT event_id, CAST(event_id % 8 AS DOUBLE) AS secs, CASE WHEN event_id % 13 = 0 THEN 'no document' ELSE '[log 1] begins' || chr(10) || chr(123) || chr(10) || '"input_i" : "' || CASE WHEN event_id % 9 = 0 THEN '-inf' ELSE CAST(-(event_id % 90) AS STRING) || '.50' END || '", "input_tp" : "-3.00", "input_lra" : "' || CAST(event_id % 15 AS STRING) || '.00", "input_thresh" : "-40.00"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "target_offset" : "0.25"' END || chr(125) || chr(10) || 'end' END AS text FROM {events}"""
LOUDNESS = """SELECT event_id, CASE WHEN NOT isinf(i) THEN i END AS input_i, CASE WHEN i IS NULL THEN NULL WHEN event_id % 4 > 0 THEN 0.25::DOUBLE WHEN isinf(i) THEN 0 ELSE -23 - i END AS target_offset, i <= -70 AS is_silent, CASE WHEN i IS NOT NULL THEN secs > 0 AND secs < 3 END AS is_short, CASE WHEN i IS NOT NULL THEN NOT (i <= -70) AND NOT (secs > 0 AND secs < 3) AND -3.0 + (-23.0 - i) <= -0.999 AND lra <= 10.501 END AS is_linear
 FROM (SELECT event_id, CAST(event_id % 8 AS DOUBLE) AS secs, CAST(event_id % 15 AS DOUBLE) AS lra, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 9 = 0 THEN '-infinity'::DOUBLE ELSE -(event_id % 90) - 0.5 END AS i FROM events)"""


@registered("s20_loudness", LOUDNESS)
def loudness(spark: SparkSession, sf: str) -> DataFrame:
    """Loudness logs of the events, one in 13 of them without a document."""
    m = measured_loudness(F.col("text"), F.col("secs"), [F.lit(-23.0), F.lit(-1.0), F.lit(7.0)])
    rows = view(spark, sf, LOUD).withColumn("m", m).select("event_id", F.when(F.abs("m.input_i") < float("inf"), F.col("m.input_i")).alias("input_i"), "m.target_offset", "m.is_silent", "m.is_short", "m.is_linear")
    return rows


GOP = "SELECT uuid, NOT (short AND n > 1) AS closed FROM (SELECT uuid, fingerprint % 6 AS n, fingerprint % 4 = 0 AS short FROM media_assets)"


@registered("w01_closed_gop", GOP, ASSETS)
def closed_gop(assets: DataFrame) -> DataFrame:
    """Keyframes at the GOP's distance, less up to half a frame; a quarter of the assets has one gap that is a frame too short."""
    frame = F.lit(1000.0) * F.col("fps_den") / F.col("fps_num")
    step = F.lit(1000.0) * R.gop(F.col("fps_num"), F.col("fps_den")) * F.col("fps_den") / F.col("fps_num")
    n = (F.col("fingerprint") % 6).cast("int")
    # whole gaps are cut off by less than a ms, which half a frame covers; the last one may be short
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.ceil(k * step) - F.when((F.col("fingerprint") % 4 == 0) & (k == n - 1) & (k > 0), F.ceil(frame)).otherwise(F.lit(0))).cast("long"))
    keyframes = F.when(n > 0, places).otherwise(F.array().cast("array<long>"))
    return assets.select("uuid", R.closed_gop(keyframes, F.col("fps_num"), F.col("fps_den")).alias("closed"))


NAMES = ("a", "ProfileB", "profile_c", "H264-720P50", "x-prores-1080i50", "prores-1080i50", "d", "", "profile-a")
registered("x33_aliases", "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'h264-1080p25' WHEN 1 THEN 'h264-1080i50' WHEN 2 THEN 'h264-1080p25-sd-pal' WHEN 3 THEN 'h264-720p50' WHEN 5 THEN 'prores-1080i50' END AS profile FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", C.profile_name(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 9 + 1).cast("int"))).alias("profile"))
)
REGISTRY = """SELECT event_id, asked, width, height, CAST(width AS DOUBLE) * height * 25 AS pixels, interlaced, crf, maxrate, video_level FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'c' WHEN 3 THEN 'h264-720p50' ELSE 'prores-1080i50' END AS asked, event_id % 5 AS k FROM events) JOIN
 (VALUES (0, 1920, 1080, false, 17, '15M', '4.2'), (1, 1920, 1080, true, 18, '15M', '4.2'), (2, 1920, 1080, false, 20, '10M', '4.2'), (3, 1280, 720, false, 17, '12M', '4.1'), (4, 1920, 1080, true, NULL, NULL, NULL)) AS p(k, width, height, interlaced, crf, maxrate, video_level) USING (k)"""


@registered("s21_profiles", REGISTRY)
def profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The registry, joined with what each event asks for."""
    asked = table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("A", "b", "c", "h264-720p50", "prores-1080i50"))), (F.col("event_id") % 5 + 1).cast("int")).alias("asked"))
    found = asked.withColumn("name", C.profile_name(F.col("asked"))).join(F.broadcast(C.profiles(spark)), "name")
    return found.select("event_id", "asked", "width", "height", (F.col("width").cast("double") * F.col("height") * 25).alias("pixels"), "interlaced", "crf", "maxrate", "video_level")


ARGS = """SELECT id, problem, CASE WHEN problem IS NULL THEN list_concat(list_concat(list_concat(
 ['-y', '-hide_banner', '-loglevel', 'info', '-stats', '-analyzeduration', '100M', '-probesize', '50M', '-fflags', '+genpts', '-i', input_path, '-map_metadata', '-1', '-map_chapters', '-1', '-vf', 'fps=25/1,scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2,setsar=1,format=yuv420p',
  '-fps_mode', 'cfr', '-video_track_timescale', '1000', '-f', 'mp4', '-c:v', 'libx264', '-preset', 'medium', '-crf', CAST(17 + p AS VARCHAR), '-maxrate', '15M', '-bufsize', '30M', '-profile:v', 'high', '-level', '4.2', '-pix_fmt', 'yuv420p', '-r', '25/1', '-colorspace', color, '-color_trc', color, '-color_primaries', color,
  '-g', '50', '-keyint_min', '50', '-sc_threshold', '0', '-x264-params', 'open-gop=0:keyint=50:min-keyint=50:scenecut=0' || CASE WHEN p = 1 THEN ':interlaced=1:pic-struct=1' ELSE '' END],
 CASE WHEN p = 1 THEN ['-flags', '+ilme+ildct', '-field_order', 'tt'] ELSE [] END || CASE WHEN k % 2 = 0 THEN ['-tune', 'film'] ELSE [] END || ['-movflags', '+faststart', '-threads', CAST(k % 4 + 1 AS VARCHAR), '-map', '0:v:0', '-map', '0:a:0?']),
 CASE WHEN k % 3 > 0 AND ch > 0 AND flt <> '' THEN ['-af', flt] ELSE [] END || ['-c:a', codec]),
 CASE codec WHEN 'pcm_s16le' THEN ['-ar', '48000', '-ac', och] WHEN 'libmp3lame' THEN ['-b:a', '192k', '-ar', '48000', '-ac', och] ELSE ['-b:a', '192k', '-ar', '48000', '-ac', och, '-async', '1'] END || ['-max_muxing_queue_size', '4096', output]) END AS args
 FROM (SELECT *, CASE WHEN k % 3 > 0 AND (ch = 3 OR ch = 8 AND NOT keep) THEN 'unsupported_audio_channel_layout' END AS problem, CASE WHEN k % 3 > 0 AND keep AND ch > 2 THEN CAST(ch AS VARCHAR) ELSE '2' END AS och,
  down || CASE k % 4 WHEN 0 THEN 'loudnorm=I=' || CASE WHEN k % 3 = 1 THEN '-20.50:TP=-1.00:LRA=7.00' ELSE '-20.50:TP=-2.00:LRA=11.00' END || ':print_format=summary'
   WHEN 1 THEN CASE WHEN k % 3 = 1 THEN 'loudnorm=I=-23.00:TP=-1.00:LRA=7.00:print_format=summary' ELSE 'loudnorm=I=-24.00:TP=-2.00:LRA=11.00:print_format=summary' END
   WHEN 2 THEN 'loudnorm=I=-23.00:TP=-1.00:LRA=7.00:measured_I=-30.25:measured_TP=-5.00:measured_LRA=4.50:measured_thresh=-40.00:offset=0.75:linear=true:print_format=summary' ELSE '' END AS flt
  FROM (SELECT *, CASE WHEN keep THEN '' WHEN ch = 1 THEN 'pan=stereo|c0=c0|c1=c0' || CASE WHEN k % 4 = 3 THEN '' ELSE ',' END WHEN ch = 6 THEN 'pan=stereo|FL=0.4142*c0+0.2929*c2+0.2929*c4|FR=0.4142*c1+0.2929*c2+0.2929*c5' || CASE WHEN k % 4 = 3 THEN '' ELSE ',' END ELSE '' END AS down
   FROM (SELECT id, input_path, '/out/' || id || '.mp4' AS output, k, k % 3 AS p, CASE WHEN k % 3 = 2 THEN 'smpte170m' ELSE 'bt709' END AS color, k // 12 % 9 AS ch, k % 5 = 0 AS keep, CASE k % 7 WHEN 0 THEN 'pcm_s16le' WHEN 1 THEN 'libmp3lame' ELSE 'aac' END AS codec FROM (SELECT id, input_path, CAST(substr(id, 2) AS BIGINT) AS k FROM transcode_jobs))) WHERE ch IN (0, 1, 2, 3, 6, 8))"""


@registered("x17_arguments", ARGS, JOBS)
def arguments(jobs: DataFrame) -> DataFrame:
    """Jobs with settings, sound and measures of every kind, by their number."""
    k = F.col("k")
    enc = F.element_at(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("profile", "target_width", "target_height", "interlaced", "colorspace", "color_trc", "color_primaries", "profile_h264", "level_h264"), e))) for e in D.ENCODERS)), (k % 3 + 1).cast("int"))
    mode = F.when(k % 3 == 0, "legacy_v1_encode").when(k % 3 == 1, "ebu_r128").otherwise("atsc_a85")
    audio = F.struct(mode.alias("mode"), F.when(k % 7 == 0, "pcm_s16le").when(k % 7 == 1, "libmp3lame").otherwise("aac").alias("codec"), F.lit("192k").alias("bitrate"), (k % 5 == 0).alias("preserve"), F.when(k % 4 == 0, -20.5).alias("target_i"), F.lit(None).cast("double").alias("target_tp"), F.lit(None).cast("double").alias("target_lra"))
    figures = {"target_i": -23.0, "target_tp": -1.0, "target_lra": 7.0, "input_i": -30.25, "input_tp": -5.0, "input_lra": 4.5, "input_thresh": -40.0, "target_offset": 0.75}
    measured = F.when(k % 4 >= 2, F.struct((k % 4 == 3).alias("is_silent"), F.lit(True).alias("is_linear"), *(F.lit(v).alias(n) for n, v in figures.items())))
    settings = F.struct(F.lit("100M").alias("analyzeduration"), F.lit("50M").alias("probesize"), F.lit("medium").alias("preset"), F.when(k % 2 == 0, "film").otherwise("none").alias("tune"), (k % 3 + 17).alias("crf"), F.lit("15M").alias("maxrate"), F.lit("30M").alias("bufsize"), (k % 4 + 1).alias("threads"))
    rows = jobs.select("id", "input_path", F.concat(F.lit("/out/"), "id", F.lit(".mp4")).alias("output_path"), F.expr(N % "id").alias("k")).withColumn("channels", F.floor(k / 12) % 9)
    rows = rows.where(F.col("channels").isin(0, 1, 2, 3, 6, 8)).withColumns({"encoder": enc, "settings": settings, "audio": audio, "measured": measured})
    return C.encode_arguments(rows)


registered("x18_colors", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'colorspace' WHEN 2 THEN 'color_trc' WHEN 3 THEN 'color_primaries' END AS problem FROM events")(
    lambda spark, sf: (lambda k: table(spark, sf, "events").select("event_id", C.color_problem(F.struct(F.when(k == 1, "linear").otherwise("bt709").alias("colorspace"), F.when(k == 2, "film").otherwise("arib-std-b67").alias("color_trc"), F.when(k == 3, "linear").otherwise("jedec-p22").alias("color_primaries"))).alias("problem")))(F.col("event_id") % 4)
)
POLICIES = """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ebu_r128' ELSE 'legacy_v1_encode' END AS mode, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'aac' ELSE 'pcm_s16le' END ELSE 'aac' END AS codec, CASE WHEN event_id % 2 = 1 THEN 2 END AS made_channels, CASE WHEN event_id % 7 = 0 THEN 40 ELSE 80 END AS max_delta,
 CASE WHEN event_id % 5 = 0 THEN event_id % 10 = 0 ELSE event_id % 4 = 0 END AS clean, CASE WHEN event_id % 3 = 1 THEN 9 ELSE event_id % 6 END AS max_attempts, event_id % 11 <> 0 AS verify,
 list_filter([CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'audio_policy' END, CASE WHEN event_id % 5 = 0 AND (event_id % 10 = 0) <> (event_id % 4 = 0) THEN 'storage_policy' END], lambda x: x IS NOT NULL) AS conflicts FROM events"""


@registered("f23_policies", POLICIES)
def policies(spark: SparkSession, sf: str) -> DataFrame:
    """Configurations in which each policy is given or not."""
    k = F.col("event_id")
    given = lambda test, ddl, **fields: F.when(test, F.from_json(F.to_json(F.struct(*(v.alias(n) for n, v in fields.items()))), ddl))
    rows = table(spark, sf, "events").select(
        "event_id",
        F.struct(F.lit("aac").alias("audio_codec"), F.lit("192k").alias("audio_bitrate")).alias("encoding"),
        F.struct((k % 4 == 0).alias("clean_source_after_success"), (k % 6).alias("max_attempts"), F.lit(5).alias("retry_delay_ms"), F.lit(False).alias("auto_retry_on_start")).alias("ingestion"),
        given(k % 2 == 0, C.AUDIO, mode=F.lit("ebu_r128"), codec=F.when(k % 3 == 0, "aac").otherwise("pcm_s16le"), bitrate=F.lit("192k")).alias("audio_policy"),
        given(k % 7 == 0, C.VALIDATION, max_duration_delta_ms=F.lit(40)).alias("validation_policy"),
        given(k % 5 == 0, C.STORAGE, clean_source_after_success=k % 10 == 0).alias("storage_policy"),
        given(k % 3 == 1, C.RETRY, max_attempts=F.lit(9)).alias("retry_policy"),
        given(k % 11 == 0, C.TOOLS, verify_on_startup=F.lit(False)).alias("toolchain_policy"),
    )
    p = C.effective_policies(rows)
    return p.select("event_id", "audio_policy.mode", "audio_policy.codec", F.col("audio_policy.channels").alias("made_channels"), F.col("validation_policy.max_duration_delta_ms").alias("max_delta"), F.col("storage_policy.clean_source_after_success").alias("clean"), "retry_policy.max_attempts", F.col("toolchain_policy.verify_on_startup").alias("verify"), "conflicts")


FRAMES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'N/A' || chr(10) || ' ' || CAST(event_id AS STRING) || '.5 ' || chr(13) || chr(10) || '7.0' WHEN 1 THEN 'bad' || chr(10) || chr(10) WHEN 2 THEN '' ELSE '0.0406,' || chr(10) || CAST(event_id AS STRING) || '.25' END AS text FROM {events}"
registered("s18_first_keyframe", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id * 1000 + 500 WHEN 3 THEN event_id * 1000 + 250 ELSE 0 END AS ms FROM events")(lambda spark, sf: view(spark, sf, FRAMES).select("event_id", first_keyframe_ms(F.col("text")).alias("ms")))
registered("x27_threads", "SELECT event_id, each, each * greatest(c, 1) AS total FROM (SELECT event_id, event_id % 4 AS c, CASE WHEN event_id % 5 = 0 THEN CAST(3 AS BIGINT) WHEN event_id % 4 = 0 THEN n ELSE greatest(n // (event_id % 4), 1) END AS each FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 3 * 5 ELSE greatest((event_id % 17) // 2, 1) END AS n FROM events))")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", *(c.alias(n) for n, c in zip(("each", "total"), D.threads(F.when(F.col("event_id") % 5 == 0, 3).otherwise(0), F.col("event_id") % 3 * 5, F.col("event_id") % 17, F.col("event_id") % 4))))
)

# playout
HYDRATED = "CASE WHEN duration_ms > 0 AND (o = 0 OR o > duration_ms OR o <= trim_in_ms) THEN duration_ms ELSE o END"
RAW = "SELECT uuid, duration_ms, trim_in_ms, CASE fingerprint % 4 WHEN 0 THEN CAST(0 AS BIGINT) WHEN 1 THEN duration_ms + 5 WHEN 2 THEN trim_in_ms ELSE trim_out_ms END AS trim_out_ms, fps_num, CASE WHEN fingerprint % 6 = 0 THEN CAST(0 AS BIGINT) ELSE fps_den END AS fps_den FROM {media_assets}"
registered("x30_hydrated", f"SELECT uuid, duration_ms, trim_in_ms, {HYDRATED} AS trim_out_ms, CAST(CASE WHEN fps_den > 0 THEN fps_num ELSE 25 END AS BIGINT) AS fps_num, CAST(CASE WHEN fps_den > 0 THEN fps_den ELSE 1 END AS BIGINT) AS fps_den FROM (SELECT *, trim_out_ms AS o FROM ({duck(RAW)}))")(lambda spark, sf: D.hydrated(view(spark, sf, RAW)))
registered("x31_play", "SELECT event_id, 'PLAY 1-10 \"/v/' || CAST(event_id AS STRING) || '.mp4\" SEEK ' || CAST(event_id AS STRING) || ' LENGTH ' || CAST(event_id % 50 AS STRING) AS command, CASE WHEN event_id % 50 > 0 AND event_id % 7 > 0 THEN CAST(event_id % 50 * 40 AS BIGINT) END AS ms FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.play_command(1, 10, F.concat(F.lit("/v/"), F.col("event_id").cast("string"), F.lit(".mp4")), F.col("event_id"), F.col("event_id") % 50).alias("command"), D.expected_ms(F.col("event_id") % 50, F.lit(25), (F.col("event_id") % 7 > 0).cast("int")).alias("ms"))
)

# labels
registered("x23_progress_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS frame, CASE WHEN event_id % 2 = 0 THEN CAST(25.5 AS DOUBLE) END AS fps, CASE WHEN event_id % 2 = 0 THEN '12.5kbits/s' END AS bitrate, CASE WHEN event_id % 2 = 0 THEN '1.5x' END AS speed FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", *(c.alias(n) for n, c in D.progress_fields(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("frame=  "), F.col("event_id").cast("string"), F.lit(" fps= 25.5 q=1 bitrate=  12.5kbits/s speed=1.5x"))).otherwise("bitrate=N/A speed=N/A")).items()))
)
registered("x32_labels", """SELECT event_id, CASE WHEN ms = 0 THEN '—' WHEN ms < 60000 THEN printf('%.1fs', CAST(ms AS DOUBLE) / 1000 + CASE WHEN ms % 1000 = 250 THEN 0.001 ELSE 0 END) ELSE CAST(ms // 60000 AS STRING) || ':' || lpad(CAST(ms // 1000 % 60 AS STRING), 2, '0') END AS length,
 CASE WHEN ms * 50 >= 3600000 THEN CAST(ms * 50 // 3600000 AS STRING) || 'h ' || CAST(ms * 50 // 60000 % 60 AS STRING) || 'm' ELSE CAST(ms * 50 // 60000 AS STRING) || 'm ' || CAST(ms * 50 // 1000 % 60 AS STRING) || 's' END AS uptime,
 CASE WHEN event_id % 101 IN (0, 100) OR event_id % 3 = 0 OR rest <= 0 THEN '' WHEN rest < 60 THEN CAST(rest AS STRING) || 's left' ELSE CAST(rest // 60 AS STRING) || ':' || lpad(CAST(rest % 60 AS STRING), 2, '0') || ' left' END AS eta
 FROM (SELECT event_id, event_id % 1500 * 50 AS ms, event_id % 200 AS rest FROM events)""")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", D.duration_label(F.col("event_id") % 1500 * 50).alias("length"), D.uptime_label(F.col("event_id") % 1500 * 2500).alias("uptime"), D.eta_label(F.col("event_id") % 101, F.when(F.col("event_id") % 3 == 0, "0x").otherwise("2x"), F.col("event_id") % 200 * 2000 + 5000, F.lit(5000)).alias("eta"))
)
registered("x32_short_errors", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Unknown error' WHEN 1 THEN 'first' WHEN 2 THEN repeat('x', 220) ELSE repeat('x', 217) || '…' END AS short FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", D.short_error(F.when(F.col("event_id") % 4 == 1, " first \nsecond").when(F.col("event_id") % 4 == 2, F.repeat(F.lit("x"), 220)).when(F.col("event_id") % 4 == 3, F.repeat(F.lit("x"), 221))).alias("short"))
)
registered("f27_levels", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warn' WHEN 3 THEN 'success' ELSE 'info' END AS level FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", D.log_level(F.element_at(F.array(*map(F.lit, ("[ERROR] [WARN] x", "an error: Completed", "[WARN] Completed", "Completed 1", "completed"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("level")))
registered("o10_window", "SELECT CASE WHEN total = 0 THEN 0 ELSE 26 END::BIGINT AS first, least(50, total) AS last FROM (SELECT COUNT(*) AS total FROM media_assets)", ASSETS)(lambda a: (lambda t: t.select(*(c.alias(n) for n, c in zip(("first", "last"), D.window_label(F.col("total"), 25, 25)))))(a.agg(F.count("*").alias("total"))))
registered("f25_grid", "SELECT uuid FROM media_assets WHERE status = 'ready' AND (contains(lower(display_name), 'clip 3') OR contains(lower(current_path), 'clip 3'))", ASSETS)(lambda a: D.grid(a, "ready", "Clip 3").select("uuid"))
registered("f25_status_counts", "SELECT status, COUNT(*) AS n FROM media_assets GROUP BY status UNION ALL SELECT 'all', COUNT(*) FROM media_assets", ASSETS)(D.status_counts)
registered("f26_queue", "SELECT state, id FROM transcode_jobs WHERE state IN ('Processing', 'Failed')", JOBS)(lambda j: j.where(F.col("state").isin("Processing", "Failed")).select("state", "id"))
