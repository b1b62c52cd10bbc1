"""The registered queries over the media relations, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import assets as A
from ..operators import jobs as J
from ..operators import transitions as T
from ..streaming import state as S
from .relations import oracle, relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ASSETS, JOBS, COLORS = "media_assets", "transcode_jobs", "virtual_folder_colors"
NOW = "TIMESTAMP '1998-09-01 00:00:00'"


def registered(name: str, sql: str | None = None, *tables: str):
    """Registers a function of the relations (or of spark and sf_dir, where it names none) under a name."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf: f(*(relation(spark, sf, t) for t in tables))) if tables else f
        if sql:
            SQL[name] = oracle(sql)
        return f

    return keep


def now():
    return F.expr("TIMESTAMP_NTZ '1998-09-01 00:00:00'")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


COLS = "uuid, fingerprint, current_path, duration_ms, trim_in_ms, trim_out_ms, rating, status, display_name, virtual_folder, original_virtual_folder, mezzanine_ok, deleted_at"
CORE = COLS.split(", ")
SUB = "(trim_in_ms > 0 OR (trim_out_ms > 0 AND trim_out_ms < duration_ms))"
SUBNAME = f"({SUB} OR contains(lower(display_name), 'subclip') OR contains(lower(display_name), 'sub-clip'))"
JCOLS = "id, uuid, input_path, state, phase, error, created_at, attempt, max_attempts"
JCORE = JCOLS.split(", ")

# scans and lookups
registered("s04_find_active", f"SELECT {COLS} FROM media_assets WHERE uuid = 'a000000000036' AND deleted_at IS NULL", ASSETS)(lambda a: A.by_uuid(A.active(a), "a000000000036").select(CORE))
registered("s05_find_any", f"SELECT {COLS} FROM media_assets WHERE uuid = 'a000000000039'", ASSETS)(lambda a: A.by_uuid(a, "a000000000039").select(CORE))
registered("s06_find_trashed", f"SELECT {COLS} FROM media_assets WHERE uuid = 'a000000000039' AND deleted_at IS NOT NULL", ASSETS)(lambda a: A.by_uuid(A.trashed(a), "a000000000039").select(CORE))
registered("s07_find_by_fingerprint", f"SELECT {COLS} FROM media_assets WHERE fingerprint = 40 AND deleted_at IS NULL ORDER BY uuid LIMIT 1", ASSETS)(lambda a: A.by_fingerprint(a, 40).select(CORE))
registered("s08_active_ready", f"SELECT {COLS} FROM media_assets WHERE deleted_at IS NULL AND status = 'ready' ORDER BY uuid", ASSETS)(lambda a: A.by_status(a, "ready").select(CORE))
registered("s09_status_with_trashed", f"SELECT {COLS} FROM media_assets WHERE status = 'error' ORDER BY uuid", ASSETS)(lambda a: A.by_status(a, "error", True).select(CORE))
registered("s10_recycle_bin", f"SELECT {COLS} FROM media_assets WHERE deleted_at IS NOT NULL", ASSETS)(lambda a: A.recycle_bin(a).select(CORE))
registered("s11_jobs_oldest_first", f"SELECT {JCOLS} FROM transcode_jobs", JOBS)(lambda j: j.orderBy("created_at", "id").select(JCORE))
registered("s12_active_by_fingerprint", f"SELECT {JCOLS} FROM transcode_jobs WHERE fingerprint = 7 AND state IN ('Pending', 'Processing') ORDER BY id LIMIT 1", JOBS)(lambda j: j.where((F.col("fingerprint") == 7) & F.col("state").isin("Pending", "Processing")).orderBy("id").limit(1).select(JCORE))
registered("s12_active_by_request", f"SELECT {JCOLS} FROM transcode_jobs WHERE lpad(lower(hex(xor(fingerprint, attempt * 8192))), 16, '0') = '0000000000002007' AND state IN ('Pending', 'Processing') ORDER BY id LIMIT 1", JOBS)(
    lambda j: J.active_by_request(j.withColumn("request_hash", R.request_hash(F.col("fingerprint"), F.col("attempt"))), "0000000000002007").select(JCORE)
)
registered("s13_folder_colors", "SELECT virtual_folder, color FROM virtual_folder_colors", COLORS)(lambda c: c.select("virtual_folder", "color"))
registered(
    "s14_table_rows",
    "SELECT 'media_assets' AS name, COUNT(*) AS n_rows FROM media_assets UNION ALL SELECT 'transcode_jobs', COUNT(*) FROM transcode_jobs UNION ALL SELECT 'virtual_folder_colors', COUNT(*) FROM virtual_folder_colors",
    ASSETS, JOBS, COLORS,
)(lambda a, j, c: a.agg(F.lit(ASSETS).alias("name"), F.count("*").alias("n_rows")).unionAll(j.agg(F.lit(JOBS), F.count("*"))).unionAll(c.agg(F.lit(COLORS), F.count("*"))))

# pages, searches, summaries
registered(
    "v06_asset_page",
    f"WITH f AS (SELECT {COLS}, {SUBNAME} AS is_subclip, regexp_extract(current_path, '[^/]*$') AS display_path FROM media_assets WHERE deleted_at IS NULL AND {SUBNAME} AND (contains(lower(display_name), 'clip 1') OR contains(lower(current_path), 'clip 1')) ) SELECT *, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY coalesce(CAST(deleted_at AS STRING), '9999'), display_name, uuid LIMIT 40 OFFSET 20",
    ASSETS,
)(lambda a: A.viewer(a.select(CORE), "subclip", " Clip 1", 40, 20))
registered("v07_job_page", f"WITH f AS (SELECT {JCOLS}, regexp_extract(input_path, '[^/]*$') AS input_name FROM transcode_jobs WHERE state = 'Failed' AND contains(lower(error), 'probe')) SELECT *, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 100 OFFSET 5", JOBS)(lambda j: J.viewer(j.select(JCORE), "failed", "Probe", 500, 5))
for m, test in {"master": f"NOT {SUBNAME} AND deleted_at IS NULL", "subclip": f"{SUBNAME} AND deleted_at IS NULL", "trashed": "deleted_at IS NOT NULL", "all": "true"}.items():
    registered(f"f04_mode_{m}", f"SELECT uuid FROM media_assets WHERE {test}", ASSETS)(lambda a, m=m: a.where(A.mode(m)).select("uuid"))
registered("f05_search", "SELECT uuid, display_name FROM media_assets WHERE contains(lower(uuid), 'clip 12') OR contains(lower(display_name), 'clip 12') OR contains(lower(current_path), 'clip 12')", ASSETS)(lambda a: a.where(A.matches("  CLIP 12 ", "uuid", "display_name", "current_path")).select("uuid", "display_name"))
registered("f06_jobs_by_phase", f"SELECT {JCOLS} FROM transcode_jobs WHERE phase = 'encoding'", JOBS)(lambda j: J.by_state(j, "Encoding").select(JCORE))
registered("f08_summary", f"SELECT uuid, {SUBNAME} AS is_subclip, regexp_extract(current_path, '[^/]*$') AS display_path FROM media_assets", ASSETS)(lambda a: A.summary(a).select("uuid", "is_subclip", "display_path"))
registered("f01_subtree", "SELECT uuid, virtual_folder FROM media_assets WHERE virtual_folder = '/URGENT' OR starts_with(lower(virtual_folder), '/urgent/')", ASSETS)(lambda a: a.where(R.in_folder(F.col("virtual_folder"), "/URGENT/")).select("uuid", "virtual_folder"))
registered("f03_batch", "SELECT uuid, status FROM media_assets WHERE deleted_at IS NULL AND uuid IN ('a000000000036', 'a000000000002', 'a000000000007')", ASSETS)(lambda a: A.batch(a, ["a000000000036", "a000000000002", "a000000000007"]).select("uuid", "status"))

# roll-ups
registered(
    "a01_overview",
    f"SELECT *, greatest(total - subclips, 0) AS master FROM (SELECT COUNT(*) FILTER (deleted_at IS NULL) AS total, COUNT(*) FILTER (deleted_at IS NULL AND {SUB}) AS subclips, COUNT(deleted_at) AS trashed, COUNT(*) FILTER (deleted_at IS NULL AND status = 'ready') AS ready, COUNT(*) FILTER (deleted_at IS NULL AND status = 'processing') AS processing, COUNT(*) FILTER (deleted_at IS NULL AND status = 'error') AS error, COUNT(*) FILTER (deleted_at IS NULL AND mezzanine_ok) AS mezzanine_ok FROM media_assets)",
    ASSETS,
)(A.overview)
FOLDERS = "SELECT virtual_folder, coalesce(asset_count, 0) AS asset_count, coalesce(ready_count, 0) AS ready_count, coalesce(trashed_count, 0) AS trashed_count, color FROM (SELECT virtual_folder, COUNT(*) AS asset_count, COUNT(*) FILTER (deleted_at IS NULL AND status = 'ready') AS ready_count, COUNT(deleted_at) AS trashed_count FROM media_assets GROUP BY virtual_folder) FULL JOIN virtual_folder_colors USING (virtual_folder)"
registered("a02_folder_rollup", FOLDERS, ASSETS, COLORS)(A.folders)
registered("a03_references", "SELECT current_path, COUNT(*) AS refs FROM media_assets GROUP BY current_path", ASSETS)(A.references)
registered("a04_job_stats", "SELECT COUNT(*) FILTER (state = 'Pending') AS pending, COUNT(*) FILTER (state = 'Processing') AS active, COUNT(*) FILTER (state = 'Completed') AS completed, COUNT(*) FILTER (state = 'Failed') AS failed, COUNT(*) AS total FROM transcode_jobs", JOBS)(J.stats)
registered("a10_distinct_uuids", "SELECT COUNT(DISTINCT uuid) = COUNT(*) AS each_once FROM media_assets", ASSETS)(lambda a: a.agg((F.count_distinct("uuid") == F.count("*")).alias("each_once")))
registered("a12_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest")))

# joins
registered("j01_assets_with_color", "SELECT uuid, a.virtual_folder, color FROM media_assets a LEFT JOIN virtual_folder_colors c ON a.virtual_folder = c.virtual_folder", ASSETS, COLORS)(lambda a, c: a.join(c, "virtual_folder", "left").select("uuid", "virtual_folder", "color"))
registered("j02_color_only", "SELECT virtual_folder, color FROM virtual_folder_colors c WHERE NOT EXISTS (SELECT 1 FROM media_assets a WHERE a.virtual_folder = c.virtual_folder)", ASSETS, COLORS)(lambda a, c: c.join(a, "virtual_folder", "left_anti").select("virtual_folder", "color"))
registered("j03_unreferenced_paths", "SELECT DISTINCT current_path FROM media_assets WHERE deleted_at IS NOT NULL AND current_path NOT IN (SELECT current_path FROM media_assets WHERE deleted_at IS NULL)", ASSETS)(lambda a: A.trashed(a).select("current_path").distinct().join(A.active(a), "current_path", "left_anti"))
registered("j04_usable_duplicates", "SELECT id, fingerprint FROM transcode_jobs j WHERE EXISTS (SELECT 1 FROM media_assets a WHERE a.fingerprint = j.fingerprint AND a.status = 'ready' AND a.mezzanine_ok AND a.deleted_at IS NULL AND a.current_path <> '')", ASSETS, JOBS)(lambda a, j: j.join(A.active(a).where("status = 'ready' AND mezzanine_ok AND current_path <> ''"), "fingerprint", "left_semi").select("id", "fingerprint"))
registered("j05_busy_sources", "SELECT id, input_path FROM transcode_jobs j WHERE EXISTS (SELECT 1 FROM transcode_jobs o WHERE o.input_path = j.input_path AND o.id <> j.id AND o.state IN ('Pending', 'Processing'))", JOBS)(lambda j: J.busy_sources(j).select("id", "input_path"))
registered("j09_profiles", "SELECT p_partkey, CASE WHEN p_size * 40 > 900 AND p_brand LIKE '%1' THEN 'B' WHEN p_size * 40 > 900 THEN 'A' ELSE 'C' END AS profile FROM part")(lambda spark, sf: table(spark, sf, "part").select("p_partkey", R.profile(F.col("p_size") * 40, F.when(F.col("p_brand").endswith("1"), "tff").otherwise("progressive")).alias("profile")))
registered("j10_added_jobs", f"SELECT {JCOLS} FROM transcode_jobs", JOBS)(lambda j: J.added(j.where("state <> 'Failed'"), j).select(JCORE))
registered("j12_sidecar_exists", "SELECT uuid, fingerprint % 3 = 0 AS sidecar_exists FROM media_assets", ASSETS)(
    lambda a: a.withColumn("p", R.sidecar_path(F.col("current_path"))).join(a.where("fingerprint % 3 = 0").select(R.sidecar_path(F.col("current_path")).alias("p"), F.lit(True).alias("x")).distinct(), "p", "left").select("uuid", F.coalesce("x", F.lit(False)).alias("sidecar_exists"))
)
registered("u03_live_paths", "SELECT DISTINCT current_path FROM media_assets WHERE deleted_at IS NULL AND current_path IN (SELECT current_path FROM media_assets WHERE deleted_at IS NOT NULL)", ASSETS)(lambda a: A.active(a).select("current_path").distinct().join(A.trashed(a), "current_path", "left_semi"))
registered("o07_newest_jobs", f"SELECT {JCOLS} FROM transcode_jobs ORDER BY created_at DESC, id DESC LIMIT 500", JOBS)(lambda j: J.newest(j).select(JCORE))
registered("v03_pending_jobs", f"SELECT {JCOLS} FROM transcode_jobs WHERE state = 'Pending'", JOBS)(lambda j: J.pending(j).select(JCORE))

# transitions
IN_HIGH = "(virtual_folder = '/HIGH' OR starts_with(lower(virtual_folder), '/high/'))"
registered("m04_set_trim", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN CAST(500 AS BIGINT) ELSE trim_in_ms END AS trim_in_ms, CASE WHEN h THEN CAST(9000 AS BIGINT) ELSE trim_out_ms END AS trim_out_ms) FROM (SELECT {COLS}, fingerprint = 40 AND deleted_at IS NULL AS h FROM media_assets)", ASSETS)(lambda a: T.set_fields(a, F.col("fingerprint") == 40, trim_in_ms=500, trim_out_ms=9000).select(*(F.col(c).cast("long") if c.startswith("trim") else c for c in CORE)))
registered("m05_move", f"SELECT * REPLACE (CASE WHEN rating = 'K' AND deleted_at IS NULL THEN '/Kids' ELSE virtual_folder END AS virtual_folder) FROM (SELECT {COLS} FROM media_assets)", ASSETS)(lambda a: T.set_fields(a, F.col("rating") == "K", virtual_folder="/Kids").select(CORE))
FULL = "*, CAST(fps_num AS DOUBLE) / CAST(fps_den AS DOUBLE) AS fps, duration_ms // 40 AS total_frames, fps_num * 2 AS gop_frames, fingerprint AS keyframe_safe_start_ms, '[]' AS warnings, '[0]' AS keyframe_offsets_json"
HIT = {"status": "'ready'", "current_path": "'/target/videos/x.mp4'", "duration_ms": "5000", "trim_in_ms": "0", "trim_out_ms": "5000", "mezzanine_ok": "true", "fps": "50", "fps_num": "50", "fps_den": "1", "total_frames": "250", "gop_frames": "100", "keyframe_safe_start_ms": "40", "warnings": "'[\"w\"]'", "keyframe_offsets_json": "'[0,2000]'"}


def all_fields(a: DataFrame) -> DataFrame:
    """Assets with the fields of a published file."""
    long = lambda c: F.floor(c).cast("long")
    return a.select(*CORE, "fps_num", "fps_den").withColumns({"fps": F.col("fps_num").cast("double") / F.col("fps_den").cast("double"), "total_frames": long(F.col("duration_ms") / 40), "gop_frames": F.col("fps_num") * 2, "keyframe_safe_start_ms": F.col("fingerprint"), "warnings": F.lit("[]"), "keyframe_offsets_json": F.lit("[0]")})


@registered("m02_mark_ready", "SELECT * EXCLUDE (h) REPLACE (" + ", ".join(f"CASE WHEN h THEN {v} ELSE {c} END AS {c}" for c, v in HIT.items()) + f") FROM (SELECT {FULL}, status = 'processing' AND fingerprint % 10 = 0 AS h FROM (SELECT {COLS}, fps_num, fps_den FROM media_assets))", ASSETS)
def mark_ready(a: DataFrame) -> DataFrame:
    values = {"path": "/target/videos/x.mp4", "duration_ms": 5000, "mezzanine_ok": True, "fps": 50.0, "fps_num": 50, "fps_den": 1, "total_frames": 250, "gop_frames": 100, "keyframe_safe_start_ms": 40}
    done = a.where("status = 'processing' AND fingerprint % 10 = 0").select("uuid", *(F.lit(v).alias(c) for c, v in values.items()), F.array(F.lit("w")).alias("warnings"), F.array(F.lit(0), F.lit(2000)).alias("keyframe_offsets"))
    return T.ready(all_fields(a), done)


@registered("m06_subclips", f"WITH a AS (SELECT {FULL} FROM (SELECT {COLS}, fps_num, fps_den FROM media_assets)) SELECT * FROM a UNION ALL SELECT * REPLACE (uuid || '-s' AS uuid, 'Part of ' || display_name AS display_name, CAST(100 AS BIGINT) AS trim_in_ms, duration_ms AS trim_out_ms, fingerprint % 100 = 0 AS mezzanine_ok, '[\"t\"]' AS warnings, NULL AS original_virtual_folder) FROM a WHERE fingerprint % 50 = 0 AND deleted_at IS NULL", ASSETS)
def cut_subclips(a: DataFrame) -> DataFrame:
    asked = a.where("fingerprint % 50 = 0").select(F.col("uuid").alias("parent"), F.concat("uuid", F.lit("-s")).alias("uuid"), F.concat(F.lit("Part of "), "display_name").alias("name"), F.lit(100).cast("long").alias("trim_in"), F.lit(0).cast("long").alias("trim_out"), (F.col("fingerprint") % 100 == 0).alias("mezzanine_ok"), F.lit('["t"]').alias("warnings"))
    return T.subclips(all_fields(a), asked)


registered("m07_purge_fingerprint", f"SELECT {COLS} FROM media_assets WHERE fingerprint <> 40", ASSETS)(lambda a: T.purged(a, F.col("fingerprint") == 40).select(CORE))
registered("m08_recolor", "SELECT virtual_folder, CASE WHEN virtual_folder IN ('/Archive', '/New') THEN '#ffffff' ELSE color END AS color FROM (SELECT virtual_folder, color FROM virtual_folder_colors UNION ALL SELECT '/New', '')", COLORS)(lambda c: T.recolored(c, c.sparkSession.createDataFrame([("/Archive", "#ffffff"), ("/New", "#ffffff")], "virtual_folder string, color string")))
registered("m09_upsert_jobs", f"SELECT {JCOLS} FROM transcode_jobs WHERE state <> 'Failed' UNION ALL SELECT id, uuid, input_path, 'Pending', 'queued', NULL, created_at, attempt + 1, max_attempts FROM transcode_jobs WHERE state = 'Failed'", JOBS)(
    lambda j: J.upserted(j.select(JCORE), j.where("state = 'Failed'").select(JCORE).withColumns({"state": F.lit("Pending"), "phase": F.lit("queued"), "error": F.lit(None).cast("string"), "attempt": F.col("attempt") + 1, "created_at": F.lit(None).cast("timestamp_ntz")}))
)
TRASHED = f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN {NOW} ELSE deleted_at END AS deleted_at, CASE WHEN h THEN coalesce(original_virtual_folder, virtual_folder) ELSE original_virtual_folder END AS original_virtual_folder) FROM (SELECT {COLS}, %s AND deleted_at IS NULL AS h FROM media_assets)"
registered("m10_trash_one", TRASHED % "uuid = 'a000000000036'", ASSETS)(lambda a: T.trashed(a, F.col("uuid") == "a000000000036", now()).select(CORE))
registered("m11_trash_folder", TRASHED % IN_HIGH, ASSETS)(lambda a: T.trashed_folder(a, "/HIGH", now()).select(CORE))
registered("m13_restore_folder", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN original_virtual_folder ELSE virtual_folder END AS virtual_folder, CASE WHEN h THEN NULL ELSE original_virtual_folder END AS original_virtual_folder, CASE WHEN h THEN NULL ELSE deleted_at END AS deleted_at) FROM (SELECT {COLS}, deleted_at IS NOT NULL AND starts_with(lower(original_virtual_folder), '/high/') AS h FROM media_assets)", ASSETS)(lambda a: T.restored_folder(a, "/HIGH").select(CORE))
registered("m12_restore_to_root", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN '/' ELSE virtual_folder END AS virtual_folder, CASE WHEN h THEN NULL ELSE original_virtual_folder END AS original_virtual_folder, CASE WHEN h THEN NULL ELSE deleted_at END AS deleted_at) FROM (SELECT {COLS}, deleted_at IS NOT NULL AND rating = '8' AS h FROM media_assets)", ASSETS)(lambda a: T.restored(a, F.col("rating") == "8", "no/folder").select(CORE))
PURGE = "SELECT uuid, current_path, current_path NOT IN (SELECT current_path FROM media_assets WHERE NOT (%s)) AS file_removed FROM media_assets WHERE %s"
registered("m16_purge_bin", PURGE % (("deleted_at IS NOT NULL",) * 2), ASSETS)(lambda a: T.purge_report(a, F.col("deleted_at").isNotNull()))
OLD = f"(deleted_at IS NOT NULL AND deleted_at <= {NOW} - INTERVAL 14 DAY)"
registered("m17_retention", PURGE % (OLD, OLD), ASSETS)(lambda a: T.purge_report(a, F.coalesce(T.expired(14, now()), F.lit(False))))
registered("a06_purge_totals", "SELECT COUNT(*) AS rows_deleted, bool_or(file_removed) AS media_removed, COUNT(*) FILTER (NOT file_removed) AS skipped_referenced, 'empty_bin' AS operation FROM (" + PURGE % (("deleted_at IS NOT NULL",) * 2) + ")", ASSETS)(lambda a: T.purge_totals(T.purge_report(a, F.col("deleted_at").isNotNull()), "empty_bin"))
JLEASE = "id, state, phase, current_stage, error, error_category, worker_id, leased_until, heartbeat_at, started_at, finished_at, attempt"
LATE = "TIMESTAMP '1997-06-01 00:00:00'"
registered("m19_claim", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN 'Processing' ELSE state END AS state, CASE WHEN h THEN 'probing' ELSE phase END AS phase, CASE WHEN h THEN 'Claimed by worker' ELSE current_stage END AS current_stage, CASE WHEN h THEN 'w1' ELSE worker_id END AS worker_id, CASE WHEN h THEN {NOW} + INTERVAL 10 SECONDS ELSE leased_until END AS leased_until, CASE WHEN h THEN {NOW} ELSE heartbeat_at END AS heartbeat_at, CASE WHEN h THEN coalesce(started_at, {NOW}) ELSE started_at END AS started_at) FROM (SELECT {JLEASE}, id = (SELECT id FROM transcode_jobs WHERE state = 'Pending' AND phase = 'queued' OR state = 'Processing' AND leased_until IS NOT NULL AND leased_until < {NOW} ORDER BY created_at, id LIMIT 1) AS h FROM transcode_jobs)", JOBS)(
    lambda j: J.claimed(j, "w1", now(), 10).select(JLEASE.split(", "))
)
BEAT = "fingerprint % 2 = 0 AND worker_id IN ('w0', 'w1')"  # jobs of w0 get the beat of a worker that is not theirs
registered("m20_heartbeat", f"SELECT id, CASE WHEN h THEN {NOW} + INTERVAL 10 SECONDS ELSE leased_until END AS leased_until, CASE WHEN h THEN {NOW} ELSE heartbeat_at END AS heartbeat_at FROM (SELECT *, fingerprint % 2 = 0 AND coalesce(worker_id = 'w1', false) AND NOT cancel_requested AS h FROM transcode_jobs)", JOBS)(
    lambda j: J.heartbeats(j, j.where(BEAT).select("id", F.lit("w1").alias("worker_id")), now(), 10).select("id", "leased_until", "heartbeat_at")
)
registered("m20_cancel_flags", f"SELECT id, 'w1' AS worker_id, worker_id = 'w1' AND cancel_requested AS cancel_requested FROM transcode_jobs WHERE {BEAT}", JOBS)(lambda j: J.cancel_flags(j, j.where(BEAT).select("id", F.lit("w1").alias("worker_id"))))
registered("m21_cancel", "SELECT id, CASE WHEN h AND phase = 'queued' THEN 'Cancelled' ELSE state END AS state, CASE WHEN h AND phase = 'queued' THEN 'cancelled' WHEN h THEN 'cancel_requested' ELSE phase END AS phase FROM (SELECT *, fingerprint % 2 = 0 AND phase NOT IN ('completed', 'failed', 'cancelled') AS h FROM transcode_jobs)", JOBS)(lambda j: J.cancelled(j, F.col("fingerprint") % 2 == 0).select("id", "state", "phase"))
registered("m22_recover", f"SELECT id, CASE WHEN q THEN 'Pending' WHEN f THEN 'Failed' ELSE state END AS state, CASE WHEN q THEN 'queued' WHEN f THEN 'failed' ELSE phase END AS phase, CASE WHEN q THEN 'Re-queued (stale crash recovery)' WHEN f THEN 'Failed' ELSE current_stage END AS current_stage, CASE WHEN f THEN 'Worker crashed or lease expired (attempts exhausted)' ELSE error END AS error, CASE WHEN f THEN 'lease_expired' ELSE error_category END AS error_category, CASE WHEN NOT (q OR f) THEN worker_id END AS worker_id, CASE WHEN NOT (q OR f) THEN leased_until END AS leased_until, CASE WHEN NOT q THEN heartbeat_at END AS heartbeat_at, started_at, CASE WHEN f THEN {NOW} ELSE finished_at END AS finished_at, CASE WHEN q THEN attempt + 1 ELSE attempt END AS attempt FROM (SELECT *, state = 'Processing' AND attempt < max_attempts AS q, state = 'Processing' AND attempt >= max_attempts AS f FROM transcode_jobs)", JOBS)(lambda j: J.recovered(j, now()).select(JLEASE.split(", ")))
registered("m22_counts", "SELECT COUNT(*) FILTER (attempt < max_attempts) AS requeued, COUNT(*) FILTER (attempt >= max_attempts) AS failed_exhausted FROM transcode_jobs WHERE state = 'Processing'", JOBS)(J.recovery_counts)
registered("m23_recovery_sweep", "SELECT outcome, COUNT(*) AS n FROM (SELECT CASE WHEN fingerprint IN (SELECT fingerprint FROM transcode_jobs WHERE state = 'Pending') THEN 'purged_source_waiting' WHEN current_path NOT IN (SELECT current_path FROM media_assets WHERE status = 'ready') THEN 'purged_missing' ELSE 'kept' END AS outcome FROM media_assets WHERE status IN ('error', 'processing')) GROUP BY outcome", ASSETS, JOBS)(
    lambda a, j: T.recovery_outcome(a.where("status IN ('error', 'processing')"), j.where("state = 'Pending'"), a.where("status = 'ready'").select(F.col("current_path").alias("path"))).groupBy("outcome").agg(F.count("*").alias("n"))
)
registered("m24_open", "SELECT uuid, CASE WHEN status = 'processing' THEN 'error' ELSE status END AS status, 'c' || CAST(fingerprint AS STRING) AS display_name FROM media_assets", ASSETS)(lambda a: T.opened(a.withColumn("display_name", F.lit(""))).select("uuid", "status", "display_name"))

registered("m12_restore_home", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN coalesce(original_virtual_folder, '/') ELSE virtual_folder END AS virtual_folder, CASE WHEN h THEN NULL ELSE original_virtual_folder END AS original_virtual_folder, CASE WHEN h THEN NULL ELSE deleted_at END AS deleted_at) FROM (SELECT * REPLACE (CASE WHEN fingerprint % 2 = 0 THEN original_virtual_folder END AS original_virtual_folder), deleted_at IS NOT NULL AND rating = '8' AS h FROM (SELECT {COLS} FROM media_assets))", ASSETS)(
    lambda a: T.restored(a.withColumn("original_virtual_folder", F.when(F.col("fingerprint") % 2 == 0, F.col("original_virtual_folder"))), F.col("rating") == "8").select(CORE)
)
registered("m13_restore_all_to_root", f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN h THEN '/' ELSE virtual_folder END AS virtual_folder, CASE WHEN h THEN NULL ELSE original_virtual_folder END AS original_virtual_folder, CASE WHEN h THEN NULL ELSE deleted_at END AS deleted_at) FROM (SELECT {COLS}, deleted_at IS NOT NULL AS h FROM media_assets)", ASSETS)(lambda a: T.restored_folder(a, "/", to_root=True).select(CORE))
ONE = "(uuid = 'a000000000039')"
registered("m14_purge_one", PURGE % ((ONE,) * 2), ASSETS)(lambda a: T.purge_report(a, F.col("uuid") == "a000000000039"))
EITHER = f"(deleted_at IS NOT NULL AND (coalesce(original_virtual_folder = '/HIGH' OR starts_with(lower(original_virtual_folder), '/high/'), false) OR {IN_HIGH}))"
registered("m15_purge_folder", PURGE % ((EITHER,) * 2), ASSETS)(lambda a: T.purge_report(a, T.in_either_folder("/HIGH/")))
registered("m15_purge_folder_totals", "SELECT COUNT(*) AS rows_deleted, coalesce(bool_or(file_removed), false) AS media_removed, COUNT(*) FILTER (NOT file_removed) AS skipped_referenced, 'purge_folder' AS operation FROM (" + PURGE % ((EITHER,) * 2) + ")", ASSETS)(lambda a: T.purge_totals(T.purge_report(a, T.in_either_folder("/HIGH")), "purge_folder"))

# views of the jobs
registered("v01_job", f"SELECT {JCOLS} FROM transcode_jobs WHERE id = 'j000000000007'", JOBS)(lambda j: J.by_id(j, "j000000000007").select(JCORE))
registered("v02_recent_jobs", f"SELECT {JCOLS} FROM transcode_jobs ORDER BY created_at DESC, id", JOBS)(lambda j: J.recent(j).select(JCORE))
for v, name in {"v04_active": "Processing", "v05_completed": "Completed", "v05_failed": "Failed", "v05_cancelled": "Cancelled"}.items():
    registered(f"{v}_jobs", f"SELECT {JCOLS}, finished_at FROM transcode_jobs WHERE state = '{name}'", JOBS)(lambda j, name=name: J.in_state(j, name).select(*JCORE, "finished_at"))
registered("v07_all_jobs_of_output", f"WITH f AS (SELECT {JCOLS}, output_path, regexp_extract(input_path, '[^/]*$') AS input_name FROM transcode_jobs WHERE contains(lower(output_path), '/o1')) SELECT *, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 25", JOBS)(lambda j: J.viewer(j.select(*JCORE, "output_path"), "All", " /O1"))
registered("v06_behind_the_end", "SELECT NULL::VARCHAR AS uuid, (SELECT COUNT(*) FROM media_assets WHERE deleted_at IS NOT NULL) AS total", ASSETS)(lambda a: A.viewer(a, " Trashed ", "", 10, 10_000_000).select("uuid", "total"))
for m, test in {"READY": "status = 'ready' AND deleted_at IS NULL", "Processing": "status = 'processing' AND deleted_at IS NULL", "error": "status = 'error' AND deleted_at IS NULL"}.items():
    registered(f"f04_mode_{m.lower()}", f"SELECT uuid FROM media_assets WHERE {test}", ASSETS)(lambda a, m=m: a.where(A.mode(m)).select("uuid"))
registered("f10_valid_states", "SELECT id, CASE WHEN state = 'Failed' THEN 'Pending' ELSE state END AS state, CASE WHEN state = 'Failed' THEN 'queued' ELSE phase END AS phase FROM transcode_jobs", JOBS)(lambda j: J.valid_states(j.withColumns({"state": F.when(F.col("state") == "Failed", "broken").otherwise(F.col("state")), "phase": F.when(F.col("state") == "Failed", "no phase").otherwise(F.col("phase"))})).select("id", "state", "phase"))
registered("j06_batch_map", "SELECT list(uuid ORDER BY uuid) AS uuids FROM media_assets WHERE deleted_at IS NULL AND uuid IN ('a000000000036', 'a000000000002', 'a000000000007')", ASSETS)(lambda a: A.by_key(a, ["a000000000036", "a000000000002", "a000000000007"]).select(F.map_keys("assets").alias("uuids")))

# rules on grids of the driver's rows
registered("x01_snap", "SELECT event_id, CASE WHEN den <= 0 THEN 25 WHEN abs(f - 29.97) < 0.05 THEN 30000 WHEN abs(f - 23.976) < 0.05 THEN 24000 WHEN abs(f - 59.94) < 0.05 THEN 60000 WHEN abs(f - 25.0) < 0.05 THEN 25 WHEN abs(f - 50.0) < 0.05 THEN 50 WHEN abs(f - 30.0) < 0.05 THEN 30 WHEN abs(f - 60.0) < 0.05 THEN 60 WHEN abs(f - 24.0) < 0.05 THEN 24 ELSE num END AS fps_num, CASE WHEN den <= 0 THEN 1 WHEN abs(f - 29.97) < 0.05 OR abs(f - 23.976) < 0.05 OR abs(f - 59.94) < 0.05 THEN 1001 WHEN abs(f - 25.0) < 0.05 OR abs(f - 50.0) < 0.05 OR abs(f - 30.0) < 0.05 OR abs(f - 60.0) < 0.05 OR abs(f - 24.0) < 0.05 THEN 1 ELSE den END AS fps_den FROM (SELECT *, CAST(num AS DOUBLE) / CAST(nullif(den, 0) AS DOUBLE) AS f FROM (SELECT event_id, event_id % 6100 + 10 AS num, (event_id % 3) * 50 AS den FROM events))")(
    lambda spark, sf: (lambda d: d.select("event_id", *(c.alias(n) for c, n in zip(R.snapped(F.col("num"), F.col("den")), ("fps_num", "fps_den")))))(table(spark, sf, "events").select("event_id", (F.col("event_id") % 6100 + 10).alias("num"), (F.col("event_id") % 3 * 50).alias("den")))
)
registered("x08_gop", "SELECT uuid, CAST(round(CAST(fps_num AS DOUBLE) / CAST(fps_den AS DOUBLE) * 2) AS BIGINT) AS gop FROM media_assets", ASSETS)(lambda a: a.select("uuid", R.gop(F.col("fps_num"), F.col("fps_den")).alias("gop")))
registered("x10_request_hash", "SELECT uuid, lpad(lower(hex(xor(fingerprint, duration_ms * 8192))), 16, '0') AS request_hash FROM media_assets", ASSETS)(lambda a: a.select("uuid", R.request_hash(F.col("fingerprint"), F.col("duration_ms")).alias("request_hash")))
registered("x11_error_class", "SELECT id, CASE WHEN contains(lower(error), 'cancelled') OR contains(lower(error), 'canceled') OR contains(lower(error), 'stop') THEN 'Cancelled' WHEN contains(lower(error), 'os error 32') OR contains(lower(error), 'lock') OR contains(lower(error), 'busy') THEN 'Retryable' WHEN contains(lower(error), 'probe:') OR contains(lower(error), 'no such file') OR contains(lower(error), 'space') THEN 'Permanent' ELSE 'Retryable' END AS class FROM transcode_jobs WHERE error IS NOT NULL", JOBS)(lambda j: j.where("error IS NOT NULL").select("id", R.error_class(F.col("error"), F.lit(False)).alias("class")))
registered("x12_probe_match", "SELECT event_id, round(abs(value / 1000) * 1000) > greatest(round(1000.0 / 25.0) * 2, 40.0) AS mismatch FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", R.probe_mismatch(F.lit(0.0), F.col("value") / 1000, F.lit(25), F.lit(1)).alias("mismatch")))
registered("x13_qc", "SELECT event_id, list_filter([CASE WHEN value < 0.5 THEN 'zero_duration' END, CASE WHEN event_id % 2 = 1 THEN 'fps_mismatch' END, CASE WHEN event_id % 3 = 1 THEN 'audio_sample_rate_not_48k' END, CASE WHEN event_id % 5 = 0 THEN 'missing_faststart' END, CASE WHEN event_id % 7 = 0 THEN 'silent_audio_loudness_skipped' END], lambda x: x IS NOT NULL) AS codes, CAST(CASE WHEN value < 0.5 THEN 1 ELSE 0 END + event_id % 2 + CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS blocking_errors FROM events")(
    lambda spark, sf: table(spark, sf, "events")
    .select("event_id", R.qc_findings(F.when(F.col("value") < 0.5, 0.0).otherwise(F.col("value")), F.when(F.col("event_id") % 2 == 1, 50).otherwise(25), F.lit(1), F.lit(25), F.lit(1), F.when(F.col("event_id") % 3 == 1, 44100).otherwise(48000), F.lit(True), F.col("event_id") % 5 != 0, F.col("event_id") % 7 == 0, F.lit(False)).alias("f"))
    .select("event_id", F.transform("f", lambda x: x["code"]).alias("codes"), F.size(F.filter("f", lambda x: x["severity"] == "error")).cast("long").alias("blocking_errors"))
)
registered("x14_loudness", "SELECT event_id, i <= -70 AS is_silent, secs > 0 AND secs < 3 AS is_short, NOT (i <= -70) AND NOT (secs > 0 AND secs < 3) AND -3.0 + (-23.0 - i) <= -0.999 AND lra <= 10.501 AS is_linear FROM (SELECT event_id, -(value % 90.0) AS i, CAST(event_id % 8 AS DOUBLE) AS secs, CAST(event_id % 15 AS DOUBLE) AS lra FROM events)")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", (-(F.col("value") % 90.0)).alias("i"), (F.col("event_id") % 8).cast("double").alias("secs"), (F.col("event_id") % 15).cast("double").alias("lra"))
    .select("event_id", R.is_silent(F.col("i")).alias("is_silent"), R.is_short(F.col("secs")).alias("is_short"), R.is_linear(F.col("i"), F.lit(-3.0), F.col("lra"), F.col("secs"), F.lit(-23.0), F.lit(-1.0), F.lit(7.0)).alias("is_linear"))
)
registered("x16_downmix", f"SELECT event_id, CASE WHEN ch IN (0, 2) OR (ch IN (1, 6, 8) AND keep) THEN '' WHEN ch = 1 THEN '{R.MONO_PAN}' WHEN ch = 6 THEN '{R.SURROUND_PAN}' ELSE 'unsupported_audio_channel_layout' END AS filter FROM (SELECT event_id, event_id % 10 AS ch, event_id % 4 = 0 AS keep FROM events)")(lambda spark, sf: table(spark, sf, "events").select("event_id", R.downmix(F.col("event_id") % 10, F.col("event_id") % 4 == 0).alias("filter")))
registered("x19_sanitized", "SELECT page_id, lower(trim(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '_')) AS name FROM pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", R.sanitized(F.col("url")).alias("name")))
registered("x20_basename", "SELECT page_id, regexp_extract(url, '[^/\\\\]*$') AS name FROM pages")(lambda spark, sf: table(spark, sf, "pages").select("page_id", R.basename(F.col("url")).alias("name")))
registered("f13_temp_names", "SELECT event_id, event_id % 6 IN (1, 2, 3, 4) AS is_temp FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.is_temp_name(F.element_at(F.array(*map(F.lit, ["/in/a.mp4", "/in/.a.mp4", "/in/~a.mov", "/in/a.mp4.PART", "/in/a.uuid.json", "/in/part"])), (F.col("event_id") % 6 + 1).cast("int"))).alias("is_temp"))
)
registered("f14_extensions", "SELECT event_id, event_id % 4 IN (0, 1) AS allowed FROM events")(lambda spark, sf: table(spark, sf, "events").select("event_id", R.extension_allowed(F.element_at(F.array(*map(F.lit, ["/in/a.mp4", "/in/b.MOV", "/in/c.txt", "/in/d.avi"])), (F.col("event_id") % 4 + 1).cast("int")), exclude=["avi"]).alias("allowed")))
registered("f15_ratings", "SELECT uuid, regexp_replace(rating || '++', '\\++$', '') IN ('K', '8', '12', '16', '18') AS valid FROM media_assets", ASSETS)(lambda a: a.select("uuid", R.valid_rating(F.concat("rating", F.lit("++"))).alias("valid")))
registered("f16_folders", "SELECT uuid, uuid NOT LIKE '%7' AS valid FROM media_assets", ASSETS)(lambda a: a.select("uuid", R.valid_folder(F.when(F.col("uuid").endswith("7"), F.concat("virtual_folder", F.lit("/../x"))).otherwise(F.col("virtual_folder"))).alias("valid")))
registered("f18_trim_errors", "SELECT uuid, CASE WHEN duration_ms <= 0 THEN 'no_duration' WHEN CASE WHEN trim_out_ms <= 0 THEN duration_ms ELSE trim_out_ms END <= 60000 THEN 'trim_out_not_after_trim_in' WHEN trim_out_ms > duration_ms THEN 'trim_out_exceeds_duration' END AS problem FROM media_assets", ASSETS)(lambda a: a.select("uuid", R.trim_error(F.lit(60000), F.col("trim_out_ms"), F.col("duration_ms")).alias("problem")))
registered("f21_retention", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN -1 WHEN 2 THEN 21 ELSE -1 END::BIGINT AS days FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.retention_days(F.when(F.col("event_id") % 4 == 0, "1Week").when(F.col("event_id") % 4 == 1, "never"), F.when(F.col("event_id") % 4 == 2, 21).otherwise(5)).alias("days"))
)
registered("x29_frame_trim", "SELECT uuid, CASE WHEN ok THEN CAST(floor(b / 1000.0::DOUBLE * fps) AS BIGINT) END AS in_frame, CASE WHEN ok THEN CAST(least(ceil(e / 1000.0::DOUBLE * fps), round(duration_ms / 1000.0::DOUBLE * fps)) AS BIGINT) END AS out_frame FROM (SELECT *, e > b AS ok FROM (SELECT uuid, duration_ms, CAST(fps_num AS DOUBLE) / CAST(fps_den AS DOUBLE) AS fps, least(greatest(trim_in_ms, 0), duration_ms) AS b, CASE WHEN trim_out_ms <= 0 OR trim_out_ms > duration_ms THEN duration_ms ELSE trim_out_ms END AS e FROM media_assets))", ASSETS)(
    lambda a: a.select("uuid", *(c.alias(n) for n, c in R.frame_trim(F.col("trim_in_ms"), F.col("trim_out_ms"), F.col("duration_ms"), F.col("fps_num"), F.col("fps_den")).items() if n != "duration_frames"))
)
registered("x23_progress", "SELECT event_id, (event_id // 3600 % 24 * 3600 + event_id // 60 % 60 * 60 + event_id % 60) * 1000 + 250 AS ms FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.progress_ms(F.format_string("frame= 12 fps= 25 time=%02d:%02d:%02d.25 bitrate= 1kbits/s", F.floor(F.col("event_id") / 3600) % 24, F.floor(F.col("event_id") / 60) % 60, F.col("event_id") % 60)).alias("ms"))
)
registered("x28_json_strings", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN ['a', 'b'] ELSE [] END AS items FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.json_strings(F.element_at(F.array(*map(F.lit, ['["a","b"]', '["a",1]', "{}"])), (F.col("event_id") % 3 + 1).cast("int"))).alias("items"))
)
registered("w06_log_summary", "SELECT event_id, 'Error while opening ' || CAST(event_id AS STRING) AS summary FROM events")(
    lambda spark, sf: table(spark, sf, "events").select("event_id", R.log_summary(F.array(F.lit("first line"), F.concat(F.lit(" Error while opening "), F.col("event_id").cast("string")), F.lit("frame= 1 fps=2"), F.lit("short"), F.lit("Conversion failed!"), F.lit(""))).alias("summary"))
)

# window-like operators and state
USER_MS = "SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms FROM events"


def events_ms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type", "value")


registered("w01_gaps", f"SELECT user_id, at_ms, at_ms - lag(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS gap FROM ({USER_MS})")(
    lambda spark, sf: events_ms(spark, sf).select("user_id", "at_ms", (F.col("at_ms") - F.lag("at_ms").over(A.Window.partitionBy("user_id").orderBy("at_ms", "event_id"))).alias("gap"))
)
registered("w03_stable_runs", "SELECT user_id, event_type, run, COUNT(*) AS polls FROM (SELECT *, SUM(CASE WHEN event_type IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY ALL")(
    lambda spark, sf: (lambda w: events_ms(spark, sf).withColumn("new", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).cast("long")).withColumn("run", F.sum("new").over(w)).groupBy("user_id", "event_type", "run").agg(F.count("*").alias("polls")))(A.Window.partitionBy("user_id").orderBy("at_ms", "event_id"))
)
registered("w05_latest", f"SELECT {JCOLS} FROM transcode_jobs QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY created_at DESC, id DESC) = 1", JOBS)(lambda j: A.latest(j, "fingerprint", F.desc("created_at"), F.desc("id")).select(JCORE))
registered("j07_keyframe_near", f"SELECT a.event_id, bool_or(abs(b.at_ms - a.at_ms - 6000000) <= 400000.0) AS near FROM ({USER_MS}) a JOIN ({USER_MS}) b USING (user_id) GROUP BY a.event_id")(
    lambda spark, sf: (lambda e: A.near_marks(e.select("user_id", "event_id", (F.col("at_ms") + 6_000_000).alias("at_ms")), e.select("user_id", F.col("at_ms").alias("mark")), "user_id", "at_ms", "mark", 400_000).select("event_id", "near"))(events_ms(spark, sf))
)
registered("w02_faststart", "SELECT doc_id, doc_id % 3 = 0 AND n >= 12 AND n <= 65532 OR doc_id % 3 = 1 AND n >= 12 AS faststart FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)")(
    lambda spark, sf: table(spark, sf, "documents").select("doc_id", R.has_faststart(F.concat(F.when(F.col("doc_id") % 3 == 1, "moov").otherwise(""), F.col("text"), F.when(F.col("doc_id") % 3 == 0, "moov").otherwise("")).cast("binary")).alias("faststart"))
)
THROTTLED = f"WITH RECURSIVE t AS (SELECT user_id AS key, at_ms, CAST(percent AS DOUBLE) AS percent, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, percent) AS k FROM (SELECT user_id, at_ms, CAST(event_id % 101 AS DOUBLE) AS percent FROM ({USER_MS}))), r AS (SELECT key, at_ms, percent, k, at_ms AS last, true AS sent FROM t WHERE k = 1 UNION ALL SELECT t.key, t.at_ms, t.percent, t.k, CASE WHEN t.at_ms - r.last >= 60000000 OR t.percent >= 100 THEN t.at_ms ELSE r.last END, t.at_ms - r.last >= 60000000 OR t.percent >= 100 FROM t JOIN r ON t.key = r.key AND t.k = r.k + 1) SELECT key, at_ms, percent FROM r WHERE sent"
registered("t04_throttle", THROTTLED)(lambda spark, sf: S.throttled_batch(events_ms(spark, sf).select(F.col("user_id").alias("key"), "at_ms", (F.col("event_id") % 101).cast("double").alias("percent")), 60_000_000))


SETTLED = """WITH RECURSIVE t AS (SELECT '/in/' || CAST(user_id AS VARCHAR) AS path, CAST(event_id % 2 AS BIGINT) AS size, event_id AS now, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS polls, CAST(NULL AS BIGINT) AS sent_size, false AS sent FROM t
 UNION ALL SELECT path, tk, tsize, n, CASE WHEN go THEN tsize ELSE sent_size END, go FROM (SELECT *, n >= 2 AND now >= 5 AND sent_size IS DISTINCT FROM tsize AS go FROM (
  SELECT s.path, s.sent_size, t.k AS tk, t.size AS tsize, t.now, CASE WHEN t.size > s.size THEN 0 WHEN t.size = s.size THEN s.polls + 1 ELSE 1 END AS n FROM s JOIN t ON t.path = s.path AND t.k = s.k + 1)))
SELECT path, size, CAST(0 AS BIGINT) AS mtime, polls FROM s WHERE sent"""


@registered("t01_settled", SETTLED)
def settled(spark: SparkSession, sf: str) -> DataFrame:
    """Events taken as polls of a file per user."""
    e = table(spark, sf, "events")
    return S.settled_batch(e.select(F.concat(F.lit("/in/"), "user_id").alias("path"), (F.col("event_id") % 2).alias("size"), F.lit(0).cast("long").alias("mtime"), F.col("event_id").alias("now")))


from . import checks, records, streams  # noqa: E402,F401  (they register more queries)
