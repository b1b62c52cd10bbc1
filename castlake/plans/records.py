"""Registered queries of sidecar documents and storage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sidecars, storage
from .registry import ASSETS, JOBS, registered
from .relations import relation

MADE = "TIMESTAMP_NTZ '2024-01-02 03:04:05'"
PATH = "replace(replace(current_path, '/videos/', '/sidecars/'), '.mp4', '.uuid.json')"


def full(assets: DataFrame) -> DataFrame:
    """Assets with the fields that a published file has."""
    fps = F.col("fps_num").cast("double") / F.col("fps_den").cast("double")
    total = F.floor(F.col("duration_ms") / 40)
    return assets.where("deleted_at IS NULL").withColumns({
        "fps": fps,
        "total_frames": total,
        "gop_frames": F.col("fps_num") * 2,
        "keyframe_safe_start_ms": F.lit(0).cast("long"),
        "warnings": F.when(F.col("fingerprint") % 4 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")),
    })


CHECKED = f"""SELECT uuid, {PATH} AS path, uuid AS id, CAST(0 AS BIGINT) AS trim_in_ms, duration_ms AS trim_out_ms, CAST(fps_num AS DOUBLE) / fps_den AS fps, CASE WHEN fingerprint % 4 = 0 THEN ['w'] ELSE CAST([] AS VARCHAR[]) END AS warnings,
 '/in/' || uuid || '.mov' AS source_path, CAST(duration_ms AS DOUBLE) / 1000 AS output_secs, CASE WHEN k > 0 THEN CAST(k AS BIGINT) END AS n_findings, CASE WHEN k > 0 THEN k < 2 END AS passed, CASE WHEN k > 0 THEN CASE WHEN k = 2 THEN CAST(1 AS BIGINT) ELSE 0 END END AS blocking_errors,
 CASE WHEN k > 0 THEN 'm' END AS measured, CASE WHEN k = 2 THEN 'e' END AS expected, CASE WHEN k > 0 THEN mezzanine_ok END AS report_ok, CASE WHEN fingerprint % 2 = 0 THEN 'ab' || CAST(fingerprint AS VARCHAR) END AS sha256, CASE WHEN fingerprint % 5 = 0 THEN -23.5::DOUBLE END AS lufs
 FROM (SELECT *, fingerprint % 3 AS k FROM media_assets WHERE deleted_at IS NULL)"""


@registered("m27_checked_sidecars", CHECKED, ASSETS)
def checked_sidecars(assets: DataFrame) -> DataFrame:
    """Documents with none, one or two findings, with and without sums and loudness, written as text and read back."""
    a = full(assets).withColumn("k", F.col("fingerprint") % 3)
    secs = (F.col("duration_ms") / 1000.0).alias("duration_secs")
    finding = lambda severity, expected: F.struct(F.lit(severity).alias("severity"), F.lit("c").alias("code"), F.lit("text").alias("message"), F.lit("m").alias("measured"), F.lit(expected).cast("string").alias("expected"))
    findings = F.slice(F.array(finding("warning", None), finding("error", "e")), 1, F.col("k").cast("int"))
    report = F.struct("mezzanine_ok", "duration_ms", "fps", "fps_num", "fps_den", F.lit(48000).cast("long").alias("audio_sample_rate"), F.lit(2).cast("long").alias("audio_channels"), F.lit(True).alias("closed_gop"), F.lit(True).alias("faststart"), "warnings", findings.alias("findings"), sidecars.qc_report(findings).alias("qc_report"), F.lit(None).cast("string").alias("sha256"), F.lit(7).cast("long").alias("file_size_bytes"))
    numbers = [F.lit(x).cast("double") for x in (-23.5, -2.0, 5.0, -33.0, -23.0, -1.0)]
    video = [secs, F.col("total_frames").alias("frame_count"), F.lit(1920).cast("long").alias("width"), F.lit(1080).cast("long").alias("height")]
    rows = a.withColumns({
        "transcoded_at": F.lit("2024-01-02T03:04:05Z"),
        "profile_used": F.lit("A"),
        "original_source": F.struct(F.concat(F.lit("/in/"), "uuid", F.lit(".mov")).alias("path"), F.lit("h264").alias("codec"), *video, "fps", "fps_num", "fps_den", F.lit("tff").alias("field_order")),
        "output_media": F.struct(*video, F.lit("h264").alias("codec"), F.lit("aac").alias("audio_codec"), F.lit(48000).cast("long").alias("audio_sample_rate"), F.lit(2).cast("long").alias("audio_channels"), "fps_num", "fps_den"),
        "validation_report": F.when(F.col("k") > 0, report),
        "sha256": F.when(F.col("fingerprint") % 2 == 0, F.concat(F.lit("ab"), "fingerprint")),
        "loudness": F.when(F.col("fingerprint") % 5 == 0, F.struct(*numbers, F.lit("ebu_r128"), F.lit(True))),
    })
    d = sidecars.read_back(sidecars.documents(rows))
    last = F.try_element_at("findings", F.lit(-1))
    return d.select(
        "uuid", "path", "id", "trim_in_ms", "trim_out_ms", "fps", "warnings", F.col("original_source.path").alias("source_path"), F.col("output_media.duration_secs").alias("output_secs"), F.size("findings").cast("long").alias("n_findings"), F.col("qc_report.passed").alias("passed"),
        F.col("validation_report.qc_report.blocking_errors").alias("blocking_errors"), last["measured"].alias("measured"), last["expected"].alias("expected"), F.col("validation_report.mezzanine_ok").alias("report_ok"), "sha256", F.col("loudness.integrated_lufs").alias("lufs"),
    )


REBUILT = f"""SELECT uuid, {PATH} AS path, current_path AS document_path, regexp_extract(current_path, '[^/]*$') AS filename, trim_in_ms, trim_out_ms, mezzanine_ok, '2024-01-02 03:04:05' AS transcoded_at, 'rebuilt_from_db' AS profile_used, CAST(duration_ms AS DOUBLE) / 1000 AS secs, duration_ms // 40 AS frames,
 'aac' AS audio_codec, fps_num * 2 AS gop_frames, CASE WHEN fingerprint % 3 = 0 THEN fingerprint END AS file_size_bytes, false AS has_report FROM media_assets WHERE deleted_at IS NULL"""


@registered("m25_sidecars", REBUILT, ASSETS)
def sidecar_texts(assets: DataFrame) -> DataFrame:
    """Documents from the table alone, read back; a third of the files is there."""
    sizes = assets.where("fingerprint % 3 = 0").select(F.col("current_path").alias("path"), F.col("fingerprint").alias("size"))
    rows = sidecars.rebuilt(full(assets), sizes, F.expr(MADE))
    d = sidecars.read_back(sidecars.documents(rows, whole=False))
    return d.select("uuid", "path", "document_path", "filename", "trim_in_ms", "trim_out_ms", "mezzanine_ok", "transcoded_at", "profile_used", F.col("original_source.duration_secs").alias("secs"), F.col("output_media.frame_count").alias("frames"), F.col("output_media.audio_codec").alias("audio_codec"), "gop_frames", "file_size_bytes", F.col("validation_report").isNotNull().alias("has_report"))


# sizes of files are not in the tables, so these have no SQL; tests/test_records.py compares them with the file system
@registered("s15_storage")
def storage_figures(spark: SparkSession, sf: str) -> DataFrame:
    return storage.by_table(storage.files(spark, sf))


@registered("a01_overview_storage")
def overview_storage(spark: SparkSession, sf: str) -> DataFrame:
    return storage.overview_with_storage(relation(spark, sf, ASSETS), relation(spark, sf, JOBS), storage.files(spark, sf, "*.parquet"))
