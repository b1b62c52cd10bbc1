"""Sidecar documents of assets: one nested JSON text beside each file, written and read back under one schema.

A document has the asset's own fields, what was read of its source and of its output, and, where there are any, the
loudness and the report of the checks. Parts that are not there are left out of the text and are null when it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

RATE = "fps_num bigint, fps_den bigint"
FINDING = "struct<severity: string, code: string, message: string, measured: string, expected: string>"
QC = f"struct<passed: boolean, blocking_errors: bigint, warnings_count: bigint, findings: array<{FINDING}>>"
SOURCE = "struct<path: string, codec: string, duration_secs: double, frame_count: bigint, width: bigint, height: bigint, fps: double, fps_num: bigint, fps_den: bigint, field_order: string>"
OUTPUT = "struct<duration_secs: double, frame_count: bigint, width: bigint, height: bigint, codec: string, audio_codec: string, audio_sample_rate: bigint, audio_channels: bigint, fps_num: bigint, fps_den: bigint>"
LOUDNESS = "struct<integrated_lufs: double, true_peak_dbtp: double, lra: double, threshold: double, target_lufs: double, target_true_peak_dbtp: double, normalization_mode: string, linear_applied: boolean>"
REPORT = f"struct<mezzanine_ok: boolean, duration_ms: bigint, fps: double, fps_num: bigint, fps_den: bigint, audio_sample_rate: bigint, audio_channels: bigint, closed_gop: boolean, faststart: boolean, warnings: array<string>, findings: array<{FINDING}>, qc_report: {QC}, sha256: string, file_size_bytes: bigint>"
#: Name and type of each field, in the order of the text; the first one has the name that the reader of the files asks for.
FIELDS = {
    "external_id": "string", "id": "string", "path": "string", "duration_ms": "bigint", "trim_in_ms": "bigint", "trim_out_ms": "bigint", "fps_num": "bigint", "fps_den": "bigint", "mezzanine_ok": "boolean",
    "filename": "string", "filepath": "string", "transcoded_at": "string", "profile_used": "string", "original_source": SOURCE, "output_media": OUTPUT, "fps": "double", "total_frames": "bigint", "gop_frames": "bigint",
    "keyframe_safe_start_ms": "bigint", "warnings": "array<string>", "findings": f"array<{FINDING}>", "qc_report": QC, "loudness": LOUDNESS, "sha256": "string", "file_size_bytes": "bigint", "validation_report": REPORT,
}


def schema(external: str = "external_id") -> str:
    return "struct<" + ", ".join(f"{external if n == 'external_id' else n}: {t}" for n, t in FIELDS.items()) + ">"


def qc_report(findings: Column) -> Column:
    """What the findings say as a whole: errors block, all else warns."""
    count = lambda s: F.size(F.filter(findings, lambda f: f["severity"] == s)).cast("long")
    return F.struct((count("error") == 0).alias("passed"), count("error").alias("blocking_errors"), count("warning").alias("warnings_count"), findings.alias("findings"))


def documents(assets: DataFrame, external: str = "external_id", whole: bool = True) -> DataFrame:
    """uuid, path of the sidecar, and its text. assets: uuid, current_path, duration_ms, fps, fps_num, fps_den, mezzanine_ok,
    transcoded_at, profile_used, total_frames, gop_frames, keyframe_safe_start_ms, warnings, original_source, output_media
    (structs), and where there are any loudness, validation_report (structs), sha256, file_size_bytes. A report gives its
    findings to the document; sums and sizes of the file stand beside it. The trims are the whole file, as of one that was
    just made, or (whole false) those of the asset."""
    there = set(assets.columns)
    part = lambda name: (F.col(name) if name in there else F.lit(None)).cast(FIELDS[name])
    report = part("validation_report")
    special = {
        "external_id": F.col("uuid"),
        "id": F.col("uuid"),
        "path": F.col("current_path"),
        "filepath": F.col("current_path"),
        "filename": R.basename(F.col("current_path")),
        **({"trim_in_ms": F.lit(0), "trim_out_ms": F.col("duration_ms")} if whole else {}),
        "findings": report["findings"],
        "qc_report": report["qc_report"],
    }
    values = [(special[n].cast(t) if n in special else part(n)).alias(external if n == "external_id" else n) for n, t in FIELDS.items()]
    return assets.select("uuid", R.sidecar_path(F.col("current_path")).alias("path"), F.to_json(F.struct(*values), {"ignoreNullFields": "true"}).alias("document"))


def read_back(texts: DataFrame, external: str = "external_id") -> DataFrame:
    """texts with the fields of the document; all null where it is none."""
    parsed = texts.withColumn("_d", F.from_json("document", schema(external)))
    return parsed.select(*texts.columns, *(F.col(f"_d.{external if n == 'external_id' else n}").alias(n if n not in texts.columns else f"document_{n}") for n in FIELDS))


def rebuilt(assets: DataFrame, sizes: DataFrame, now: Column) -> DataFrame:
    """Rows for documents() from the table alone, where the files' own figures are lost. sizes: path, size of files that
    are there. Assets without a path are left out; trims stay as they are in the table."""
    s = sizes.select(F.col("path").alias("current_path"), F.col("size").alias("file_size_bytes")).dropDuplicates(["current_path"])
    secs = (F.col("duration_ms") / 1000.0).alias("duration_secs")
    video = [secs, F.col("total_frames").alias("frame_count"), F.lit(1920).cast("long").alias("width"), F.lit(1080).cast("long").alias("height")]
    rows = assets.where("current_path <> ''").join(s, "current_path", "left")
    return rows.select(
        *assets.columns,
        "file_size_bytes",
        now.cast("string").alias("transcoded_at"),
        F.lit("rebuilt_from_db").alias("profile_used"),
        F.struct(F.col("current_path").alias("path"), F.lit("h264").alias("codec"), *video, "fps", "fps_num", "fps_den", F.lit("progressive").alias("field_order")).alias("original_source"),
        F.struct(*video, F.lit("h264").alias("codec"), F.lit("aac").alias("audio_codec"), F.lit(48000).cast("long").alias("audio_sample_rate"), F.lit(2).cast("long").alias("audio_channels"), "fps_num", "fps_den").alias("output_media"),
    )


def write(documents: DataFrame, root: str) -> None:
    """The documents as a table of text below root, a new folder; a sidecar's own file name is its column path."""
    documents.write.mode("errorifexists").parquet(root)
