"""Changes of media_assets as functions from one DataFrame to the next; the caller writes the result as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


def _set(assets: DataFrame, which: Column, values: dict[str, Column]) -> DataFrame:
    """values where which holds; all of them see the row as it was."""
    return assets.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in values.items()})


def set_fields(assets: DataFrame, which: Column, **values: object) -> DataFrame:
    """Fields of active assets (trims, rating, name, folder)."""
    return _set(assets, which & F.col("deleted_at").isNull(), {c: F.lit(v) for c, v in values.items()})


def added_processing(assets: DataFrame, rows: DataFrame) -> DataFrame:
    return assets.unionByName(rows.withColumn("status", F.lit("processing")), allowMissingColumns=True)


#: Fields of a published file, with how each comes from a result; a table without a field goes without it.
PUBLISHED = {
    "current_path": "path",
    "duration_ms": "duration_ms",
    "trim_out_ms": "duration_ms",
    "mezzanine_ok": "mezzanine_ok",
    "fps": "fps",
    "fps_num": "fps_num",
    "fps_den": "fps_den",
    "total_frames": "total_frames",
    "gop_frames": "gop_frames",
    "keyframe_safe_start_ms": "keyframe_safe_start_ms",
    "warnings": "warnings",
    "keyframe_offsets_json": "keyframe_offsets",
}
AS_JSON = ("warnings", "keyframe_offsets_json")


def ready(assets: DataFrame, results: DataFrame) -> DataFrame:
    """assets with what was published: results has uuid and the fields named in PUBLISHED (warnings and keyframe_offsets as
    arrays). The trims are reset to the whole."""
    r = results.select(F.col("uuid").alias("_u"), F.struct(*[c for c in results.columns if c != "uuid"]).alias("_r"))
    value = lambda c, of: F.to_json(F.col(f"_r.{of}")) if c in AS_JSON else F.col(f"_r.{of}").cast(assets.schema[c].dataType)
    new = {c: value(c, of) for c, of in PUBLISHED.items() if c in assets.columns}
    out = _set(assets.join(r, F.col("uuid") == F.col("_u"), "left"), F.col("_u").isNotNull(), {"status": F.lit("ready"), "trim_in_ms": F.lit(0).cast("long"), **new})
    return out.select(assets.columns)


def failed(assets: DataFrame, which: Column) -> DataFrame:
    return _set(assets, which, {"status": F.lit("error")})


def subclips(assets: DataFrame, requests: DataFrame) -> DataFrame:
    """assets and a subclip of each requested active parent; requests: parent, uuid, name, trim_in, trim_out, mezzanine_ok,
    warnings (JSON text). A subclip is in its parent's folder, never was elsewhere, and has its own checks and warnings; all
    else is its parent's."""
    r = requests.select(F.col("parent").alias("_parent"), F.struct("uuid", "name", "trim_in", "trim_out", "mezzanine_ok", "warnings").alias("_r"))
    out = F.when(F.col("_r.trim_out") <= 0, F.col("duration_ms")).otherwise(F.col("_r.trim_out"))
    new = {"uuid": F.col("_r.uuid"), "display_name": F.col("_r.name"), "trim_in_ms": F.col("_r.trim_in"), "trim_out_ms": out, "mezzanine_ok": F.col("_r.mezzanine_ok"), "warnings": F.col("_r.warnings"), "original_virtual_folder": F.lit(None)}
    copies = assets.where("deleted_at IS NULL").join(r, F.col("uuid") == F.col("_parent"))
    copies = copies.withColumns({c: v.cast(assets.schema[c].dataType) for c, v in new.items() if c in assets.columns})
    return assets.unionByName(copies.select(assets.columns))


def trashed(assets: DataFrame, which: Column, now: Column) -> DataFrame:
    return _set(assets, which & F.col("deleted_at").isNull(), {"deleted_at": now, "original_virtual_folder": F.coalesce("original_virtual_folder", "virtual_folder")})


def trashed_folder(assets: DataFrame, root: str, now: Column) -> DataFrame:
    return trashed(assets, R.in_folder(F.col("virtual_folder"), root), now)


def restored(assets: DataFrame, which: Column, target: str | None = None) -> DataFrame:
    """To target (to / if that is no folder), else to where it was (to / if that is not known)."""
    home = F.coalesce("original_virtual_folder", F.lit("/"))
    if target is not None:
        home = F.when(R.valid_folder(F.lit(target)), F.lit(target)).otherwise("/")
    return _set(assets, which & F.col("deleted_at").isNotNull(), {"virtual_folder": home, "deleted_at": F.lit(None).cast(assets.schema["deleted_at"].dataType), "original_virtual_folder": F.lit(None).cast("string")})


def restored_folder(assets: DataFrame, root: str, to_root: bool = False) -> DataFrame:
    return restored(assets, R.in_folder(F.col("original_virtual_folder"), root), "/" if to_root else None)


def purged(assets: DataFrame, which: Column) -> DataFrame:
    return assets.where(~F.coalesce(which, F.lit(False)))


def purge_report(assets: DataFrame, which: Column) -> DataFrame:
    """A row for each row that goes, and whether its file goes, too: only when no row is left that refers to it."""
    gone = assets.where(which)
    left = purged(assets, which).select("current_path").distinct().withColumn("_kept", F.lit(True))
    return gone.join(left, "current_path", "left").select("uuid", "current_path", F.col("_kept").isNull().alias("file_removed"))


def purge_outcome(assets: DataFrame, which: Column, files: DataFrame, watch: str | None = None, target: str | None = None) -> DataFrame:
    """What purging does to each row that goes: media_removed and sidecar_removed (files of files: path, that go with it),
    skipped_referenced and the warning of a file that stays. Files in flight and paths that must not be purged stay."""
    gone = assets.where(which).select("uuid", "current_path")
    refs = purged(assets, which).groupBy("current_path").agg(F.count("*").alias("_refs"))
    there = lambda name, path: files.select(F.col("path").alias(path)).distinct().withColumn(name, F.lit(True))
    rows = gone.join(refs, "current_path", "left").withColumns({"_refs": F.coalesce("_refs", F.lit(0)), "_side": R.sidecar_path(R.stripped(F.col("current_path")))})
    rows = rows.join(there("_media", "current_path"), "current_path", "left").join(there("_sidecar", "_side"), "_side", "left")
    problem = R.purge_path_error(F.col("current_path"), watch, target)
    free = (F.col("_refs") == 0) & (F.col("current_path") != "")
    goes = free & problem.isNull() & ~R.is_temp_name(F.col("current_path"))
    # The warnings.
    kept = F.format_string("Physical media retained because %d other reference(s) still point to it", F.col("_refs"))
    warning = F.when(F.col("_refs") > 0, kept).when(free & problem.isNotNull(), F.concat(F.lit("Physical file cleanup skipped: "), problem))
    return rows.select("uuid", "current_path", (goes & F.col("_media").isNotNull()).alias("media_removed"), (goes & F.col("_sidecar").isNotNull()).alias("sidecar_removed"), (F.col("_refs") > 0).alias("skipped_referenced"), warning.alias("warning"))


def purge_one(assets: DataFrame, uuid: str, files: DataFrame, watch: str | None = None, target: str | None = None) -> DataFrame:
    """The result of purging one asset, one row also where there is none. Nothing is deleted here, so no failure is known."""
    o = purge_outcome(assets, F.col("uuid") == uuid, files, watch, target)
    found = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    out = o.agg(
        F.lit("purge_asset").alias("operation"), F.count("*").alias("rows_deleted"), found("media_removed"), found("sidecar_removed"),
        F.collect_list(F.when(F.col("skipped_referenced"), F.col("current_path"))).alias("skipped_referenced_files"), F.array().cast("array<string>").alias("cleanup_failures"), F.collect_list("warning").alias("warnings"),
    )
    return out.withColumn("warnings", F.when(F.col("rows_deleted") == 0, F.array(F.lit("asset_not_found"))).otherwise(F.col("warnings")))


def in_either_folder(root: str) -> Column:
    """Trashed rows that come from the folder, or are in it; the root / holds all."""
    either = F.coalesce(R.in_folder(F.col("original_virtual_folder"), root), F.lit(False)) | F.coalesce(R.in_folder(F.col("virtual_folder"), root), F.lit(False))
    return F.col("deleted_at").isNotNull() & either


def purge_totals(report: DataFrame, operation: str) -> DataFrame:
    return report.agg(F.count("*").alias("rows_deleted"), F.coalesce(F.bool_or("file_removed"), F.lit(False)).alias("media_removed"), F.count_if(~F.col("file_removed")).alias("skipped_referenced")).withColumn("operation", F.lit(operation))


def expired(days: int, now: Column) -> Column:
    """Trashed for so many days; none for 0."""
    return F.lit(False) if days <= 0 else F.col("deleted_at") <= now - F.expr(f"INTERVAL {days} DAYS")


def recolored(colors: DataFrame, changes: DataFrame) -> DataFrame:
    new = changes.withColumnRenamed("color", "_new")
    return colors.join(new, "virtual_folder", "full_outer").select("virtual_folder", F.coalesce("_new", "color").alias("color"))


def recovery_outcome(errors: DataFrame, sources: DataFrame, listing: DataFrame) -> DataFrame:
    """Failed assets, and those of a lost run: purged when their source waits in the watch folder or their file is gone, else kept. sources:
    fingerprint of waiting files; listing: path of files that exist."""
    s = sources.select(F.col("fingerprint").alias("_f")).distinct()
    there = listing.select(F.col("path").alias("_path")).distinct()
    return errors.join(s, F.col("fingerprint") == F.col("_f"), "left").join(there, F.col("current_path") == F.col("_path"), "left").select(
        *errors.columns, F.when(F.col("_f").isNotNull(), "purged_source_waiting").when(F.col("_path").isNull(), "purged_missing").otherwise("kept").alias("outcome")
    )


def opened(assets: DataFrame) -> DataFrame:
    """At start: empty names from the path, and processing rows of a lost run set to error."""
    return assets.withColumns({"display_name": F.when(F.col("display_name") == "", R.stem(F.col("current_path"))).otherwise(F.col("display_name")), "status": F.when(F.col("status") == "processing", "error").otherwise(F.col("status"))})
