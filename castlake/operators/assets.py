"""Reads over media_assets and its folders: lookups, ordered scans, viewer pages, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

PAGE, MOST = 25, 100


def active(assets: DataFrame) -> DataFrame:
    return assets.where("deleted_at IS NULL")


def trashed(assets: DataFrame) -> DataFrame:
    return assets.where("deleted_at IS NOT NULL")


def by_uuid(assets: DataFrame, uuid: str) -> DataFrame:
    return assets.where(F.col("uuid") == uuid)


def by_fingerprint(assets: DataFrame, value: int) -> DataFrame:
    """The first active asset of a fingerprint; first by uuid, so the choice is always the same."""
    return active(assets).where(F.col("fingerprint") == value).orderBy("uuid").limit(1)


def by_status(assets: DataFrame, status: str | None = None, with_trashed: bool = False) -> DataFrame:
    out = assets if with_trashed else active(assets)
    return (out.where(F.col("status") == status) if status else out).orderBy("uuid")


def recycle_bin(assets: DataFrame) -> DataFrame:
    return trashed(assets).orderBy(F.desc("deleted_at"), "uuid")


def batch(assets: DataFrame, uuids: list[str]) -> DataFrame:
    """At most 500 distinct uuids; more, or a repeated one, is an error."""
    if len(uuids) > 500 or len(set(uuids)) < len(uuids):
        raise ValueError("at most 500 uuids, each once")
    return active(assets).where(F.col("uuid").isin(uuids))


def by_key(assets: DataFrame, uuids: list[str]) -> DataFrame:
    """One row: a map from uuid to the asset, of the active ones of a batch (500 at most)."""
    found = batch(assets, uuids)
    return found.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("uuid").alias("key"), F.struct(*found.columns).alias("value"))))).alias("assets"))


MODES = {
    "master": lambda: ~R.is_subclip() & F.col("deleted_at").isNull(),
    "subclip": lambda: R.is_subclip() & F.col("deleted_at").isNull(),
    "ready": lambda: (F.col("status") == "ready") & F.col("deleted_at").isNull(),
    "processing": lambda: (F.col("status") == "processing") & F.col("deleted_at").isNull(),
    "error": lambda: (F.col("status") == "error") & F.col("deleted_at").isNull(),
    "trashed": lambda: F.col("deleted_at").isNotNull(),
}


def mode(name: str) -> Column:
    """The predicate of a filter mode, A-Z without case; an unknown one lets all through."""
    name = name.strip().translate(str.maketrans(R.UPPER, R.LOWER))
    return MODES[name]() if name in MODES else F.lit(True)


def matches(term: str, *columns: str) -> Column:
    """A term, trimmed, in any of the columns; A-Z without case."""
    term = term.strip().translate(str.maketrans(R.UPPER, R.LOWER))
    if not term:
        return F.lit(True)
    return R.any_of([F.coalesce(R.ascii_lower(F.col(c)).contains(term), F.lit(False)) for c in columns])


def page(df: DataFrame, order: list[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A page of df in that order, with the number of all rows beside each of its own; behind the end, one row of nulls
    with that number. limit: 1 to 100."""
    limit = min(max(PAGE if limit is None else limit, 1), MOST)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(max(offset or 0, 0)).limit(limit)
    return total.join(rows, F.lit(True), "left").select(*df.columns, "total")


def viewer(assets: DataFrame, filter_mode: str = "all", search: str = "", limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Trashed first, the oldest first; then by name."""
    rows = assets.where(mode(filter_mode)).where(matches(search, "uuid", "display_name", "current_path", "virtual_folder"))
    order = [F.asc_nulls_last("deleted_at"), F.asc("display_name"), F.asc("uuid")]
    return page(summary(rows), order, limit, offset)


def summary(assets: DataFrame) -> DataFrame:
    return assets.withColumns({"is_subclip": R.is_subclip(), "display_path": R.basename(F.col("current_path"))})


def full_summary(assets: DataFrame, files: DataFrame) -> DataFrame:
    """The whole summary: that above, warnings as an array, the number of keyframes, whether there is a sidecar (at its
    place, or beside the file), and a parent, which is not known. files: path of files that exist. Raw texts stay out."""
    from .details import json_longs

    own = F.when(F.col("current_path") != "", R.sidecar_path(F.col("current_path")))
    beside = F.when(F.col("current_path") != "", F.concat(F.regexp_replace("current_path", "\\.[^./]*$", ""), F.lit(".uuid.json")))
    there = files.select(F.col("path").alias("_path")).where(F.col("_path").endswith(".uuid.json")).distinct()
    kept = [c for c in assets.columns if c not in ("warnings", "keyframe_offsets_json")]
    rows = summary(assets).withColumns({"_own": own, "_beside": beside})
    rows = rows.join(there.withColumnRenamed("_path", "_own").withColumn("_a", F.lit(True)), "_own", "left").join(there.withColumnRenamed("_path", "_beside").withColumn("_b", F.lit(True)), "_beside", "left")
    return rows.select(
        *kept, "is_subclip", "display_path", R.json_strings(F.col("warnings")).alias("warnings"), F.size(json_longs(F.col("keyframe_offsets_json"))).cast("long").alias("keyframe_count"),
        F.lit(None).cast("string").alias("parent_uuid"), F.coalesce("_a", "_b", F.lit(False)).alias("sidecar_exists"),
    )


def overview(assets: DataFrame) -> DataFrame:
    """All counts in one scan."""
    live = F.col("deleted_at").isNull()
    counts = {
        "total": live,
        "subclips": live & R.by_trim(),
        "trashed": ~live,
        "ready": live & (F.col("status") == "ready"),
        "processing": live & (F.col("status") == "processing"),
        "error": live & (F.col("status") == "error"),
        "mezzanine_ok": live & F.col("mezzanine_ok"),
    }
    out = assets.agg(*(F.count_if(test).alias(name) for name, test in counts.items()))
    return out.withColumn("master", F.greatest(F.col("total") - F.col("subclips"), F.lit(0)))


def folders(assets: DataFrame, colors: DataFrame) -> DataFrame:
    """Counts of each folder with its colour; folders that only have a colour count 0. asset_count has trashed ones, too."""
    live = F.col("deleted_at").isNull()
    counts = assets.groupBy("virtual_folder").agg(
        F.count("*").alias("asset_count"),
        F.count_if(live & (F.col("status") == "ready")).alias("ready_count"),
        F.count_if(~live).alias("trashed_count"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("asset_count", "ready_count", "trashed_count")}
    return counts.join(colors, "virtual_folder", "full_outer").withColumns(zero).orderBy("virtual_folder")


def references(assets: DataFrame) -> DataFrame:
    return assets.groupBy("current_path").agg(F.count("*").alias("refs"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def near_marks(rows: DataFrame, marks: DataFrame, key: str, at: str, mark: str, within: int) -> DataFrame:
    """rows with near: whether a mark of the key lies within so many ms of it. A band join: both sides are cut into buckets
    of that width and a row meets those of its own bucket and the two beside it, so a key of any size is spread over many;
    each bucket keeps the least and the greatest of its marks, which are all that can decide."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(within + 1)).cast("long")
    ends = marks.groupBy(F.col(key).alias("_key"), bucket(mark).alias("_bucket")).agg(F.min(mark).alias("_least"), F.max(mark).alias("_most"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    wide = numbered.select("_row", F.col(key).alias("_key"), F.col(at).alias("_at"), F.explode(F.array(bucket(at) - 1, bucket(at), bucket(at) + 1)).alias("_bucket"))
    inside = wide.withColumn("_own", F.col("_bucket") == F.floor(F.col("_at") / F.lit(within + 1)))
    meets = F.col("_own") | (F.abs(F.col("_most") - F.col("_at")) <= within) | (F.abs(F.col("_least") - F.col("_at")) <= within)
    hits = inside.join(ends, ["_key", "_bucket"]).where(meets).select("_row").distinct().withColumn("near", F.lit(True))
    return numbered.join(hits, "_row", "left").select(*rows.columns, F.coalesce("near", F.lit(False)).alias("near"))
