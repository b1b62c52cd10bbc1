"""Storage figures from file metadata: names, sizes and times of files; contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.details import overview


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, changed of all files below root whose name fits the pattern."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def by_folder(listing: DataFrame, root: str) -> DataFrame:
    """folder (relative to root; '' is root itself), n_files, bytes, changed (the last change), for each folder and for all
    folders that hold it."""
    inside = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "/?[^/]*$", "")
    parts = F.split(inside, "/")
    above = F.transform(F.sequence(F.lit(0), F.when(inside == "", 0).otherwise(F.size(parts))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = listing.select(F.explode(above).alias("folder"), "size", "changed")
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.max("changed").alias("changed"))


def by_table(listing: DataFrame) -> DataFrame:
    """name, n_files, bytes, changed of tables: a file name.parquet, or a folder of that name with files in it."""
    name = F.regexp_extract("path", "/([^/]+)\\.parquet(?:/|$)", 1)
    return listing.select(name.alias("name"), "size", "changed").where("name <> ''").groupBy("name").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.max("changed").alias("changed"))


def overview_with_storage(assets: DataFrame, jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """The overview, and how many bytes and files hold it."""
    held = listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("storage_bytes"), F.count("*").alias("storage_files"))
    return overview(assets, jobs).join(held, F.lit(True))
