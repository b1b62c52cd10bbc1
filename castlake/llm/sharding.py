"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, crc32 of the text, size). A keyed Feistel network permutes the
smallest even-width binary domain that holds N; values that fall outside 0..N-1 walk on through the network until they
fall inside, which keeps the map a bijection of 0..N-1. Shard and slot are then arithmetic: position p goes to shard
p mod S, slot p div S, so counts differ by one at most, slots have no gaps, and either can be computed for any row
without looking at another (and inverted by running the rounds backwards).

Defined results: a null text has size 16 and the crc32 of the empty string; a null doc_id sorts first; rows that are
equal in all three keys are interchangeable and get distinct positions; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, stored

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply) of x under a round's key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(_mixed(np.array([seed * 0x10001 + i], dtype=np.uint64), 0x9E3779B97F4A7C15)[0]) for i in range(rounds)]


def permuted(rows: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """The place of each row number in the shuffle of 0..n-1."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = rows.astype(np.uint64)
    walking = np.arange(len(out))
    keys = round_keys(seed)
    with np.errstate(over="ignore"):
        while len(walking):
            left, right = out[walking] >> half, out[walking] & mask
            for key in keys:
                left, right = right, left ^ (_mixed(right, key) & mask)
            out[walking] = (left << half) | right
            walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def restored(places: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """The inverse of permuted()."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = places.astype(np.uint64)
    walking = np.arange(len(out))
    keys = round_keys(seed)[::-1]
    with np.errstate(over="ignore"):
        while len(walking):
            left, right = out[walking] >> half, out[walking] & mask
            for key in keys:
                left, right = right ^ (_mixed(left, key) & mask), left
            out[walking] = (left << half) | right
            walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with row numbers 0..N-1 in the order of keys, and N.

    One range shuffle; each partition counts its own rows, and the driver sees one count per partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_seq")).drop("_part", "_seq", "_start"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, row_number, place, shard, slot."""
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(base, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(), n, seed))

    return rows.withColumn("place", place("row_number")).withColumns({"shard": F.pmod("place", F.lit(shards)).cast("int"), "slot": F.floor(F.col("place") / F.lit(shards)).cast("long")})
