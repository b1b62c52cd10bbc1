"""Changes of a stream, persisted: a log of changes by batch, a base, and the table that both give.

Each batch writes its own folder of the log, over what an earlier try of that batch left, so a batch that is run again
changes nothing. The table takes of each id the change of the greatest seq, whatever the order in which changes came; the
time of creation stays that of the first one. compacted() writes base and log up to a batch as a new base; folders that
are being read are never written over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(changes: DataFrame, key: str = "id", seq: str = "seq", first: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Of each key its change of the greatest seq (of equal seqs the greater row, so copies of a change count once), but
    columns of first from the least seq. Combined before the shuffle; a key's changes are never gathered."""
    columns = [c for c in changes.columns if c != key]
    row, out = F.struct(seq, *(c for c in columns if c != seq)), changes.groupBy(key)
    aggregated = out.agg(F.max(row).alias("_new"), *(F.min(F.struct(seq, c)).alias(f"_first_{c}") for c in first if c in columns))
    return aggregated.select(key, *((F.col(f"_first_{c}.{c}") if c in first else F.col(f"_new.{c}")).alias(c) for c in columns))


def _folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the complete folders path/n=... (Spark marks them with _SUCCESS)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


class ChangeLog:
    """root/log/batch=N holds the changes of batch N, root/base/batch=N the table up to batch N."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "id", seq: str = "seq", first: tuple[str, ...] = ("created_at",)):
        self.spark, self.root, self.schema, self.key, self.seq, self.first = spark, root, schema, key, seq, first

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. Changes of one key within a batch are merged first."""

        def write(batch: DataFrame, number: int) -> None:
            self._once(batch).write.mode("overwrite").parquet(f"{self.root}/log/batch={number}")

        return write

    def _once(self, changes: DataFrame) -> DataFrame:
        """At most two changes of a key: the last, and the first where it differs from that."""
        last = merged(changes, self.key, self.seq, ())
        first = changes.groupBy(self.key).agg(F.min(F.struct(self.seq, *(c for c in changes.columns if c not in (self.key, self.seq)))).alias("r")).select(self.key, "r.*")
        return last.unionByName(first).distinct()

    def _changes(self, until: int | None) -> DataFrame:
        in_time = lambda n: until is None or n <= until
        bases = [n for n in _folders(self.spark, f"{self.root}/base") if in_time(n)]
        base = bases[-1] if bases else None
        paths = [f"{self.root}/log/batch={n}" for n in _folders(self.spark, f"{self.root}/log") if in_time(n) and (base is None or n > base)]
        if base is not None:
            paths.append(f"{self.root}/base/batch={base}")
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self, until: int | None = None) -> DataFrame:
        """The table after all batches, or after batch `until`; empty before the first."""
        return merged(self._changes(until), self.key, self.seq, self.first)

    def compacted(self) -> int | None:
        """Writes a new base up to the last batch and gives its number. It holds of each key the last change and the first,
        so that later batches, also such as bring older changes, merge with it as they would with the log."""
        done = _folders(self.spark, f"{self.root}/log")
        if not done or done[-1] in _folders(self.spark, f"{self.root}/base"):
            return done[-1] if done else None
        self._once(self._changes(done[-1])).write.mode("overwrite").parquet(f"{self.root}/base/batch={done[-1]}")
        return done[-1]
