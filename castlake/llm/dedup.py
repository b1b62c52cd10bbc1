"""Near-duplicate removal: one document of each component of the Jaccard join stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .partenum import class_of, rows_of, shingle_sets
from .shared import ready, stored
from .words import blocks


def _with_class(docs: DataFrame, name: str) -> DataFrame:
    """docs with the class of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [class_of(shingle_sets(data, offs)).view(np.int64) for _, _, data, offs in blocks(batch["text"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *cls]))], names=[*batch.schema.names, name])

    ready(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of their component; one row of each component.
    Where a doc_id occurs more than once, each row is judged by its own text: it goes if another row that stays is of its
    component (or, without a shingle, of its doc_id). Rows with a null doc_id stay."""
    found = rows_of(docs)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    few = gone.count() <= 500_000  # 8 bytes each; beyond that both sides are shuffled
    once = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(docs.columns)
    again = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return once
    name = "cls"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    stay = found.join(again, "doc_id", "left_semi").where("doc_id = component_id").groupBy("doc_id", "comp").agg(F.min("cls").alias(name)).select("doc_id", name)
    rows = _with_class(docs.join(again, "doc_id", "left_semi").select(docs.columns), name)
    rows = rows.join(stored(stay, "stay"), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return once.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(rows.select(docs.columns))
