"""Folds over the rows of a key in their order: one definition, run over batch tables and over streams.

A batch is dealt by key and sorted; state goes from Arrow batch to Arrow batch, so a key of any length is never held whole.
A stream keeps the rows of a key until the watermark has passed them and folds them in their order then, so that rows which
arrive out of order (within the delay) give what they give in a batch. Streams need the RocksDB state store (STORE).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Fold:
    """step(state, row) gives the next state and rows to send. final(state), if given, is what is sent of a key at its end
    (of a stream: whenever rows were folded). A state has a deadline in ms, if deadline is given: when it passes without a
    row, rows of over(state) are sent and the state is dropped; step itself answers for rows that come behind it."""

    state: str
    output: str
    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, list[tuple]]]
    final: Callable[[tuple], list[tuple]] | None = None
    deadline: Callable[[tuple], int | None] | None = None
    over: Callable[[tuple], list[tuple]] = lambda state: []


def _ordered(row: tuple) -> tuple:
    return tuple((x is not None, x) for x in row)  # nulls come first, as in Spark


def folded(df: DataFrame, key: str, fold: Fold, columns: list[str], order: int = 1) -> DataFrame:
    """key and output of the fold over a table. columns: what a row holds, the first `order` of them its order."""
    schema = StructType([df.schema[key], *StructType.fromDDL(fold.output)])
    arrow = to_arrow_schema(schema)

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        values = list(zip(*rows)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, begun = None, fold.start, False
        for batch in batches:
            out: list[tuple] = []
            for k, *row in zip(*(batch[c].to_pylist() for c in range(batch.num_columns))):
                if not begun or k != held:
                    if begun and fold.final:
                        out += [(held, *x) for x in fold.final(state)]
                    held, state, begun = k, fold.start, True
                state, more = fold.step(state, tuple(row))
                if not fold.final:
                    out += [(k, *x) for x in more]
            yield sent(out)
        if begun and fold.final:
            yield sent([(held, *x) for x in fold.final(state)])

    return df.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns[:order]).mapInArrow(run, schema)


class _InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, rows: str, order: int):
        self.fold, self.key, self.rows, self.order = fold, key, rows, order
        self.names = [key, *StructType.fromDDL(fold.output).names]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", self.fold.state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            row = tuple(r)[2:]  # behind the key and the event time: ms and values
            self.waiting.appendValue(row)
            first = row[0] if first is None else min(first, row[0])
        if first is not None:
            self.handle.registerTimer(first + 1)  # rows of this time may come until the watermark is behind it
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r[1:] for r in rows if r[0] < now), key=lambda r: _ordered(r[: self.order]))
        rest = [r for r in rows if r[0] >= now]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) + 1)
        elif rows:
            self.waiting.clear()
        state = tuple(self.state.get()) if self.state.exists() else self.fold.start
        out: list[tuple] = []
        for row in due:
            state, more = self.fold.step(state, row)
            out += more
        if due and self.fold.final:
            out = self.fold.final(state)
        end = self.fold.deadline(state) if self.fold.deadline else None
        if end is not None and end < now:
            out = [*out, *self.fold.over(state)]
            self.state.clear()
        elif due:
            self.state.update(state)
            if end is not None:
                self.handle.registerTimer(end + 1)
        return iter([Row(**dict(zip(self.names, (key[0], *x)))) for x in out])

    def close(self) -> None:
        pass


def require_store(spark: SparkSession) -> None:
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"keyed streams need the session to set {STORE[0]} to {STORE[1]}")


def in_order(stream: DataFrame, key: str, fold: Fold, columns: list[str], at: str, delay: str, order: int = 1) -> DataFrame:
    """As folded(), over a stream; at: the event time of a row, delay: how late a row may come."""
    require_store(stream.sparkSession)
    timed: Column = F.unix_millis(F.col(at).cast("timestamp")).alias("_ms")
    rows = stream.withWatermark(at, delay).select(key, at, timed, *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])
    schema = StructType([rows.schema[key], *StructType.fromDDL(fold.output)])
    return rows.groupBy(key).transformWithState(_InOrder(fold, key, kept, order), schema, "append", "eventTime")

