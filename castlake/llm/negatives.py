"""Hard negatives for contrastive training, searched by a pivot table.

Scores are inner products. Every vector x gets one more component sqrt(M2 - |x|^2), M2 the greatest squared length of
all, and an anchor q gets 0; then |q - x|^2 = |q|^2 + M2 - 2 q.x, so the inner product becomes a Euclidean distance. The
table stores each row's distances to a few pivots. By the triangle inequality each pivot brackets the distance of anchor
and row, and with it the score:

    (|q|^2 + M2 - min (d(q,p) + d(x,p))^2) / 2  <=  q.x  <=  (|q|^2 + M2 - max (d(q,p) - d(x,p))^2) / 2

Rows lie in blocks by their nearest pivot and the distance to it; a block's least and greatest distances to the pivots
bracket all its rows at once. Only rows whose bracket reaches what an anchor still asks for get their exact score. Two
passes for each group of anchors: the positives, then for all positives of an anchor the different-label rows in the
band that they set. What is asked for starts from the exact scores of a bounded sample of rows and narrows as rows are
found; the sample only saves work, every row is indexed and the result is exact (recall 1).

Bounds: SAMPLE rows (least hash of vec_id) give the pivots and the first thresholds. Anchors are broadcast in groups of
about GROUP (checked), one scan of the packed table each; workers hold one block of rows and at most POSITIVES candidates
of each anchor of the group. Nothing else passes the driver. Vectors that are spread evenly over many dimensions have
nearly equal distances to every pivot, so their brackets are wide and most rows are checked exactly; copies and clusters
are passed over. The work grows with anchors times rows at worst, the memory of a task does not.

Defined results: rows with a null vec_id, label or vector, or with any null or non-finite component take no part; an
empty vector has score 0 with all; of vectors of different lengths the shorter is taken as if zeros followed; a row of a
repeated vec_id is a row of its own (an anchor's copy may be its positive), and rows equal in score and vec_id are
interchangeable in the result; an empty table or one without anchors gives an empty result; further columns are ignored,
whatever their names. Scaled components of 2^31 or more and squared lengths of 2^53 or more are an error, as scores would
not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import ready, scratch, stored

PIVOTS = 12
SAMPLE = 2048
GROUP = 16_384
BLOCK = 1024
ANCHORS = 256  # anchors that are compared with a block at once
BLOCKS = "n int, vec_ids binary, labels binary, rows binary, vectors binary, distances binary"
ROWS = "row long, vec_id long, label long, v binary"
FOUND = "anchor long, slot int, score long, vec_id long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Table:
    """What the workers need of the pivot table: the pivots and the sample with their last component, and M2."""

    dim: int
    most: float
    sample: np.ndarray
    sample_ids: np.ndarray
    sample_labels: np.ndarray
    sample_rows: np.ndarray
    pivots: np.ndarray
    slack: float = field(init=False)

    def __post_init__(self) -> None:
        self.slack = 1e-9 * self.most + 1e-6  # of rounding in distances; brackets are widened by it

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(0.0, self.most - (v * v).sum(1)))[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of lifted vectors to the pivots: one row for each pivot."""
        square = (self.pivots * self.pivots).sum(1)[:, None] + (x * x).sum(1) - 2 * (self.pivots @ x.T)
        return np.sqrt(np.maximum(0.0, square))


def _vectors(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(raw), dim))
    for k, b in enumerate(raw):
        v = np.frombuffer(b, np.int32)
        out[k, : len(v)] = v
    return out


def scaled(rows: DataFrame, scale: float, vector: str = "embedding") -> DataFrame:
    """vec_id, label and v, the whole numbers floor(scale * component), of the rows that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above all
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _measured(rows: DataFrame) -> tuple[int, int, float]:
    """Rows, components and greatest squared length."""
    double = F.transform("v", lambda x: x.cast("double"))
    length = F.aggregate(double, F.lit(0.0), lambda s, x: s + x * x)
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top"), F.max(length).alias("most")).first()
    if (r.top or 0) >= 2**31 or (r.most or 0) >= 2**53:
        raise ValueError("scaled components must be below 2^31 and squared lengths below 2^53")
    return r.n, r.dim or 0, float(r.most or 0)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for k in range(batch.num_rows):
        n = batch["n"][k].as_py()
        get = lambda c, t: np.frombuffer(batch[c][k].as_buffer(), t)  # noqa: E731, B023
        yield get("vec_ids", np.int64), get("labels", np.int64), get("rows", np.int64), (v := get("vectors", np.int32)).reshape(n, len(v) // n), get("distances", np.float64).reshape(-1, n)


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Places of n rows of x, each the farthest from those before it; fewer if x has fewer different rows."""
    at, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < n and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return np.array(at)


def indexed(rows: DataFrame, under: str) -> tuple[DataFrame, Table]:
    """The pivot table of rows (vec_id, label, v): packed blocks of rows with their distances to the pivots."""
    spark = ready(rows.sparkSession)
    n, dim, most = _measured(rows)
    binary = F.col("v").cast("array<int>").alias("v")
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", binary), "numbered", under)
    some = numbered.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(SAMPLE).toArrow()
    sample = np.zeros((some.num_rows, dim))
    for k, v in enumerate(some["v"]):
        sample[k, : len(v)] = v.values.to_numpy()
    table = Table(dim, most, sample, some["vec_id"].to_numpy(), some["label"].to_numpy(), some["row"].to_numpy(), np.zeros((0, dim + 1)))
    if n:
        lifted = table.lifted(sample)
        table.pivots = lifted[_far_apart(lifted, PIVOTS)]

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        v = batch["v"]
        out = np.zeros((batch.num_rows, dim))
        size = np.diff(v.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = v.flatten().to_numpy()
        return out

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = table.distances(table.lifted(matrix(batch)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(0).astype(np.int32)), pa.array(d.min(0))], names=[*batch.schema.names, "nearest", "away"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                v = matrix(part)
                out = [part.num_rows, *(part[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label", "row")), v.astype(np.int32).tobytes(), table.distances(table.lifted(v)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([out[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in out[1:])], names=["n", "vec_ids", "labels", "rows", "vectors", "distances"])

    parts = max(spark.sparkContext.defaultParallelism, n // (8 * BLOCK), 1)
    by = numbered.mapInArrow(placed, numbered.schema.simpleString()[7:-1] + ", nearest int, away double")
    by = by.repartitionByRange(parts, "nearest", "away", "row").sortWithinPartitions("nearest", "away", "row")
    return stored(by.mapInArrow(packed, BLOCKS), "blocks", under), table


def _rows_where(blocks: DataFrame, modulus: int) -> DataFrame:
    """The rows of the table whose vec_id is divisible by modulus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, rows, v, _ in _unpacked(batch):
                at = np.flatnonzero(ids % modulus == 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[at], ids[at], labels[at])] + [pa.array([v[k].tobytes() for k in at], pa.binary())], names=["row", "vec_id", "label", "v"])

    return blocks.mapInArrow(run, ROWS)


class Search:
    """The wishes of a group of anchors and what was found for them. A wish is a range of scores low..high of an anchor
    and the number of rows wanted, the best first; kind: of the same label, or of others."""

    def __init__(self, table: Table, anchors: pa.Table, same: bool, want: int, lows: np.ndarray, highs: np.ndarray):
        by = np.lexsort((anchors["row"].to_numpy(), anchors["label"].to_numpy()))
        self.table, self.same, self.want = table, same, want
        self.rows, self.labels = anchors["row"].to_numpy()[by], anchors["label"].to_numpy()[by]
        self.q = _vectors([anchors["v"][int(k)].as_py() for k in by], table.dim)
        self.square = (self.q * self.q).sum(1)
        self.d = table.distances(np.concatenate([self.q, np.zeros((len(by), 1))], axis=1))
        self.low, self.high = lows[by].copy(), highs[by].copy()  # (anchor, wish); low > high: no wish
        self.slots = lows.shape[1]
        self.found: list[list[np.ndarray]] = []
        self.size = 0
        for i in range(0, len(by), ANCHORS):
            self._checked(slice(i, i + ANCHORS), table.sample, table.sample_ids, table.sample_labels, table.sample_rows, None)
        self._settle()
        self.found, self.size = [], 0  # the sample's rows come again with the table

    def _checked(self, a: slice, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, alive: np.ndarray | None) -> None:
        """Exact scores of anchors a with x; those that meet a wish are kept. alive: the pairs that the brackets left."""
        score = self.q[a] @ x.T
        fits = (self.labels[a][:, None] == labels) == self.same
        fits &= self.rows[a][:, None] != rows
        if alive is not None:
            fits &= alive
        fits &= score >= self.low[a].min(1)[:, None]
        i, j = np.nonzero(fits)
        s, anchor = score[i, j].astype(np.int64), i + a.start
        for slot in range(self.slots):
            k = np.flatnonzero((s >= self.low[anchor, slot]) & (s <= self.high[anchor, slot]))
            if len(k):
                self.found.append([anchor[k] * self.slots + slot, s[k], ids[j[k]]])
                self.size += len(k)

    def _settle(self) -> None:
        """Keeps the best of each wish; where there are enough, only scores as good as the last one are still wanted."""
        if not self.found:
            return
        wish, score, ids = map(np.concatenate, zip(*self.found))
        by = np.lexsort((ids, -score, wish))
        wish, score, ids = wish[by], score[by], ids[by]
        new = np.ones(len(wish), bool)
        new[1:] = wish[1:] != wish[:-1]
        rank = np.arange(len(wish)) - np.maximum.accumulate(np.where(new, np.arange(len(wish)), 0))
        full = rank == self.want - 1
        at = np.divmod(wish[full], self.slots)
        self.low[at] = np.maximum(self.low[at], score[full])
        good = rank < self.want
        self.found, self.size = [[wish[good], score[good], ids[good]]], int(good.sum())

    def block(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        t = self.table
        x = np.zeros((len(ids), t.dim))
        x[:, : v.shape[1]] = v
        by = np.argsort(labels, kind="stable") if self.same else np.arange(len(ids))
        x, ids, labels, rows, d = x[by], ids[by], labels[by], rows[by], d[:, by]
        for i in range(0, len(self.q), ANCHORS):
            a = slice(i, min(i + ANCHORS, len(self.q)))
            r = slice(0, len(ids))
            if self.same:
                r = slice(np.searchsorted(labels, self.labels[a][0]), np.searchsorted(labels, self.labels[a][-1], "right"))
            low, high = self.low[a].min(1), self.high[a].max(1)
            if r.start >= r.stop or (low > high).all():
                continue
            dq, dx = self.d[:, a], d[:, r]
            apart = np.maximum(0.0, np.maximum(dq.min(1) - dx.max(1), dx.min(1) - dq.max(1))).max()  # the block as a whole
            if (self.square[a].max() + t.most - apart**2) / 2 + t.slack < low.min():
                continue
            gap, sum_ = np.abs(dq[0][:, None] - dx[0]), dq[0][:, None] + dx[0]
            for k in range(1, len(dq)):
                np.maximum(gap, np.abs(dq[k][:, None] - dx[k]), out=gap)
                np.minimum(sum_, dq[k][:, None] + dx[k], out=sum_)
            whole = (self.square[a] + t.most)[:, None]
            alive = (whole - gap * gap) / 2 + t.slack >= low[:, None]
            alive &= (whole - sum_ * sum_) / 2 - t.slack <= high[:, None]
            at = np.flatnonzero(alive.any(0))
            if len(at):
                self._checked(a, x[r][at], ids[r][at], labels[r][at], rows[r][at], alive[:, at])
        if self.size > 4 * self.want * self.slots * max(len(self.q), 1024):
            self._settle()

    def result(self) -> pa.RecordBatch:
        self._settle()
        wish, score, ids = self.found[0] if self.found else [np.zeros(0, np.int64)] * 3
        anchor, slot = np.divmod(wish, self.slots)
        return pa.RecordBatch.from_arrays([pa.array(self.rows[anchor]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(ids)], names=["anchor", "slot", "score", "vec_id"])


def _best(blocks: DataFrame, table: Table, anchors: pa.Table, same: bool, want: int, lows: np.ndarray, highs: np.ndarray) -> DataFrame:
    """anchor (row), slot, rank, score, vec_id of the best rows of each wish of a group of anchors."""
    shared = blocks.sparkSession.sparkContext.broadcast((table, anchors, lows, highs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for block in _unpacked(batch):
                if search is None:
                    t, a, lo, hi = shared.value
                    search = Search(t, a, same, want, lo, hi)
                search.block(*block)
        if search is not None:
            yield search.result()

    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return blocks.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want)


def _bands(anchors: pa.Table, positives: pa.Table, count: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores least..most percent of each positive's score, by anchor and rank of the positive; without one, none."""
    lows = np.full((anchors.num_rows, count), np.iinfo(np.int64).max // 4)
    highs = np.full((anchors.num_rows, count), -1)
    place = {r: k for k, r in enumerate(anchors["row"].to_pylist())}
    at = np.array([place[r] for r in positives["anchor"].to_pylist()], dtype=np.int64), positives["rank"].to_numpy() - 1
    score = positives["score"].to_numpy()
    good = score >= 0  # a negative score would have to lie below most and above least percent of itself
    at, score = (at[0][good], at[1][good]), score[good]
    lows[at], highs[at] = -(-least * score // 100), most * score // 100
    return lows, highs


def hard_negatives(rows: DataFrame, modulus: int, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, group: int = GROUP) -> DataFrame:
    """rows: vec_id, label, v (whole numbers). Anchors are the rows whose vec_id is divisible by modulus. For each anchor
    and each of its first positives (rows of its label), the first negatives (rows of other labels) whose score lies in
    least..most percent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    out: list[DataFrame] = []
    with scratch(spark) as under:
        blocks, table = indexed(rows, under)
        asked = stored(_rows_where(blocks, modulus), "anchors", under)
        count = asked.count()
        groups = max(1, -(-2 * count // group)) if count > group else 1
        for g in range(groups):
            some = asked.where(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toArrow()
            if not some.num_rows:
                continue
            if some.num_rows > group:
                raise ValueError(f"a group of {some.num_rows} anchors is above {group}")
            everything = np.full((some.num_rows, 1), -(1 << 62)), np.full((some.num_rows, 1), 1 << 62)
            near = stored(_best(blocks, table, some, True, positives, *everything), "positives", under)
            bands = _bands(some, near.select("anchor", "rank", "score").toArrow(), positives, least, most)
            far = _best(blocks, table, some, False, negatives, *bands).withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score")
            near = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
            out.append(stored(far.join(near, ["anchor", "slot"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "hard-negatives"))
    return _union(spark, out)


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], RESULT)
    while len(parts) > 1:  # as a tree, so that many groups make no deep plan
        parts = [parts[k].unionByName(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]
