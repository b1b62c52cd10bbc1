"""Periodic runs of words: maximal stretches in which words one period apart are identical, by a harmonic grid.

For each period p the grid has the places jp; a run of period p and at least 2p words holds two neighbours jp and (j+1)p
of it. From such a pair the longest common extension forward (f) and backward (b) gives the stretch jp-b .. (j+1)p+f,
which repeats if f + b >= p. Extensions are minima over the LCP array of a suffix array, of the words and of the words
in reverse order, answered by a range minimum structure. There are n/1 + n/2 + ... + n/(n/2) pairs, about n ln n; pairs
whose words differ need no extension and are passed over by one comparison. Of the periods that give a stretch the
least is its smallest period (the others are its multiples), so a stretch is reported once.

The texts of a block (half a megabyte, or one longer text) are taken as one sequence with a sign of its own between
them, so that one suffix array serves them all. A text in which no six words in a row occur twice has no run (a run of
12 words and of two periods repeats its first six words one period on) and is left out of the sequence.

Memory: some 60 bytes a word, and 4 more for each doubling of the longest repeat while the suffix array is made; nothing
grows with the number of texts. One pass, no shuffle.

Defined results: a null or blank text has no words and no runs; words are compared byte by byte, case counts; of a
repeated row each copy is reported; a null doc_id is kept; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready
from .words import WORD, blocks, grams, hashes, spans, sums

SHORTEST = 12
GRAM = SHORTEST // 2
PAIRS = 1 << 18  # pairs whose extensions are asked for at once
CELL = 16
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Minima:
    """Minimum of any range of an array: cells of CELL entries with running minima from both sides, and a sparse table
    over whole cells."""

    def __init__(self, values: np.ndarray):
        self.values = np.full(-(-len(values) // CELL) * CELL, np.iinfo(np.int32).max, np.int32)
        self.values[: len(values)] = values
        cells = self.values.reshape(-1, CELL)
        self.before = np.minimum.accumulate(cells, axis=1).ravel()
        self.behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [cells.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(cells):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of low..high, both included."""
        out = np.minimum(self.behind[low], self.before[high])
        a, b = low // CELL, high // CELL
        within = np.flatnonzero(a == b)
        if len(within):
            at, end = low[within].copy(), high[within]
            least = self.values[at]
            for _ in range(CELL - 1):
                at = np.minimum(at + 1, end)
                np.minimum(least, self.values[at], out=least)
            out[within] = least
        wide = np.flatnonzero(b - a >= 2)
        size = b[wide] - a[wide] - 1
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = wide[level == k]
            t = self.table[k]
            out[rows] = np.minimum(out[rows], np.minimum(t[a[rows] + 1], t[b[rows] - (1 << int(k))]))
        return out


class Extensions:
    """Longest common extensions within a sequence whose last entry occurs once."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        levels = _doubled(x)
        self.rank = levels[-1]
        order = np.empty(n, np.int32)
        order[self.rank] = np.arange(n, dtype=np.int32)
        i, j = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(n, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = np.flatnonzero(levels[k][i] == levels[k][j])
            i[same] += 1 << k
            j[same] += 1 << k
            lcp[same + 1] += 1 << k
        del levels
        self.minima = Minima(lcp)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.of(np.minimum(a, b) + 1, np.maximum(a, b))


def _doubled(x: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... entries, until all differ; only suffixes that still share a rank
    are sorted again. A rank is the place of the first suffix that shares it."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int32)
    key = x[order]
    levels: list[np.ndarray] = []
    base = np.zeros(len(x), np.int64)
    while True:
        m = len(order)
        place = np.arange(m)
        first = np.ones(m, bool)
        first[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(first, place, 0))
        rank = rank.copy()
        rank[order] = base + start
        levels.append(rank)
        last = np.ones(m, bool)
        last[:-1] = first[1:]
        order = order[~(first & last)]
        if not len(order):
            return levels
        key = (rank[order].astype(np.int64) << 32) | rank[order + (1 << (len(levels) - 1))]
        by = np.argsort(key)
        order, key = order[by], key[by]
        group = key >> 32
        place = np.arange(len(order))
        changed = np.ones(len(order), bool)
        changed[1:] = group[1:] != group[:-1]
        base = group - np.maximum.accumulate(np.where(changed, place, 0))


def _pairs(x: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places jp and periods p <= most with equal entries at jp and (j+1)p: small periods one by one, larger ones by j,
    so that there are about 2 sqrt(n) comparisons of whole slices."""
    n = len(x)
    split = min(most, int(n**0.5) + 1)
    for p in range(1, split + 1):
        j = np.flatnonzero(x[: n - p : p] == x[p::p])
        if len(j):
            yield j * p, np.full(len(j), p)
    for j in range(1, n // (split + 1) + 1):
        end = min(most, (n - 1) // (j + 1))
        if end > split:
            same = np.flatnonzero(x[j * (split + 1) : j * end + 1 : j] == x[(j + 1) * (split + 1) : (j + 1) * end + 1 : j + 1])
            if len(same):
                yield j * (same + split + 1), same + split + 1


def _chunks(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _least(found: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) with the least period of each stretch, in the order of start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    once = np.ones(len(found), bool)
    once[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[once]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(x: np.ndarray, row: np.ndarray, most: int, shortest: int = SHORTEST) -> np.ndarray:
    """start, end, period of all runs of the sequence x, whose first and last entries and those between texts occur
    once; row: the text that an entry belongs to."""
    ahead = behind = None
    found = np.zeros((0, 3), np.int64)
    for low, p in _chunks(_pairs(x, most)):
        within = np.flatnonzero(row[low] == row[low + p])
        if not len(within):
            continue
        low, p = low[within], p[within]
        if ahead is None:
            ahead, behind = Extensions(x), Extensions(np.ascontiguousarray(x[::-1]))
        f = ahead.of(low, low + p).astype(np.int64)
        b = behind.of(len(x) - low, len(x) - low - p).astype(np.int64)
        good = np.flatnonzero((f + b >= p) & (f + b + p >= shortest))
        if len(good):
            low, p, f, b = low[good], p[good], f[good], b[good]
            found = _least(np.concatenate([found, np.stack([low - b, low + p + f, p], axis=1)]))
    return found


def _repeating(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Texts in which some GRAM words in a row occur twice (by a hash, so it may name more)."""
    n = len(rows) - 1
    h = grams(hashes(sums(data), starts, ends), GRAM)
    row = np.repeat(np.arange(n), np.diff(rows))
    if not len(h):
        return np.zeros(n, bool)
    whole = row[: len(h)] == row[GRAM - 1 :]
    h, row = h[whole], row[: len(whole)][whole]
    by = np.argsort(h, kind="stable")  # equal hashes in the order of their places, so copies of a text stand together
    h, row = h[by], row[by]
    twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out = np.zeros(n, bool)
    out[row[1:][twice]] = True
    return out


def _exact(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of words, given by their bytes one behind the other: equal words have equal numbers."""
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _block(data: np.ndarray, offs: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, runs (text, start, length, period), and the collapsed texts."""
    starts, ends, rows = spans(data, offs)
    n, counts, lengths = len(rows) - 1, np.diff(rows), ends - starts
    keep = np.ones(len(starts), bool)
    runs = np.zeros((0, 4), np.int64)
    live = np.flatnonzero(_repeating(data, starts, ends, rows)) if shortest >= SHORTEST else np.flatnonzero(counts > 1)
    if len(live):
        size = counts[live]
        word = np.concatenate([np.arange(rows[r], rows[r + 1]) for r in live])
        take = np.repeat(np.isin(np.arange(n), live), counts)
        solid = np.repeat(take, lengths)
        ids = _exact(data[WORD[data]][solid], lengths[take])
        begin = np.concatenate([[0], np.cumsum(size + 1)])  # place of the sign before each text, and of the last sign
        x = np.empty(int(begin[-1]) + 1, np.int64)
        place = np.arange(len(ids)) + np.repeat(np.arange(1, len(live) + 1), size)
        x[begin] = -1 - np.arange(len(begin))
        x[place] = ids
        row = np.full(len(x), -1, np.int64)
        row[begin] = -1 - np.arange(len(begin))
        row[place] = np.repeat(np.arange(len(live)), size)
        found = runs_of(x, row, int(size.max()) // 2, shortest)
        text = row[found[:, 0]]
        runs = np.stack([live[text], found[:, 0] - begin[text] - 1, found[:, 1] - found[:, 0], found[:, 2]], axis=1)
        depth = np.zeros(len(x) + 1, np.int64)
        np.add.at(depth, found[:, 0] + found[:, 2], 1)
        np.add.at(depth, found[:, 1], -1)
        keep[word] = np.cumsum(depth)[place] == 0
    return counts, runs, keep, _joined(data, keep, lengths, rows)


def _joined(data: np.ndarray, keep: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between."""
    solid = data[WORD[data]][np.repeat(keep, lengths)]
    text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[keep]
    size = lengths[keep]
    spaced = np.ones(len(text), np.int64)
    spaced[:1] = 0
    spaced[1:] = text[1:] == text[:-1]
    out = np.full(int(size.sum() + spaced.sum()), 0x20, np.uint8)
    out[np.arange(len(solid)) + np.repeat(np.cumsum(spaced), size)] = solid
    total = np.zeros(len(rows), np.int64)
    np.add.at(total, text + 1, size + spaced)
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [None, pa.py_buffer(np.cumsum(total)), pa.py_buffer(out)])


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_words, its runs of at least shortest words (in the order of start and period), and
    the text collapsed: words that lie in a run behind its first period are left out, one space between the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in blocks(batch["text"], lower=False):
                counts, runs, _, collapsed = _block(data, offs, shortest)
                ends = np.searchsorted(runs[:, 0], np.arange(j - i + 1)).astype(np.int32)
                listed = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, j - i), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), listed), collapsed.cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and the digests of what was found."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id",
        "n_runs",
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
        "n_words",
    )
