"""Language identification by a bidirectional gated recurrent network over bytes.

A text (A-Z lower-cased) is cut into segments of SEGMENT bytes; each is read forwards and backwards by a gated recurrent
unit (piecewise linear gates), and every byte gets a probability of each language from the two states beside it. A
document's probabilities are the mean over its letters' bytes; the language is the likeliest, the score its probability.
The network is trained in numpy by backpropagation through time over each segment, from a bounded sample: of each
language the per_lang rows that come first by a hash of doc_id, and of their segments, which are cut on the executors,
at most per_lang_segments.
Scoring reads every byte of every text; documents of any length are taken segment by segment.

Defined results: `und` with score 0 for null texts, texts without a letter, and all texts if nothing was learnt; rows
with null lang teach nothing; equal probabilities go to the language that sorts first; repeated rows count as often as
they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ready
from .words import blocks

SEGMENT = 64
HIDDEN = 12
SURE = 1.25  # times chance; the least score of 16,000 test documents with a letter, noise included, was 1.45 times chance
UND = "und"
#: Bytes that count in the pool: letters of ASCII, and all of other scripts.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    langs: list[str]
    inputs: list[np.ndarray]  # for each direction: 256 x 3H
    states: list[np.ndarray]  # for each direction: 3H x H
    out: list[np.ndarray]  # for each direction: L x H
    bias: np.ndarray  # L


def _forward(e: np.ndarray, u: np.ndarray, x: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple | None]:
    """States of all steps (T, H, B) of bytes x (T, B); with keep, what the way back needs."""
    steps, width = x.shape
    h3 = e.shape[1]
    hidden = h3 // 3
    states = np.empty((steps, hidden, width), np.float32)
    gates = np.empty((steps, h3, width), np.float32) if keep else None
    fresh = np.empty((steps, hidden, width), np.float32) if keep else None
    h = np.zeros((hidden, width), np.float32)
    rows, given, own = np.empty((width, h3), np.float32), np.empty((h3, width), np.float32), np.empty((h3, width), np.float32)
    for t in range(steps):
        np.take(e, x[t], axis=0, out=rows, mode="clip")
        np.copyto(given, rows.T)
        np.matmul(u, h, out=own)
        if keep:
            fresh[t] = own[2 * hidden :]
        gate = own[: 2 * hidden]
        gate += given[: 2 * hidden]
        gate *= 0.25
        gate += 0.5
        np.clip(gate, 0, 1, out=gate)
        new = own[2 * hidden :]
        new *= gate[:hidden]
        new += given[2 * hidden :]
        np.clip(new, -1, 1, out=new)
        if keep:
            gates[t] = own
        np.subtract(h, new, out=states[t])
        states[t] *= gate[hidden:]
        states[t] += new
        h = states[t]
    return states, (gates, fresh) if keep else None


def _back(e: np.ndarray, u: np.ndarray, x: np.ndarray, states: np.ndarray, kept: tuple, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of e and u by backpropagation through time; pull: those of the states (T, H, B)."""
    gates, fresh = kept
    steps, hidden, width = states.shape
    g_u = np.zeros_like(u)
    g_in = np.empty((steps, 3 * hidden, width), np.float32)
    later = np.zeros((hidden, width), np.float32)
    none = np.zeros((hidden, width), np.float32)
    for t in range(steps - 1, -1, -1):
        before = states[t - 1] if t else none
        r, z, n = gates[t, :hidden], gates[t, hidden : 2 * hidden], gates[t, 2 * hidden :]
        d = later + pull[t]
        d_n = d * (1 - z) * (np.abs(n) < 1)
        d_z = d * (before - n) * 0.25 * ((z > 0) & (z < 1))
        d_r = d_n * fresh[t] * 0.25 * ((r > 0) & (r < 1))
        g_in[t] = np.concatenate([d_r, d_z, d_n])
        own = np.concatenate([d_r, d_z, d_n * r])
        g_u += own @ before.T
        later = d * z + u.T @ own
    flat = g_in.transpose(1, 0, 2).reshape(3 * hidden, -1)
    g_e = np.stack([np.bincount(x.ravel(), w, 256) for w in flat], 1).astype(np.float32)
    return g_e, g_u


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    p = np.exp(logits - logits.max(axis, keepdims=True))
    return p / p.sum(axis, keepdims=True)


def trained(segments: np.ndarray, labels: np.ndarray, langs: list[str], hidden: int = HIDDEN, steps: int = 350, width: int = 384, rate: float = 0.02, seed: int = 5) -> Model:
    """Cross entropy of every letter's label by Adam. segments: (n, SEGMENT) bytes; labels: each segment's language."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = [shape(256, 3 * hidden), shape(256, 3 * hidden), shape(3 * hidden, hidden), shape(3 * hidden, hidden), shape(len(langs), hidden), shape(len(langs), hidden), np.zeros(len(langs), np.float32)]
    for e in p[:2]:
        e[:, hidden : 2 * hidden] += 2  # gates that keep the state at first
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    by = [x for x in by if len(x)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, width // len(by))) for x in by])
        x, y = np.ascontiguousarray(segments[pick].T), labels[pick]
        hf, kf = _forward(p[0], p[2], x, True)
        xb = np.ascontiguousarray(x[::-1])
        hb, kb = _forward(p[1], p[3], xb, True)
        hb_at = hb[::-1]
        prob = _softmax(p[4] @ hf + p[5] @ hb_at + p[6][:, None], 1)
        prob[:, y, np.arange(len(y))] -= 1
        d = prob * (LETTER[x][:, None, :] / max(1, LETTER[x].sum())).astype(np.float32)
        flat = d.transpose(1, 0, 2).reshape(len(langs), -1)
        g = [None] * 7
        g[4] = flat @ hf.transpose(1, 0, 2).reshape(hidden, -1).T
        g[5] = flat @ hb_at.transpose(1, 0, 2).reshape(hidden, -1).T
        g[6] = flat.sum(1)
        g[0], g[2] = _back(p[0], p[2], x, hf, kf, p[4].T @ d)
        g[1], g[3] = _back(p[1], p[3], xb, hb, kb, (p[5].T @ d)[::-1])
        now = rate * min(1, 4 * (1 - step / (steps + 1)))
        for x_, g_, m, v in zip(p, g, first, second):
            m += 0.1 * (g_ - m)
            v += 0.01 * (g_ * g_ - v)
            x_ -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(langs, p[:2], p[2:4], p[4:6], p[6])


def _segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of the segments of a block's rows."""
    size = np.diff(offs)
    many = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offs[:-1][row] + k * SEGMENT
    return start, np.minimum(SEGMENT, offs[1:][row] - start), row


def position_probabilities(model: Model, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(T, L, B) probabilities of each byte of segments x (T, B) with these lengths (bytes behind the end are 0)."""
    hf, _ = _forward(model.inputs[0], model.states[0], x, False)
    logits = model.out[0] @ hf
    whole = bool((length == len(x)).all())
    turn = None if whole else np.maximum(length[None, :] - 1 - np.arange(len(x))[:, None], 0)
    xb = np.ascontiguousarray(x[::-1]) if whole else np.take_along_axis(x, turn, 0)
    hb, _ = _forward(model.inputs[1], model.states[1], xb, False)
    other = model.out[1] @ hb
    logits += other[::-1] if whole else np.take_along_axis(other, turn[:, None, :], 0)
    logits += model.bias[:, None]
    np.exp(logits - logits.max(1, keepdims=True), out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def pooled(model: Model, data: np.ndarray, offs: np.ndarray, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block: mean probabilities over its letters (rows, L), and how many letters have each label."""
    n, many = len(offs) - 1, len(model.langs)
    start, length, row = _segments(data, offs)
    total, labels, letters = np.zeros((n, many)), np.zeros((n, many), np.int64), np.zeros(n)
    full = length == SEGMENT
    step = np.arange(SEGMENT)[:, None]
    for group in (np.flatnonzero(full), np.flatnonzero(~full)):
        for a in range(0, len(group), width):
            own = group[a : a + width]
            inside = step < length[own]
            x = np.where(inside, data[np.minimum(start[own] + step, max(len(data) - 1, 0))], 0).astype(np.uint8)
            p = position_probabilities(model, x, length[own])
            mask = LETTER[x] & inside
            label = np.where(mask, p.argmax(1), many)
            p *= mask[:, None, :]
            share = p.sum(0)
            r = row[own]
            for k in range(many):
                total[:, k] += np.bincount(r, share[k], n)
                labels[:, k] += np.bincount(r, (label == k).sum(0), n).astype(np.int64)
            letters += np.bincount(r, mask.sum(0), n)
    return total / np.maximum(letters, 1)[:, None], labels


def label_positions(model: Model, text: str) -> list[str]:
    """The language of each byte of a text."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    start, length, _ = _segments(raw, np.array([0, len(raw)]))
    out = []
    for s, n in zip(start, length):
        p = position_probabilities(model, raw[s : s + n][:, None], np.array([n]))
        out += [model.langs[k] for k in p[:, :, 0].argmax(1)]
    return out


SEGMENTS_DDL = "doc_id long, lang string, k long, segment binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole segments of each text; a text shorter than a segment is repeated to fill one."""
    for batch in batches:
        ids, langs = batch["doc_id"].to_numpy(zero_copy_only=False), np.array(batch["lang"].to_pylist(), object)
        for i, _, data, offs in blocks(batch["text"]):
            start, length, row = _segments(data, offs)
            at = start - offs[:-1][row]
            for own in (np.flatnonzero(length == SEGMENT), np.flatnonzero((length < SEGMENT) & (at == 0))):
                x = data[start[own][:, None] + np.arange(SEGMENT)[None, :] % length[own][:, None]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + row[own]], pa.int64()), pa.array(langs[i + row[own]].tolist(), pa.string()), pa.array(at[own] // SEGMENT), pa.array([y.tobytes() for y in x], pa.binary())], names=["doc_id", "lang", "k", "segment"])


def _first(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in an order that begins with a hash. The limit is applied in each task before the
    shuffle, and a frequent key is dealt over 64 groups."""
    first = Window.partitionBy(key, F.pmod(order[0], F.lit(64))).orderBy(*order)
    then = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= n).withColumn("_n", F.row_number().over(then)).where(F.col("_n") <= n).drop("_n")


def fit(docs: DataFrame, per_lang: int = 400, per_lang_segments: int = 6000) -> Model:
    """Trains from text and lang of docs; at most per_lang_segments segments of at most per_lang rows of each language
    reach the driver, which are cut on the executors."""
    ready(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    chosen = _first(known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")), "lang", ["h", "doc_id"], per_lang).select("doc_id", "lang").distinct()
    segments = known.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").mapInArrow(_cut, SEGMENTS_DDL).withColumn("h", F.xxhash64("segment", "k", "doc_id"))
    sample = _first(segments, "lang", ["h", "doc_id", "k"], per_lang_segments).orderBy("lang", "h", "doc_id", "k").select("lang", "segment").toArrow()
    if not len(sample):
        return Model([], [], [], [], np.zeros(0, np.float32))
    lang = sample["lang"].to_pylist()
    langs = sorted(set(lang))
    x = np.frombuffer(b"".join(sample["segment"].to_pylist()), np.uint8).reshape(-1, SEGMENT)
    return trained(x, np.array([langs.index(k) for k in lang]), langs)


def _labelled(m: Model, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, list[dict[str, int]]]:
    """Language, score and labels' shares of a block's rows."""
    n = len(offs) - 1
    lang, score, shares = [UND] * n, np.zeros(n), [{} for _ in range(n)]
    if not m.langs:
        return lang, score, shares
    p, labels = pooled(m, data, offs)
    best = p.argmax(1)
    in_ascii = np.add.reduceat(np.append(LETTER[data] & (data < 128), False).astype(np.int64), offs[:-1]) * (np.diff(offs) > 0)
    for k in range(n):
        if in_ascii[k] or any(c.isalpha() for c in data[offs[k] : offs[k + 1]].tobytes().decode("utf-8", "replace")):
            lang[k], score[k] = m.langs[best[k]], min(1.0, p[k, best[k]])
            shares[k] = {x: int(v) for x, v in zip(m.langs, labels[k]) if v}
    return lang, score, shares


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and shares (letters' bytes with each label) of every row of docs."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in blocks(batch["text"], 1 << 20):
                lang, score, shares = _labelled(held.value, data, offs)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(lang, pa.string()), pa.array(score), pa.array([list(x.items()) for x in shares], pa.map_(pa.string(), pa.int64()))], names=["doc_id", "lang_pred", "score", "shares"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,long>")


def least_score(model: Model) -> float:
    """The score under which a document is rejected: chance gives each of L languages 1 / L, and the likeliest must have
    SURE times that (no limit with one language)."""
    return SURE / len(model.langs) if len(model.langs) > 1 else 0.0


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that have a language: a letter, and a score of least_score at least. The
    rest is noise to the network. All rows of a repeated doc_id are judged by their own texts; null texts go."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            for _, _, data, offs in blocks(batch["text"], 1 << 20):
                lang, score, _ = _labelled(held.value, data, offs)
                keep += [x != UND and s >= least_score(held.value) for x, s in zip(lang, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
