"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A document is a bag of sentences (ended by . ! ? or a line break). A sentence's score is a logistic function of its words'
features: the word and its first four and five bytes, A-Z lower-cased, hashed. What a sentence without any feature scores
(the bias) is the background: a sentence's probability is what its features add to it,
p = 1 - (1 - logistic(z)) / (1 - logistic(bias)), 0 for a sentence without features, so that length alone makes no text
toxic. A document's is 1 - prod(1 - p): one bad sentence makes a document toxic however long the rest is. Only document
labels are needed for the training, and the sentence probabilities then say where the trouble is.

The training takes at most max_rows labelled documents of each class (the documented bound of the sample; in the order of
a hash of doc_id, so the same rows each time), whole. Features are counted on the executors: a first pass gives each
feature's numbers of toxic and other documents, a second one the places of the features that are kept; no text comes to
the driver. Features are kept when they occur more often in toxic documents of the sample than in others and the
likelihood ratio of that difference is at least min_ratio; their weights start at their log odds. Scoring covers every
text, whole.

Defined results: null and empty texts, and texts without words, have no sentence and score 0; without any toxic
labelled document no feature is kept and all score 0; a document with several labels is toxic if one of them says so; of
several texts of one doc_id the least is learnt from; an empty table gives an empty result; further columns are ignored.
Places of offending sentences are bytes of the text in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, scratch, stored
from .words import ALNUM, U, blocks, hashes, spans, sums

BITS = 18
PREFIXES = (4, 5)
ENDS = np.zeros(256, np.int64)
ENDS[[ord(c) for c in ".!?\n"]] = 1


@dataclass
class Model:
    weights: np.ndarray  # float32, 2 ** BITS
    bias: float


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """For a block: word starts and ends, the sentence of each word (0, 1, ...), the row of each sentence, and three
    feature columns (word, prefixes; -1 where the word is no longer than the prefix)."""
    starts, ends, at = spans(data, offs, ALNUM)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    key = np.cumsum(ENDS[data])[starts] + row if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = key[1:] != key[:-1]
    sentence = np.cumsum(new) - 1
    total = sums(data)
    cols = [(hashes(total, starts, ends) >> U(64 - BITS)).astype(np.int64)]
    for k in PREFIXES:
        h = (hashes(total, starts, np.minimum(starts + k, ends)) ^ U(0x5851F42D4C957F2D * k % (1 << 64))) >> U(64 - BITS)
        cols.append(np.where(ends - starts > k, h.astype(np.int64), -1))
    return starts, ends, sentence, row[new], cols


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _xlog(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x log(p / q), 0 where x is 0."""
    return x * np.log(np.where(x > 0, p, 1) / np.where(x > 0, q, 1))


COUNTED_DDL = "feature int, toxic long, other long"
PLACED_DDL = "doc_id long, toxic int, sentence long, features array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each feature; of a task."""
    size = 1 << BITS
    counts = np.zeros((2, size), np.int64)
    for batch in batches:
        y = batch["toxic"].to_numpy()
        for i, _, data, offs in blocks(batch["text"]):
            _, _, sentence, rows, cols = features(data, offs)
            row = rows[sentence] if len(rows) else sentence
            held = np.unique(np.concatenate([row[c >= 0] << BITS | c[c >= 0] for c in cols]))
            toxic = y[(held >> BITS) + i] > 0
            for k, x in enumerate((toxic, ~toxic)):
                counts[k] += np.bincount(held[x] & (size - 1), minlength=size)
    own = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[0][own]), pa.array(counts[1][own])], names=["feature", "toxic", "other"])


def _placed(kept: np.ndarray):
    """The sentences that hold kept features, with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros((1 << BITS) + 1, bool)
        keep[kept] = True
        for batch in batches:
            ids, y = batch["doc_id"].to_pylist(), batch["toxic"].to_pylist()
            for i, _, data, offs in blocks(batch["text"]):
                _, _, _, rows, cols = own = features(data, offs)
                pair = np.unique(np.concatenate([own[2][keep[c]] << BITS | c[keep[c]] for c in cols]))
                sentence, feature = pair >> BITS, pair & ((1 << BITS) - 1)
                first = np.flatnonzero(np.diff(sentence, prepend=-1))
                ends = np.append(first[1:], len(pair))
                row = (rows[sentence[first]] + i).tolist() if len(first) else []
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in row], pa.int64()), pa.array([y[r] for r in row], pa.int32()), pa.array(sentence[first]), pa.array([feature[a:b].tolist() for a, b in zip(first, ends)], pa.list_(pa.int32()))], names=["doc_id", "toxic", "sentence", "features"])

    return run


def chosen(toxic: np.ndarray, other: np.ndarray, m: int, n: int, min_ratio: float) -> np.ndarray:
    """Whether features are kept, by the numbers of m toxic and n other documents that hold them."""
    part = (toxic + other) / max(m + n, 1)
    m, n = max(m, 1), max(n, 1)
    ratio = 2 * (_xlog(toxic, toxic / m, part) + _xlog(m - toxic, 1 - toxic / m, 1 - part) + _xlog(other, other / n, part) + _xlog(n - other, 1 - other / n, 1 - part))
    return (toxic / m > other / n) & (ratio >= min_ratio)


def trained(sent_doc: np.ndarray, labels: np.ndarray, feat_sent: np.ndarray, feat: np.ndarray, start: np.ndarray, size: int, rounds: int = 300, rate: float = 0.3, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the features (numbered from 0, first guesses in start) and the bias: maximum likelihood of the noisy-or
    bags by AdaGrad. Sentences without features have probability 0 and are not needed; size: documents of the sample."""
    w, bias = start.copy(), -5.0
    n_sent = len(sent_doc)
    past, past_bias = np.full(len(w), 1e-6), 1e-6
    for _ in range(rounds):
        z = bias + np.bincount(feat_sent, w[feat], n_sent)
        none = np.exp(np.bincount(sent_doc, np.minimum(_softplus(bias) - _softplus(z), 0), len(labels)))
        p = np.where(z > bias, 1 / (1 + np.exp(-z)), 0)
        pull = np.where(labels > 0, none / np.maximum(1 - none, 1e-6), -1.0)[sent_doc]
        g = np.bincount(feat, (p * pull)[feat_sent], len(w)) - decay * w * size / 100
        past += g * g
        w += rate * g / np.sqrt(past)
        gb = float((pull * np.where(z > bias, p - 1 / (1 + np.exp(-bias)), 0)).sum())
        past_bias += gb * gb
        bias = min(bias + rate * gb / np.sqrt(past_bias), -1.0)
    return w, bias


def scored(model: Model, data: np.ndarray, offs: np.ndarray, offending: float) -> tuple[np.ndarray, list]:
    """Scores of a block's rows, and each row's offending sentences (start, end in bytes, probability)."""
    n = len(offs) - 1
    starts, ends, sentence, rows, cols = features(data, offs)
    if not len(starts):
        return np.zeros(n), [[] for _ in range(n)]
    table = np.append(model.weights, np.float32(0))
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    # a feature counts once in a sentence: repeats of a word with weight are rare, so only those are made unique
    z = np.full(len(rows), model.bias)
    for c in cols:
        w = table[c]
        own = np.flatnonzero(w)
        pair = np.unique(sentence[own] << BITS | c[own])
        z += np.bincount(pair >> BITS, model.weights[pair & ((1 << BITS) - 1)], len(rows))
    clean = np.minimum(_softplus(model.bias) - _softplus(z), 0)  # the logarithm of 1 - p
    none = np.bincount(rows, clean, n)
    where: list = [[] for _ in range(n)]
    p = -np.expm1(clean)
    last = np.append(first[1:], len(starts)) - 1
    for k in np.flatnonzero(p >= offending):
        r = rows[k]
        where[r].append({"start": int(starts[first[k]] - offs[r]), "end": int(ends[last[k]] - offs[r]), "p": float(p[k])})
    return 0.0 - np.expm1(none), where


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, min_ratio: float = 15.0) -> Model:
    """Trains on at most max_rows toxic and max_rows other documents of docs joined with labels (doc_id, toxic)."""
    spark = ready(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(max_rows).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(max_rows))
    none = Model(np.zeros(1 << BITS, np.float32), -5.0)
    with scratch(spark) as under:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
        sample = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample", under)
        classes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        m, n = classes.get(1, 0), classes.get(0, 0)
        counts = sample.mapInArrow(_counted, COUNTED_DDL).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).toArrow()
        feature, toxic, other = (counts[c].to_numpy() for c in ("feature", "toxic", "other"))
        keep = chosen(toxic, other, m, n, min_ratio) if m else np.zeros(len(feature), bool)
        if not keep.any():
            return none
        order = np.argsort(feature[keep])
        feature, toxic, other = (x[keep][order] for x in (feature, toxic, other))
        rows = sample.mapInArrow(_placed(feature), PLACED_DDL).toArrow().sort_by([("doc_id", "ascending"), ("sentence", "ascending")])
    # a sentence's number is its own within a block only; a row is one sentence
    ids, doc = np.unique(rows["doc_id"].to_numpy(), return_inverse=True)
    labels_of = np.zeros(len(ids), np.int64)
    labels_of[doc] = rows["toxic"].to_numpy()
    size = rows["features"].combine_chunks().value_lengths().to_numpy()
    feat = np.searchsorted(feature, rows["features"].combine_chunks().flatten().to_numpy())
    start = np.log((toxic + 0.5) / (m + 1)) - np.log((other + 0.5) / (n + 1))
    w, bias = trained(doc, labels_of, np.repeat(np.arange(len(doc)), size), feat, start, m + n)
    none.weights[feature] = w
    return Model(none.weights, float(bias))


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_id, score, offending (array of start, end, p) for every row of docs."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in blocks(batch["text"]):
                s, where = scored(held.value, data, offs, offending)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(s), pa.array(where, schema.field(2).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,p:double>>")


def kept(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs, with all their columns, that score under limit."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [scored(held.value, data, offs, 2.0)[0] < limit for _, _, data, offs in blocks(batch["text"])]
            yield batch.filter(pa.array(np.concatenate(low) if low else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
