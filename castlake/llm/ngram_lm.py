"""Interpolated modified Kneser-Ney model of any order (bigrams unless said otherwise), counted in Spark, stored as sorted hash arrays, mapped by workers.

Tokens are 64-bit hashes of words (A-Z lower-cased, split at ASCII white space) and one end of each text; a start token
is a context only. Counting: each task makes the pairs of its texts unique and counts them, packed arrays are dealt by
ranges of the pair's hash, and each range becomes one file of sorted hashes and one of counts in the shared folder. The
same pass yields, for each token, its count, how many contexts it continues, and how many continuations it has that
occur once, twice and more often; these are dealt by ranges of the token's hash and stored the same way. No count is
pruned. Scoring: workers map the files into memory, look the sorted hashes of a block of texts up and sum the logarithms.

  p(w|h) = max(c(hw) - D(c(hw)), 0) / c(h) + (D1 N1(h) + D2 N2(h) + D3 N3+(h)) / c(h) * p(w)
  p(w)   = max(k(w) - d(k(w)), 0) / K + (d1 M1 + d2 M2 + d3 M3+) / K / (V + 1)

with k(w) the number of contexts of w, K its sum, and the discounts of each level from its counts of counts (0.5, 1, 1.5
where those are too thin). After an unseen context, p(w|h) = p(w).

Of a higher order N, the grams of N tokens are counted so (a text has N - 1 start tokens before it), and each shorter gram
counts the tokens that stand before it; every level k above 1 has the first formula with its own counts and discounts, and
p of the level below. Each level is a pass of its own over packed arrays, stored as the pairs are, with a table of the
contexts' sums.

Memory: a task holds the pairs of FLUSH tokens, and in the merge one range of hashes; ranges have a fixed mean size, so
their number grows with the input. The files must be reachable as files (a mounted shared folder). The model knows which
ranges have a file: one that a worker cannot see is an error, never a range without keys. A worker keeps MAPS arrays
mapped, those that it used last.

Defined results: null and empty texts have the end token alone; without training rows every probability is 1 / (V + 1)
= 1 and the base is log10(0.5 / 0.5) = 0 a token; repeated rows count each time; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, shared_dir
from .words import U, blocks, hashes, mixed, spans, sums

START, END = U(0x5EED57A127), U(0x5EED0E9D)
FLUSH = 1 << 21
RANGE = 2_000_000  # pairs of a range, on average at most
MAPS = 8192  # arrays that a worker has mapped at once; a process may have 65,530 maps as a rule
COLUMNS = ("count", "kinds", "once", "twice", "more")
SUMS = ("count", "once", "twice", "more")


@dataclass
class Model:
    folder: str
    ranges: int
    tokens: int
    types: int
    pairs: int
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    gamma: float
    order: int = 2
    upper: tuple[tuple[float, float, float], ...] = ()  # of the levels from 3
    stored: dict[str, np.ndarray] = field(default_factory=dict)  # of each kind of file, whether a range has one


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and tokens of a block, one after the other, and where each row's begin."""
    starts, ends, at = spans(data, offs)
    n = len(offs) - 1
    word = np.insert(hashes(sums(data), starts, ends), at[1:], END)
    begin = at + np.arange(n + 1)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[begin[:-1]] = START
    return context, word, begin


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(context * U(0x9FB21C651E98DF25) + word)


def gram_columns(data: np.ndarray, offs: np.ndarray, order: int) -> list[np.ndarray]:
    """The tokens of a block, behind columns of those 1, 2, .. order - 1 places before (the farthest first)."""
    context, word, begin = tokens(data, offs)
    out = [context, word]
    while len(out) < order:
        before = np.empty_like(word)
        before[1:] = out[0][:-1]
        before[begin[:-1]] = START
        out.insert(0, before)
    return out


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of successive tokens; a single one is its own."""
    key = columns[0]
    for c in columns[1:]:
        key = pair_key(key, c)
    return key


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges in the order of the keys."""
    return (key >> U(32)) * U(ranges) >> U(32)


def _packed(key: np.ndarray, ranges: int, arrays: list[np.ndarray]) -> list[dict]:
    """Rows (bucket, n, payload) of arrays that are sorted by key."""
    cuts = np.searchsorted(range_of(key, ranges), np.arange(ranges + 1, dtype=np.uint64))
    return [{"bucket": int(k), "n": int(b - a), "payload": b"".join(x[a:b].tobytes() for x in arrays), "stats": None} for k, a, b in zip(range(ranges), cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]


ROWS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64())), ("kind", pa.int32())])
ROWS_DDL = "bucket int, n int, payload binary, stats array<long>, kind int"
#: Rows that go along with the grams of a level: figures, words' occurrences, and from 3 the contexts of that level.
FIGURES, WORDS = 1, 2


#: Figures of each file: its range, its level (of contexts and words that go along: less than 0), and the counts of counts.
STATS = ("bucket", "level", "kinds", "total", "n1", "n2", "n3", "n4")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by their range; each task has every parts-th of them."""
    return rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))


def _unpacked(payload: bytes, sizes: tuple[int, ...], kinds: tuple[type, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _pairs_packed(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs as numbers in a list of their distinct tokens, in the order of the contexts (equal ones compress)."""
    return _grams_packed([context, word], n)


def _grams_packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    size = len(n)
    kinds, number = np.unique(np.concatenate(columns), return_inverse=True)
    number = number.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32).reshape(len(columns), size)
    order = np.lexsort(number[-2::-1]) if len(columns) > 2 else np.argsort(number[0], kind="stable")
    return np.array([len(kinds)], np.uint32).tobytes() + b"".join(x.tobytes() for x in (kinds, *number[:, order], n[order].astype(np.uint32)))


def _grams_unpacked(payload: bytes, n: int, level: int) -> list[np.ndarray]:
    many = int(np.frombuffer(payload, np.uint32, 1)[0])
    kind = np.uint16 if many <= 1 << 16 else np.uint32
    kinds, *columns, count = _unpacked(payload[4:], (many, *[n] * (level + 1)), (np.uint64, *[kind] * level, np.uint32))
    return [*(kinds[c] for c in columns), count]


def _pairs_unpacked(payload: bytes, n: int) -> list[np.ndarray]:
    return _grams_unpacked(payload, n, 2)


def _gram_rows(columns: list[np.ndarray], n: np.ndarray, key: np.ndarray, ranges: int) -> list[dict]:
    """Rows of grams that are sorted by key."""
    cuts = np.searchsorted(range_of(key, ranges), np.arange(ranges + 1, dtype=np.uint64)).tolist()
    return [{"bucket": k, "n": b - a, "payload": _grams_packed([c[a:b] for c in columns], n[a:b])} for k, a, b in zip(range(ranges), cuts, cuts[1:]) if b > a]


def _count(ranges: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.uint64)] * order
            held.clear()
            key, first, n = np.unique(folded(columns), return_index=True, return_counts=True)
            return pa.RecordBatch.from_pylist(_gram_rows([c[first] for c in columns], n.astype(np.uint32), key, ranges), ROWS)

        for batch in batches:
            for _, _, data, offs in blocks(batch["text"]):
                held.append(gram_columns(data, offs, order))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield flush()
        yield flush()

    return run


def _store(path: str, **arrays: np.ndarray) -> None:
    for name, x in arrays.items():
        own = f"{path}.{name}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, x)
        os.replace(own, f"{path}.{name}")


def _of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _summed(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True)) if len(key) else np.zeros(0, np.int64)
    return key[first], [np.add.reduceat(c[order].astype(np.int64), first) if len(key) else c for c in columns]


def _beside(folder: str, merge):
    """merge over the grams alone; the rows that go along are stored, the figures passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        figures: list[dict] = []

        def grams() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.filter(pa.compute.is_valid(batch["kind"])).to_pylist():
                    if row["kind"] == FIGURES:
                        figures.append(row)
                    else:
                        many = 2 if row["kind"] == WORDS else 5
                        sides.setdefault((row["kind"], row["bucket"]), []).append(_unpacked(row["payload"], (row["n"],) * many, (np.uint64,) * many))
                yield batch.filter(pa.compute.is_null(batch["kind"]))

        yield from merge(grams())
        for kind, bucket in list(sides):
            key, *share = (np.concatenate(x) for x in zip(*sides.pop((kind, bucket))))
            key, share = _summed(key, share)
            _store(f"{folder}/beside{kind}-{bucket}", key=key, **{c: x.astype(np.min_scalar_type(int(x.max()))) for c, x in zip(SUMS, share)})
            figures.append({"bucket": bucket, "n": 0, "stats": [-kind, len(key), 0, 0, 0, 0, 0], "kind": FIGURES})
        yield pa.RecordBatch.from_pylist(figures, ROWS)

    return run


def _merge_grams(folder: str, ranges: int, level: int, top: bool):
    """Writes each range of the grams of a level from 3; yields those of the level below, and the rows that go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, n, payload in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "payload"))):
                parts.setdefault(bucket, []).append(_grams_unpacked(payload, n, level))
        for bucket in list(parts):
            *columns, n = (np.concatenate(x) for x in zip(*parts.pop(bucket)))
            key = folded(columns)
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
            n = np.add.reduceat(n[order].astype(np.int64), first)
            key, columns = key[first], [c[order[first]] for c in columns]
            large = np.flatnonzero(n >= 255)
            _store(f"{folder}/grams{level}-{bucket}", key=key, n=np.minimum(n, 255).astype(np.uint8), large=np.stack([large, n[large]]))
            below, at, ways = np.unique(folded(columns[1:]), return_index=True, return_counts=True)
            rows = _gram_rows([c[at] for c in columns[1:]], ways, below, ranges)
            context, share = _summed(folded(columns[:-1]), [n, n == 1, n == 2, n >= 3])
            rows += [{**r, "kind": level} for r in _packed(context, ranges, [context, *(x.astype(np.uint64) for x in share)])]
            if top:
                word, share = _summed(columns[-1], [n])
                rows += [{**r, "kind": WORDS} for r in _packed(word, ranges, [word, share[0].astype(np.uint64)])]
            rows.append({"bucket": bucket, "n": 0, "stats": [level, len(key), int(n.sum()), *_of_counts(n)], "kind": FIGURES})
            yield pa.RecordBatch.from_pylist(rows, ROWS)

    return run


def _merge_pairs(folder: str, ranges: int):
    """Writes each range of pairs; yields the tokens' shares, and the counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, n, payload in zip(*(batch[c].to_pylist() for c in ("bucket", "n", "payload"))):
                parts.setdefault(bucket, []).append(_pairs_unpacked(payload, n))
        for bucket in list(parts):
            context, word, n = (np.concatenate(x) for x in zip(*parts.pop(bucket)))
            key = pair_key(context, word)
            order = np.argsort(key)
            key, context, word = key[order], context[order], word[order]
            first = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
            n = np.add.reduceat(n[order].astype(np.int64), first)
            key, context, word = key[first], context[first], word[first]
            large = np.flatnonzero(n >= 255)
            _store(f"{folder}/pairs-{bucket}", key=key, n=np.minimum(n, 255).astype(np.uint8), large=np.stack([large, n[large]]))
            # as a context: occurrences and kinds of continuations; as a token: contexts (and, of the end, occurrences)
            one = np.ones(len(key), np.uint8)
            zero = np.zeros(len(key), np.uint8)
            own = [n, zero, n == 1, n == 2, n >= 3]
            end = word == END
            token, share = _summed(np.concatenate([context, word]), [np.concatenate(x) for x in zip(own, [np.where(end, n, 0), one, zero, zero, zero])])
            rows = _packed(token, ranges, [token, share[0].astype(np.uint64), *(x.astype(np.uint32) for x in share[1:])])
            rows.append({"bucket": bucket, "n": 0, "payload": None, "stats": [2, len(key), int(n.sum()), *_of_counts(n)]})
            yield pa.RecordBatch.from_pylist(rows, ROWS)

    return run


def _merge_tokens(folder: str, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {}
        stats = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["stats"]:
                    stats.append([row["bucket"], *row["stats"]])
                else:
                    parts.setdefault(row["bucket"], []).append(_unpacked(row["payload"], (row["n"],) * 6, (np.uint64, np.uint64, *[np.uint32] * 4)))
        for bucket in list(parts):
            token, *share = (np.concatenate(x) for x in zip(*parts.pop(bucket)))
            token, share = _summed(token, share)
            _store(f"{folder}/tokens-{bucket}", key=token, **{c: x.astype(np.min_scalar_type(int(x.max()))) for c, x in zip(COLUMNS, share)})
            kinds = share[1][token != START]
            stats.append([bucket, 1, len(kinds), int(kinds.sum()), *_of_counts(kinds)])
        yield pa.RecordBatch.from_pylist([dict(zip(STATS, x)) for x in stats], pa.schema([(c, pa.int64()) for c in STATS]))

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return found if all(0 < d <= k for k, d in enumerate(found, 1)) else (0.5, 1.0, 1.5)


def _kind(level: int) -> str:
    """The kind of the files of a level of figures."""
    return {1: "tokens", 2: "pairs"}.get(level, f"grams{level}" if level > 0 else f"beside{-level}")


def fit(texts: DataFrame, order: int = 2) -> Model:
    """Counts the grams of order tokens (2 and more) of column text of all rows."""
    if order < 2:
        raise ValueError(f"the order must be 2 or more, not {order}")
    spark = ready(texts.sparkSession)
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    if "://" in base:
        raise ValueError(f"the model's files are mapped into memory: spark.checkpoint.dir must be a mounted folder, not {base}")
    folder = f"{base}/ngram-{uuid.uuid4().hex}"
    os.makedirs(folder)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(16, int(size / (6 * RANGE)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 2)
    counted = _dealt(texts.select("text").mapInArrow(_count(ranges, order), ROWS_DDL), parts)
    for level in range(order, 2, -1):
        merge = _merge_grams(folder, ranges, level, level == order)
        counted = _dealt(counted.mapInArrow(_beside(folder, merge), ROWS_DDL), parts)
    merge = _merge_pairs(folder, ranges)
    merged = _dealt(counted.mapInArrow(merge if order == 2 else _beside(folder, merge), ROWS_DDL), parts)
    # a row for each file comes to the driver: some hundred bytes for each 12 MB of text
    stats = merged.mapInArrow(_merge_tokens(folder, ranges), ", ".join(f"{c} long" for c in STATS)).toArrow()
    level, bucket = stats["level"].to_numpy(), stats["bucket"].to_numpy()
    sums_of = {int(k): {c: int(stats[c].to_numpy()[level == k].sum()) for c in STATS[2:]} for k in np.unique(level)}
    there = {_kind(int(k)): np.isin(np.arange(ranges), bucket[level == k]) for k in np.unique(level)}
    none = dict.fromkeys(("kinds", "total", "n1", "n2", "n3", "n4"), 0)
    one, two = sums_of.get(1, none), sums_of.get(2, none)
    low = discounts(*(one[f"n{k}"] for k in range(1, 5)))
    more = one["kinds"] - one["n1"] - one["n2"]
    gamma = (low[0] * one["n1"] + low[1] * one["n2"] + low[2] * more) / one["total"] if one["total"] else 1.0
    high, *upper = (discounts(*(sums_of.get(level, none)[f"n{k}"] for k in range(1, 5))) for level in range(2, order + 1))
    return Model(folder, ranges, sums_of.get(order, none)["total"], one["kinds"], two["kinds"], high, low, gamma, order, tuple(upper), there)


class Mapped:
    """The model's arrays, mapped into memory; each lookup takes sorted keys."""

    def __init__(self, model: Model):
        self.model = model
        self.files: OrderedDict[tuple[str, int, str], np.ndarray] = OrderedDict()

    def array(self, kind: str, k: int, name: str) -> np.ndarray | None:
        """An array of a range; null where the range has no keys. A file that should be there and is not is an error."""
        there = self.model.stored.get(kind)
        if there is None or not there[k]:
            return None
        at = kind, k, name
        if at in self.files:
            self.files.move_to_end(at)
        else:
            if len(self.files) >= MAPS:
                self.files.popitem(last=False)  # unmapped with its last reference
            self.files[at] = np.load(f"{self.model.folder}/{kind}-{k}.{name}", mmap_mode="r")
        return self.files[at]

    def found(self, kind: str, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, places in keys, places in that range's arrays) of the keys that are stored."""
        cuts = np.searchsorted(range_of(keys, self.model.ranges), np.arange(self.model.ranges + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            table = self.array(kind, k, "key")
            if table is not None and len(table):
                part = keys[cuts[k] : cuts[k + 1]]
                at = np.minimum(np.searchsorted(table, part), len(table) - 1)
                hit = np.flatnonzero(np.asarray(table[at]) == part)
                yield k, hit + cuts[k], at[hit]

    def pairs(self, keys: np.ndarray, kind: str = "pairs") -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for k, to, at in self.found(kind, keys):
            n = np.asarray(self.array(kind, k, "n")[at]).astype(np.int64)
            big = np.flatnonzero(n == 255)
            if len(big):
                where, value = self.array(kind, k, "large")
                n[big] = value[np.searchsorted(where, at[big])]
            out[to] = n
        return out

    def tokens(self, keys: np.ndarray, kind: str = "tokens", names: tuple[str, ...] = COLUMNS) -> np.ndarray:
        out = np.zeros((len(names), len(keys)), np.int64)
        for k, to, at in self.found(kind, keys):
            for row, name in zip(out, names):
                row[to] = self.array(kind, k, name)[at]
        return out


def scored(mapped: Mapped, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base, score of a block's rows."""
    m = mapped.model
    context, word, begin = tokens(data, offs)
    kinds, of = np.unique(np.concatenate([word, [START]]), return_inverse=True)
    count, ways, once, twice, more = mapped.tokens(kinds)
    low = np.array([0, *m.low])
    p_low = np.maximum(ways - low[np.minimum(ways, 3)], 0) / max(m.pairs, 1) + m.gamma / (m.types + 1)
    high = np.array([0, *m.high])
    spare = (high[1] * once + high[2] * twice + high[3] * more) / np.maximum(count, 1)
    place = of[:-1]
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[begin[:-1]] = of[-1]
    pair, to = np.unique(pair_key(context, word), return_inverse=True)
    c = mapped.pairs(pair)[to]
    total = count[before]
    p = np.where(total > 0, np.maximum(c - high[np.minimum(c, 3)], 0) / np.maximum(total, 1) + spare[before] * p_low[place], p_low[place])
    columns = gram_columns(data, offs, m.order)
    for level, d in enumerate(m.upper, 3):
        d = np.array([0, *d])
        before, of_before = np.unique(folded(columns[-level:-1]), return_inverse=True)
        total, once, twice, more = mapped.tokens(before, f"beside{level}", SUMS)
        spare = ((d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1))[of_before]
        total = total[of_before]
        gram, to = np.unique(folded(columns[-level:]), return_inverse=True)
        c = mapped.pairs(gram, f"grams{level}")[to]
        p = np.where(total > 0, np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1) + spare * p, p)
    if m.order > 2:
        count = mapped.tokens(kinds, f"beside{WORDS}", SUMS[:1])[0]
    known = np.where(kinds == START, 0, count)[place]
    base = np.log10((known + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
    at = begin[:-1]
    return np.diff(begin), np.add.reduceat((known > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        for batch in batches:
            for i, j, data, offs in blocks(batch["text"], 1 << 21):
                n, known, base, full = scored(mapped, data, offs)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(n), pa.array(known), pa.array(np.full(j - i, model.tokens)), pa.array(base), pa.array(full)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(score_column: str = "score", n: str = "n_tokens") -> Column:
    return F.pow(F.lit(10.0), -F.col(score_column) / F.col(n))
