"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are reduced to lower-case letters (with their marks), digits and single spaces, in every
script: composed (NFC), case-folded and composed again, so that accented, Greek or Cyrillic capitals cost no edits; the
Turkish i's are taken as one letter, as capitals do not tell them apart. Punctuation, symbols and white space of any
script are spaces, signs without a shape of their own (soft hyphens, joiners, variation selectors) are left out. An item of m bytes may occur in a
document with at most e = rate * m edits. Then at least T = m + 1 - q (e + 1) of its q-grams survive (the q-gram lemma; an
item for which that is less than one is searched by shorter grams), and the alignment moves over e + 1 diagonals at most. Shared q-grams are counted in bands of 2 (e + 1) diagonals, each
overlapping the next by half, so that every such alignment lies within a band; bands with T shared q-grams or more are
verified by an alignment within the band, of the whole item against the document.

The items of a benchmark are held by the workers, up to ITEM_BYTES at a time (a checked bound; the index of a part, some 64
MB, is broadcast); the texts of one item_id stay together, and where they are longer they are a part of their own. A larger benchmark is dealt into as many parts. Then a sieve comes first: a bit for each hash of a gram of any item (64
MB, whatever the benchmark's size) is sent, and one pass over the documents stores those that have as many marked grams as
an occurrence of some item must share. Only these are then searched, part by part: each part's index is built, sent, used
in a job of its own and destroyed before the next one, so that driver and workers hold one at a time. Documents are read
whole, in blocks of rows.

Defined results: null texts and texts without letters or digits match nothing, and such items are matched by nothing;
items shorter than q are found as they stand, between word borders; equal items and repeated documents are each
reported; an empty table on either side gives an empty result; further columns are ignored (clean() keeps them).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from unicodedata import category, combining, decomposition, is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready, scratch, shared_dir, stored
from .words import U, blocks, hashes, sums

Q = 10
RATE = 0.07
ITEM_BYTES = 2 << 20  # an index takes about 32 bytes for each byte of its items
TABLE_BITS = 22
SIEVE_BITS = 29
BESIDE = 1  # a byte that no reduced text has


OTHER, NOTHING, OWN = 0, 1, 2  # a space, left out, a sign of its own
TABLED = 0x20000  # the signs beyond are ideographs, or selectors and tags, or not assigned
DOT, SMALL_I = 0x307, 0x69


@cache
def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Of each sign below TABLED, and of all beyond: its kind, whether it may join the sign before it, its fold (none beyond);
    and folds of several signs."""
    kind, joins, fold, more = np.full(TABLED + 1, OWN, np.uint8), np.zeros(TABLED + 1, bool), np.arange(TABLED + 1, dtype=np.int32), {}
    for k in range(TABLED):
        c = chr(k)
        if 0xD800 <= k < 0xE000:
            continue
        what = category(c)
        if what == "Cf" or 0xFE00 <= k < 0xFE10:
            kind[k] = NOTHING
        elif what[0] in "PSZ" or what == "Cc":
            kind[k] = OTHER
        joins[k] |= combining(c) > 0
        parts = decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and int(parts[1], 16) < TABLED:
            joins[int(parts[1], 16)] = True
        to = "i" if c in "\u0130\u0131" else normalize("NFC", c.casefold())
        fold[k] = ord(to[0])
        if len(to) > 1:
            more[k] = [ord(x) for x in to]
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True  # vowels and ends of Hangul syllables
    return kind, joins, fold, more


def _low(sign: np.ndarray) -> np.ndarray:
    """Places in the tables."""
    return np.minimum(sign, TABLED)


def _string(sign: np.ndarray) -> str:
    return sign.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _decoded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, where each begins and ends; bytes that are not UTF-8 give U+FFFD."""
    lead = (data & 0xC0) != 0x80
    lead[offs[:-1][offs[:-1] < len(data)]] = True
    first = np.flatnonzero(lead)
    past = np.append(first[1:], len(data))[: len(first)]
    sign, size = data[first].astype(np.int32), past - first
    odd = np.flatnonzero((sign >= 0x80) | (size != 1))
    b, size, begin = sign[odd], size[odd], first[odd]
    many = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
    whole = np.where(b < 0x80, b, b & (0xFF >> (many + 1))).astype(np.int32)
    for k in range(1, 4):
        at = np.flatnonzero((many > k) & (size > k))
        whole[at] = whole[at] << 6 | (data[begin[at] + k] & 0x3F)
    bad = (size != many) | (b >= 0xF8) | ((b & 0xC0) == 0x80) | (whole > 0x10FFFF)
    sign[odd] = np.where(bad, 0xFFFD, whole)
    return sign, first, past


def _composed(sign: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signs in form NFC, and the bytes that each stands for; no sign joins one of the row before."""
    text = _string(sign)
    if is_normalized("NFC", text):
        return sign, first, past
    joins = _signs()[1][_low(sign)]
    # a run: a sign, and those that may join it; only runs whose form differs are taken up
    begin = np.flatnonzero(~joins | (np.arange(len(sign)) == 0))
    end = np.append(begin[1:], len(sign))
    known: dict[str, str] = {}
    out, a, b, last = [], [], [], 0
    for x, y in zip(begin.tolist(), end.tolist()):
        own = text[x:y]
        to = known.get(own)
        if to is None:
            to = known[own] = normalize("NFC", own)
        if to != own:
            out += [sign[last:x], np.array([ord(c) for c in to], np.int64)]
            a += [first[last:x], np.full(len(to), first[x])]
            b += [past[last:x], np.full(len(to), past[y - 1])]
            last = y
    return np.concatenate([*out, sign[last:]]), np.concatenate([*a, first[last:]]), np.concatenate([*b, past[last:]])


def _folded(sign: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, _, fold, more = _signs()
    low = np.where(sign < TABLED, fold[_low(sign)], sign)
    long = np.zeros(TABLED + 1, bool)
    long[list(more)] = True
    wide = np.flatnonzero(long[_low(sign)])
    if len(wide):
        to = [more[k] for k in sign[wide].tolist()]
        many = np.ones(len(sign), np.int64)
        many[wide] = [len(x) for x in to]
        low, first, past = (np.repeat(x, many) for x in (low, first, past))
        at = (np.cumsum(many) - many)[wide]
        for k in range(1, max(map(len, to))):
            own = [j for j, x in enumerate(to) if len(x) > k]
            low[at[own] + k] = [to[j][k] for j in own]
    dotted = low == DOT
    if dotted.any():
        dotted[:1] = False
        dotted[1:] &= low[:-1] == SMALL_I
        low, first, past = low[~dotted], first[~dotted], past[~dotted]
    return low, first, past


class Spread:
    """The value of the sign that a byte belongs to; begin: each sign's first byte."""

    def __init__(self, begin: np.ndarray, values: np.ndarray):
        self.begin, self.values = begin, values

    def __getitem__(self, byte):
        return self.values[np.searchsorted(self.begin, byte, "right") - 1]


def reduced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, Spread, Spread]:
    """A block with one space for each run of other signs (none at the begin of a row), its offs, and where the sign that
    each byte stands for begins and ends in the block as it was."""
    kinds, joins, fold, _ = _signs()
    sign, first, past = _decoded(data, offs)
    if len(data) and data.max() >= 0x80:
        cut = np.searchsorted(first, offs[1:-1])
        head = sign[cut[cut < len(sign)]]
        if (joins[_low(head)] | joins[_low(fold[_low(head)])]).any():
            # a row that begins with a mark must not join the one before: a line break stands between any two rows
            sign, first, past = np.insert(sign, cut, 0x0A), np.insert(first, cut, offs[1:-1]), np.insert(past, cut, offs[1:-1])
        sign, first, past = _composed(*_folded(*_composed(sign, first, past)))
        own = past > first
        if not own.all():
            sign, first, past = sign[own], first[own], past[own]
    else:
        sign = fold[sign]
    kind = kinds[_low(sign)]
    if len(sign) and sign.max() >= 0xE0000:
        kind[(sign >= 0xE0000) & (sign < 0xE1000)] = NOTHING
    seen = kind != NOTHING
    if not seen.all():
        sign, first, past, kind = sign[seen], first[seen], past[seen], kind[seen]
    own = kind == OWN
    before = np.zeros(len(sign), bool)
    before[1:] = own[:-1]
    edge = np.searchsorted(first, offs[:-1])
    before[edge[edge < len(sign)]] = False
    at = np.flatnonzero(own | before)
    sign, first, past = np.where(own, sign, 0x20)[at], first[at], past[at]
    size = (1 + (sign >= 0x80)).astype(np.int64)
    if len(sign) and sign.max() >= 0x800:
        size += (sign >= 0x800).astype(np.int64) + (sign >= 0x10000)
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.frombuffer(_string(sign).encode("utf-8", "surrogatepass"), np.uint8)
    return out, begin[np.searchsorted(first, offs)], Spread(begin[:-1], first), Spread(begin[:-1], past)


def reduced_text(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return reduced(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b" ")


@dataclass
class Index:
    """Items and their q-grams; gram g occurs at places first[g]..first[g + 1]."""

    ids: list[int]
    items: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    q: int
    short: list[tuple[int, bytes]] = field(default_factory=list)
    rest: Index | None = None  # items that need shorter grams
    table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def known(self, h: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << TABLE_BITS, bool)
            self.table[(self.grams >> U(64 - TABLE_BITS)).astype(np.int64)] = True
        return np.flatnonzero(self.table[(h >> U(64 - TABLE_BITS)).astype(np.int64)])


def _index(rows: list[tuple[int, bytes]], q: int, rate: float) -> Index:
    ids, items, short = [], [], []
    for i, raw in rows:
        if len(raw) >= Q:
            ids.append(i)
            items.append(np.frombuffer(raw, np.uint8))
        elif raw:
            short.append((i, raw))
    m = np.array([len(x) for x in items], np.int64)
    budget = (rate * m).astype(np.int64)
    least = m + 1 - q * (budget + 1)
    rest = [(ids[k], items[k].tobytes()) for k in np.flatnonzero(least < 1)]
    own = np.flatnonzero(least >= 1)
    ids, items, m, budget, least = [ids[k] for k in own], [items[k] for k in own], m[own], budget[own], least[own]
    data = np.concatenate([np.zeros(0, np.uint8), *items])
    item = np.repeat(np.arange(len(items)), m - q + 1)
    at = np.arange(len(item)) - np.repeat(np.cumsum(m - q + 1) - (m - q + 1), m - q + 1)
    start = (np.cumsum(m) - m)[item] + at
    h = hashes(sums(data), start, start + q)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    return Index(ids, items, budget, least, grams, np.append(first, len(h)), item[order], at[order], q, short, _index(rest, max(1, q // 2), rate) if rest else None)


def index(rows: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Index:
    return _index([(i, reduced_text(text or "")) for i, text in rows], q, rate)


def aligned(items: list[np.ndarray], text: np.ndarray, lows: np.ndarray, highs: np.ndarray, diagonals: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a part of text[low:high] within a band of diagonals, and where that ends."""
    width, longest = int(widths.max()), max(len(x) for x in items)
    n = len(items)
    pattern = np.zeros((longest, n), np.uint8)
    size = np.array([len(x) for x in items])
    for k, x in enumerate(items):
        pattern[: len(x), k] = x
    step = np.arange(width)[:, None]
    outside = step >= widths
    far = np.int32(1 << 20)
    d = np.where(outside, far, 0).astype(np.int32)
    best, end = np.full(n, far), np.zeros(n, np.int64)
    for i in range(longest):
        place = diagonals + i + step
        inside = (place >= lows) & (place < highs)
        sign = np.where(inside, text[np.clip(place, 0, len(text) - 1)], BESIDE)
        tmp = d + (sign != pattern[i])
        tmp[:-1] = np.minimum(tmp[:-1], d[1:] + 1)
        d = np.minimum.accumulate(tmp - step, axis=0) + step
        d = np.where(outside, far, d).astype(np.int32)
        done = np.flatnonzero(size == i + 1)
        if len(done):
            k = d[:, done].argmin(0)
            best[done] = d[k, done]
            end[done] = diagonals[done] + i + 1 + k
    return best, end


def matches(ix: Index, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, distance, start, end) of a block; start and end are bytes of the row's text (start may be off by
    the edits)."""
    text, at, where, past = reduced(data, offs)
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    flat = text.tobytes() if ix.short else b""
    for i, raw in ix.short:
        k = flat.find(raw)
        while k >= 0:
            row = int(np.searchsorted(at, k, "right")) - 1
            if k + len(raw) <= at[row + 1] and (k == at[row] or flat[k - 1] == 32) and (k + len(raw) == at[row + 1] or flat[k + len(raw)] == 32):
                out.setdefault((row, i), (0, int(where[k] - offs[row]), int(past[k + len(raw) - 1] - offs[row])))
            k = flat.find(raw, k + 1)
    part: Index | None = ix
    while part is not None:
        for name, found in _within(part, text, at, where, past, offs):
            out[name] = min(out.get(name, found), found)
        part = part.rest
    return sorted((row, i, *x) for (row, i), x in out.items())


def _within(ix: Index, text: np.ndarray, at: np.ndarray, where: np.ndarray, past: np.ndarray, offs: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int, int]]]:
    """((row, item_id), (distance, start, end)) of the bands with enough grams that the alignment confirms."""
    q = ix.q
    if len(text) < q or not len(ix.grams):
        return
    start = np.arange(len(text) - q + 1)
    h = hashes(sums(text), start, start + q)
    place = ix.known(h)
    g = np.minimum(np.searchsorted(ix.grams, h[place]), len(ix.grams) - 1)
    hit = ix.grams[g] == h[place]
    place, g = place[hit], g[hit]
    many = ix.first[g + 1] - ix.first[g]
    place = np.repeat(place, many)
    k = np.repeat(ix.first[g], many) + np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many)
    item = ix.item[k]
    diagonal = place - ix.at[k]
    band = diagonal // (ix.budget[item] + 1) + 1  # 0 and more: a diagonal is at least -m
    shift = int(max(len(x) for x in ix.items)) + 2
    key = item << 40 | (band + shift)
    kinds, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    item = kinds >> 40
    keep = count >= ix.least[item]
    item, low = item[keep], ((kinds[keep] & ((1 << 40) - 1)) - shift - 1) * (ix.budget[item[keep]] + 1)
    if not len(item):
        return
    # a band near a row's border is tried in both rows
    m = np.array([len(x) for x in ix.items])[item]
    one = np.clip(np.searchsorted(at, low, "right") - 1, 0, len(offs) - 2)
    two = np.clip(np.searchsorted(at, low + m + 2 * (ix.budget[item] + 1), "right") - 1, 0, len(offs) - 2)
    rows = [(r, k) for k, (a, b) in enumerate(zip(one.tolist(), two.tolist())) for r in range(a, b + 1)]
    for part in range(0, len(rows), 256):
        r, k = map(np.array, zip(*rows[part : part + 256]))
        distance, end = aligned([ix.items[x] for x in item[k]], text, at[r], at[r + 1], low[k], 2 * (ix.budget[item[k]] + 1))
        for x in np.flatnonzero(distance <= ix.budget[item[k]]):
            row, which = int(r[x]), int(item[k[x]])
            last = int(min(end[x], at[row + 1])) - 1
            begin = max(int(at[row]), last + 1 - len(ix.items[which]))
            yield (row, ix.ids[which]), (int(distance[x]), int(where[begin] - offs[row]), int(past[last] - offs[row]))


class Sieve:
    """A bit for each hash of a gram of the items, of each length of grams, and how many marked grams of that length an
    occurrence of an item has at least."""

    def __init__(self):
        self.size = SIEVE_BITS
        self.bits = np.zeros(1 << (self.size - 3), np.uint8)
        self.least: dict[int, int] = {}

    def _places(self, h: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        at = ((h ^ U(q * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - self.size)).astype(np.int64)
        return at >> 3, (1 << (at & 7)).astype(np.uint8)

    def add(self, ix: Index | None) -> None:
        while ix is not None:
            if len(ix.grams):
                self._mark(ix.grams, ix.q, int(ix.least.min()))
            for _, raw in ix.short:
                own = np.frombuffer(raw, np.uint8)
                self._mark(hashes(sums(own), np.array([0]), np.array([len(own)])), len(own), 1)
            ix = ix.rest

    def _mark(self, h: np.ndarray, q: int, least: int) -> None:
        at, bit = self._places(h, q)
        np.bitwise_or.at(self.bits, at, bit)
        self.least[q] = min(least, self.least.get(q, least))

    def passes(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Rows of a block in which an item may occur."""
        text, at, _, _ = reduced(data, offs)
        total, out = sums(text), np.zeros(len(offs) - 1, bool)
        for q, least in self.least.items():
            if len(text) >= q:
                start = np.arange(len(text) - q + 1)
                byte, bit = self._places(hashes(total, start, start + q), q)
                marked = np.concatenate([[0], np.cumsum((self.bits[byte] & bit) > 0)])
                # grams that begin in a row; one that reaches into the next row can only add to its count
                out |= marked[np.minimum(at[1:], len(start))] - marked[np.minimum(at[:-1], len(start))] >= least
        return out


def _known(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _parts(known: DataFrame) -> int:
    """Into how many parts the items are dealt, of ITEM_BYTES on average at most."""
    return known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // ITEM_BYTES + 1


def _items(known: DataFrame, parts: int) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of ITEM_BYTES at most (or of what one item_id has); the driver holds one part at a time. All
    texts of an item_id are in one list, which reports the nearest of them."""
    for k in range(parts):
        held, size = [], 0
        for r in sorted(known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toLocalIterator()):
            n = len(r["text"].encode())
            if held and size + n > ITEM_BYTES and held[-1][0] != r["item_id"]:
                yield held
                held, size = [], 0
            held.append((r["item_id"], r["text"]))
            size += n
        if held:
            yield held


FOUND = "doc_id long, item_id long, distance long, start long, end long"


def _search(held: Broadcast) -> Callable:
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "start", "end")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            rows = [(ids[i + r], *x) for i, _, data, offs in blocks(batch["text"], lower=False) for r, *x in matches(held.value, data, offs)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, schema=schema)

    return run


def _kept(held: Broadcast, choose: Callable) -> Callable:
    """Rows of which choose(held, block) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [choose(held.value, data, offs) for _, _, data, offs in blocks(batch["text"], lower=False)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return run


def _without_items(ix: Index, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    keep = np.ones(len(offs) - 1, bool)
    keep[[x[0] for x in matches(ix, data, offs)]] = False
    return keep


def _sieve(known: DataFrame, parts: int) -> Broadcast:
    sieve = Sieve()
    for rows in _items(known, parts):
        sieve.add(index(rows))
    return known.sparkSession.sparkContext.broadcast(sieve)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every document and item that occurs in it."""
    spark = ready(docs.sparkSession)
    known, docs = _known(benchmark), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = _parts(known)
    if parts == 1:
        return docs.mapInArrow(_search(spark.sparkContext.broadcast(index([x for rows in _items(known, 1) for x in rows]))), FOUND)
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    with scratch(spark) as under:
        sieve = _sieve(known, parts)
        some = stored(docs.mapInArrow(_kept(sieve, Sieve.passes), docs.schema), "sieved", under)
        sieve.destroy()
        for rows in _items(known, parts):
            held = spark.sparkContext.broadcast(index(rows))
            some.mapInArrow(_search(held), FOUND).write.mode("append").parquet(path)
            held.destroy()
    return spark.read.schema(FOUND).parquet(path)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item occurs."""
    spark = ready(docs.sparkSession)
    known = _known(benchmark)
    parts = _parts(known)
    if parts == 1:
        return docs.mapInArrow(_kept(spark.sparkContext.broadcast(index([x for rows in _items(known, 1) for x in rows])), _without_items), docs.schema)
    sieve = _sieve(known, parts)
    some = stored(docs.mapInArrow(_kept(sieve, Sieve.passes), docs.schema), "sieved")
    for rows in _items(known, parts):
        held = spark.sparkContext.broadcast(index(rows))
        some = stored(some.mapInArrow(_kept(held, _without_items), docs.schema), "sieved")
        held.destroy()
    rest = docs.mapInArrow(_kept(sieve, lambda s, data, offs: ~s.passes(data, offs)), docs.schema)
    return rest.unionByName(some)
