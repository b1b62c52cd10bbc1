"""N-gram Jaccard join by PartEnum signatures.

A text's set holds its distinct five-word shingles (as 64-bit hashes). Two sets link when 100 |A & B| >= 75 |A | B|.
Then they differ in at most (|A| + |B|) / 7 elements. Sizes fall into bands [2^t, 2^(t+1)); a set signs for its own
band, and for the next one if a partner may lie there. For a band the feature domain is partitioned by hash on two
levels, n1 parts of n2 each, and the signatures are the contents of all subsets of n2 - k2 of the n2 parts of a first
part: as n1 (k2 + 1) is more than the elements in which two linked sets may differ, some first part has k2 differing parts
at most, so some subset agrees exactly. Bands of sets under 16 shingles have n2 = 3 and k2 = 1. Beyond, n2 = 1 and k2 = 0
(each part is its own subset) and n1 is a multiple of the size, so that most elements are alone; see the README for the
figures of larger subsets there.

An element that differs spoils one signature of its part with n2 = 1 and two with n2 = 3. Of a set with p signatures that
may differ from a partner in k elements at least p - k (p - 2k) agree; the set therefore leaves out all but the first
k + 1 (2k + 1) in one global order (commonest last, then those of the fewest elements): the first of the agreeing
signatures in that order is kept by both sides. Sets with too few non-empty parts sign empty ones, too. So no linked pair
is without a common signature, whatever the order. Sets that may differ in no element link with equal ones alone.

With a signature goes its slack: |A| less 7 times the parts of a single element that come before it in A's order. At the
first common signature of a linked pair all parts before it differ, a single element makes a difference of its own, and
they differ in (|A| + |B|) / 7 elements at most; so the slacks of the two sum to 0 or more there. Members of a group
whose slack meets no other's are left out: texts that share a passage but have much else make no group.

Equal sets are one class from the start. Classes that share a signature are candidates: each group is first joined as a
star to its hub (the member of most groups) and verified exactly. In groups that then still hold several components
the members of different components whose slacks meet are (groups of one hub together) compared within a task, in large groups block by block, by
outlines that bound their difference from below, and what is left is verified the same. Signatures that many sets share
are dealt over all tasks, never gathered; a signature that no task has seen LOCAL_HEAVY times among FLUSH, or that is
rarer than the HEAVY commonest, is gathered as 13 bytes a set.

Defined results: texts that are null, empty or without words have an empty set, link with nothing and are their own
component; a text of one to four words has its whole sequence as its only element; equal doc_ids are taken as they come
(each row is returned, and component_id is the least doc_id of the component); an empty table gives an empty result.
Class ids are 64-bit hashes of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import dropped, ready, scratch, stored
from .words import U, blocks, grams, hashes, mixed, one_hash, spans, sums

SHINGLE = 5
PERCENT = 75
ENUMERATED = 4  # bands (of sets under 2 ** ENUMERATED) with three second parts and subsets of two
PARTS = 8  # parts of a larger band's domain, times its least size: most elements are alone, so passages that many sets
# share make up few of the signatures that are kept
FOLD = 8  # parts to a place (half a byte) of a set's outline
HEAVY = 1 << 18  # commonest signatures that are known by name; the order needs no more to be exact
LOCAL_HEAVY = 3  # sets of a task's share from which a signature is reported as common
SPLIT = 256  # sets from which a signature's group is dealt over all tasks
FLUSH = 1 << 20  # signatures that a task holds
SLACK = 32  # steps of a slack to a band's least size
BLOCK = 1024  # members of a block of an unsettled group


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    starts, ends, at = spans(data, offs)
    words = hashes(sums(data), starts, ends)
    all_grams = grams(words, SHINGLE)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(all_grams[a : b - SHINGLE + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            out.append(np.array([one_hash(words[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    return np.array([int(mixed(mixed(s).sum(keepdims=True) + U(len(s)))[0]) if len(s) else 0 for s in sets], np.uint64)


def first_parts(band: np.ndarray) -> np.ndarray:
    """Parts of the first level. Sets of the enumerated bands differ from a linked one in 2 (2 ** (band + 1) - 1) / 7
    elements at most; so many cannot spoil two parts of three in each of these."""
    most = 2 * (np.left_shift(2, band) - 1) // 7
    return np.where(band < ENUMERATED, most // 2 + 1, PARTS * np.left_shift(1, band)).astype(np.int64)


class Parts:
    """The second parts of some sets: unit u signs for set number[u] in a band, and has base[u + 1] - base[u] of them. Of
    each non-empty one: its unit, its place (base included), the count of its elements and a hash of them."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        own = np.frexp(sizes[full].astype(float))[1] - 1
        next_too = 4 * sizes[full] // 3 >= np.left_shift(2, own)
        number = np.concatenate([full, full[next_too]])
        band = np.concatenate([own, own[next_too] + 1]).astype(np.int64)
        n = sizes[number]
        differ = (n + np.minimum(4 * n // 3, np.left_shift(2, band) - 1)) // 7
        used = differ > 0
        self.number, self.band, self.n, self.differ = number[used], band[used], n[used], differ[used]
        self.several = self.band < ENUMERATED
        parts = first_parts(self.band) * np.where(self.several, 3, 1)
        self.base = base = np.concatenate([[0], np.cumsum(parts)])
        self.seed = seed = mixed(self.band.astype(np.uint64) + U(0x1234567))
        elements = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in self.number)])
        unit = np.repeat(np.arange(len(self.number)), self.n)
        spread = mixed(elements ^ seed[unit])
        place = base[unit] + (spread % parts[unit].astype(np.uint64)).astype(np.int64)
        order = np.argsort(place)
        place, unit = place[order], unit[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        self.count = np.diff(np.append(first, len(place)))
        self.unit, self.place = unit[first], place[first]
        content = np.add.reduceat(mixed(spread[order] + U(0xABCDEF)), first) if len(first) else np.zeros(0, np.uint64)
        self.sig = mixed(content ^ mixed(seed[self.unit] + (self.place - base[self.unit]).astype(np.uint64)))

    def signatures(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit, signature and count of elements of all subsets; empty ones of the enumerated bands included."""
        single = ~self.several[self.unit]
        out = [(self.unit[single], self.sig[single], self.count[single])]
        units = np.flatnonzero(self.several)
        if len(units):
            # the enumerated units' parts, empty ones included, three to a row
            size = np.diff(self.base)[units]
            begin = np.cumsum(size) - size
            at = np.full(len(self.number), -1)
            at[units] = begin
            own = self.several[self.unit]
            to = at[self.unit[own]] + self.place[own] - self.base[self.unit[own]]
            content, count = np.zeros(int(size.sum()), np.uint64), np.zeros(int(size.sum()), np.int64)
            content[to], count[to] = self.sig[own], self.count[own]
            content, count = content.reshape(-1, 3), count.reshape(-1, 3)
            unit = np.repeat(units, size // 3)
            which = self.seed[unit] + (np.arange(len(unit)) - np.repeat(begin // 3, size // 3)).astype(np.uint64)
            for a, b in ((0, 1), (0, 2), (1, 2)):
                subset = mixed(mixed(which * U(9) + U(3 * a + b)) ^ mixed(content[:, a] + U(0x51ED)) ^ content[:, b])
                out.append((unit, subset, count[:, a] + count[:, b]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def outlines(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Set's number, band and outline of each unit: half a byte for each FOLD parts (for each part of an enumerated
        band). Where two outlines differ the parts have different elements, so the number of differing halves bounds that
        of elements from below."""
        fold = np.where(self.several, 1, FOLD)
        size = (np.diff(self.base) // fold + 1) // 2
        begin = np.concatenate([[0], np.cumsum(size)])
        at = 2 * begin[self.unit] + (self.place - self.base[self.unit]) // fold[self.unit]
        flat = np.bincount(at, (self.sig & U(15)).astype(float), 2 * begin[-1]).astype(np.int64) & 15
        flat = (flat[::2] | flat[1::2] << 4).astype(np.uint8)
        return self.number, self.band, [flat[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places (halves of bytes) outlines differ, along the last axis."""
    d = x ^ y
    return np.count_nonzero(d & 15, axis=-1) + np.count_nonzero(d & 240, axis=-1)


def signatures(sets: list[np.ndarray], heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set's number, signature and slack (in steps of 1 / SLACK of the band's least size, rounded up) of the signatures
    that are kept. heavy: common ones, sorted, and their numbers of sets."""
    p = Parts(sets)
    unit, sig, count = p.signatures()
    common = np.zeros(len(sig), np.int64)
    if len(heavy[0]):
        i = np.minimum(np.searchsorted(heavy[0], sig), len(heavy[0]) - 1)
        hit = heavy[0][i] == sig
        common[hit] = np.frexp(heavy[1][i[hit]].astype(float))[1]
    common[count == 0] = 63
    key = unit.astype(np.uint64) << U(40) | np.minimum(common, 63).astype(np.uint64) << U(34) | (15 - np.minimum(count, 15)).astype(np.uint64) << U(30) | sig >> U(34)
    order = np.argsort(key)
    if (key[order[1:]] == key[order[:-1]]).any():  # equal keys must have one order
        order = np.lexsort((sig, key))
    unit, sig, alone = unit[order], sig[order], (count[order] == 1) & ~p.several[unit[order]]
    have = np.bincount(unit, minlength=len(p.number))
    begin = np.concatenate([[0], np.cumsum(have)])
    rank = np.arange(len(unit)) - begin[unit]
    before = np.concatenate([[0], np.cumsum(alone)])
    before = before[:-1] - before[begin[unit]]
    most = p.differ * np.where(p.several, 2, 1)
    keep = rank <= most[unit]
    slack = lambda u, k: np.clip(-((7 * k - p.n[u]) * SLACK // np.left_shift(1, p.band[u])), -128, 127).astype(np.int8)
    out = [(p.number[unit[keep]], sig[keep], slack(unit[keep], before[keep]))]
    for u in np.flatnonzero((have <= most) & ~p.several):  # all its parts are kept; the empty ones sign, too
        empty = np.setdiff1d(np.arange(p.base[u + 1] - p.base[u]), p.place[p.unit == u] - p.base[u])
        out.append((np.full(len(empty), p.number[u]), mixed(mixed(p.seed[u : u + 1] + empty.astype(np.uint64)) ^ U(0x77)), np.full(len(empty), 127, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


SCAN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("sig", pa.int64()), ("hits", pa.int64())])
SCAN_DDL = "doc_id long, n long, cls long, sig long, hits long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's size and class; common signatures of the task's distinct sets."""
    seen: set[int] = set()
    held: list[np.ndarray] = []

    def heavy() -> pa.RecordBatch:
        sig, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        held.clear()
        sig, n = sig[n >= LOCAL_HEAVY], n[n >= LOCAL_HEAVY]
        none = pa.nulls(len(sig), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, _signed(sig), pa.array(n.astype(np.int64))], schema=SCAN)

    for batch in batches:
        for i, j, data, offs in blocks(batch["text"]):
            sets = shingle_sets(data, offs)
            cls = class_of(sets)
            none = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), _signed(cls), none, none], schema=SCAN)
            fresh = []
            for c, s in zip(cls.tolist(), sets):
                if c not in seen:
                    seen.add(c)
                    fresh.append(s)
            held.append(Parts(fresh).signatures()[1])
            if sum(map(len, held)) > FLUSH:
                yield heavy()
    yield heavy()


PACKED = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("n", pa.int32()), ("payload", pa.binary())])


def _signer(heavy, buckets: int):
    """Packs the kept signatures of a task's distinct sets by bucket; those of hot groups are dealt over all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tuple(np.frombuffer(x, t) for x, t in zip(heavy.value, (np.uint64, np.int64)))
        hot = known[0][known[1] >= SPLIT]
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        ids: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sig, number, slack = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int8))
            cls = np.array(ids, np.uint64)
            held.clear()
            ids.clear()
            rows: list[tuple[int, bool, int, bytes]] = []
            is_hot = np.isin(sig, hot)
            for a in range(0, int(is_hot.sum()), 4096):
                s, c, k = (x[is_hot][a : a + 4096] for x in (sig, cls[number], slack))
                rows.append((int(c[0] % U(buckets)), True, len(s), s.tobytes() + c.tobytes() + k.tobytes()))
            sig, number, slack = sig[~is_hot], number[~is_hot], slack[~is_hot]
            bucket = ((sig >> U(32)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket << 32 | number, kind="stable")
            sig, number, slack, bucket = (sig[order] & U(0xFFFFFFFF)).astype(np.uint32), number[order], slack[order], bucket[order]
            # of a bucket: its classes, how many signatures each has there (65,535 at most to an entry), these and their slacks
            first = np.flatnonzero((np.diff(bucket << 32 | number, prepend=-1) != 0) | (np.arange(len(bucket)) % 65535 == 0))
            many = np.diff(np.append(first, len(bucket))).astype(np.uint16)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            own = np.searchsorted(first, cuts)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = own[k], own[k + 1]
                part = cls[number[first[a:b]]], many[a:b], sig[cuts[k] : cuts[k + 1]], slack[cuts[k] : cuts[k + 1]]
                rows.append((k, False, int(b - a), b"".join(x.tobytes() for x in part)))
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[a : a + 1024]), PACKED)], schema=PACKED)

        for batch in batches:
            for _, _, data, offs in blocks(batch["text"]):
                sets = shingle_sets(data, offs)
                fresh, begin = [], len(ids)
                for c, s in zip(class_of(sets).tolist(), sets):
                    if len(s) and c not in seen:
                        seen.add(c)
                        fresh.append(s)
                        ids.append(c)
                if fresh:
                    number, sig, slack = signatures(fresh, known)
                    held.append((sig, (number + begin).astype(np.int32), slack))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


GROUPS = pa.schema([("gid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("slack", pa.int8())])
GROUPS_DDL = "gid long, a long, b long, slack tinyint"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of classes with a common signature whose slacks meet: (null, a, b) for two, (group, class, null, slack) for
    each member of more."""
    parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        for bucket, hot, n, payload in zip(*(batch[c] for c in ("bucket", "hot", "n", "payload"))):
            raw, n = np.frombuffer(payload.as_buffer(), np.uint8), n.as_py()
            if hot.as_py():
                yield pa.RecordBatch.from_arrays([_signed(raw[: 8 * n].view(np.uint64).copy()), _signed(raw[8 * n : 16 * n].view(np.uint64).copy()), pa.nulls(n, pa.int64()), pa.array(raw[16 * n :].view(np.int8))], schema=GROUPS)
            else:
                cls, many = raw[: 8 * n].view(np.uint64), raw[8 * n : 10 * n].view(np.uint16)
                k = int(many.sum())
                parts.setdefault(bucket.as_py(), []).append((raw[10 * n : 10 * n + 4 * k].view(np.uint32), np.repeat(cls, many), raw[10 * n + 4 * k :].view(np.int8)))
    pairs, met = [], {}
    for bucket in list(parts):
        sig, cls, slack = (np.concatenate(x) for x in zip(*parts.pop(bucket)))
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        many = np.append(same, False) | np.insert(same, 0, False)
        order, sig = order[many], sig[many]
        cls, slack = cls[order], slack[order].astype(np.int64)
        order = np.lexsort((cls, sig))
        sig, cls, slack = sig[order], cls[order], slack[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls, slack = sig[new], cls[new], slack[new]
        if not len(sig):
            continue
        # of each group the greatest slack and the next one: a member's slack must meet the greatest of the others
        first = np.flatnonzero(np.insert(sig[1:] != sig[:-1], 0, True))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sig))))
        top = np.maximum.reduceat(slack, first)
        at_top = slack == top[group]
        second = np.maximum.reduceat(np.where(at_top, -999, slack), first)
        second = np.where(np.add.reduceat(at_top.astype(np.int64), first) > 1, top, second)
        keep = slack + np.where(at_top, second[group], top[group]) >= 0
        cls, slack, group = cls[keep], slack[keep], group[keep]
        if not len(group):
            continue
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.append(first, len(group)))
        two = first[size == 2]
        pairs.append(np.unique(np.stack([cls[two], cls[two + 1]], 1), axis=0))
        whole = np.add.reduceat(mixed(cls), first)
        for f, k, h in zip(first[size > 2].tolist(), size[size > 2].tolist(), whole[size > 2].tolist()):
            own = slack[f : f + k].astype(np.int8)
            if h in met:  # the same members under another signature
                np.maximum(met[h][1], own, out=met[h][1])
            else:
                met[h] = cls[f : f + k].copy(), own
    if met:
        size = [len(c) for c, _ in met.values()]
        gid = np.repeat(np.array(list(met), np.uint64), size)
        cls, slack = (np.concatenate(x) for x in zip(*met.values()))
        for a in range(0, len(gid), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([_signed(gid[part]), _signed(cls[part]), pa.nulls(len(gid[part]), pa.int64()), pa.array(slack[part])], schema=GROUPS)
    if pairs:
        two = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(two), pa.int64()), _signed(two[:, 0].copy()), _signed(two[:, 1].copy()), pa.nulls(len(two), pa.int8())], schema=GROUPS)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in blocks(batch["text"]):
            sets = shingle_sets(data, offs)
            number, band, bits = Parts(sets).outlines()
            yield pa.RecordBatch.from_arrays([_signed(class_of(sets)[number]), pa.array(band), pa.array(bits, pa.binary())], names=["cls", "band", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in blocks(batch["text"]):
            sets = shingle_sets(data, offs)
            yield pa.RecordBatch.from_arrays([_signed(class_of(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "set"])


def _alike(percent: int):
    """Leaves out pairs whose outlines show that they differ in too many elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()) * (100 - percent) // (100 + percent)
            differ = [apart(*(np.frombuffer(v.as_buffer(), np.uint8) for v in both)) for both in zip(batch["bits_a"], batch["bits_b"])]
            keep = pa.array(np.array(differ, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return run


MEMBER = ("cls", "comp", "slack", "hub", "n", "side")  # in the order of NARROW
NARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("gid", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64()), ("slack", pa.int32()), ("hub", pa.int64()), ("n", pa.int64()), ("side", pa.bool_())])
NARROW_DDL = "a long, b long, n_a long, n_b long, gid long, i long, j long, cls long, comp long, slack int, hub long, n long, side boolean"
FEW = 4  # pairs of a run to each of its members, up to which the pairs are named


def _open_to(m: dict[str, np.ndarray], k: int | slice, percent: int) -> np.ndarray:
    """Which members may link with the k-th: of another component and, of two blocks, of the other one; not its hub."""
    one = {c: x[k] if isinstance(k, int) else x[:, None] for c, x in m.items()}
    near = (m["comp"] != one["comp"]) & (100 * np.minimum(m["n"], one["n"]) >= percent * np.maximum(m["n"], one["n"])) & (m["slack"] + one["slack"] >= 0)
    near &= (m["cls"] != one["hub"]) & (one["cls"] != m["hub"])
    return near & (m["side"] != one["side"]) if m["side"].any() else near


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple[int, ...], dict[str, np.ndarray], list]]:
    """Key, columns and outlines of each run of rows of one key; one run is held at a time."""
    held: list[tuple[dict[str, np.ndarray], list]] = []
    last = None

    def whole():
        return last, {c: np.concatenate([x[c] for x, _ in held]) for c in columns}, [b for _, bits in held for b in bits]

    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))).tolist()
        data = {c: batch[c].to_numpy(zero_copy_only=False) for c in columns}
        data["slack"] = data["slack"].astype(np.int64)
        for a, b in zip(first, [*first[1:], len(batch)]):
            now = tuple(key[:, a].tolist())
            if held and now != last:
                yield whole()
                held.clear()
            last = now
            bits = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch["bits"].slice(a, b - a)] if "bits" in batch.schema.names else []
            held.append(({c: x[a:b] for c, x in data.items()}, bits))
    if held:
        yield whole()


def _narrowed(percent: int):
    """Of each run of members of a group (and pair of blocks): its open pairs if these are FEW, else its members that have
    any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for columns, rows in zip((NARROW.names[:4], NARROW.names[4:]), out):
                if rows:
                    x = dict(zip(columns, (np.concatenate(c) for c in zip(*rows))))
                    n = len(x[columns[0]])
                    yield pa.RecordBatch.from_arrays([pa.array(x[f.name]).cast(f.type) if f.name in x else pa.nulls(n, f.type) for f in NARROW], schema=NARROW)
                rows.clear()

        for key, m, _ in _runs(batches, ("gid", "i", "j"), MEMBER):
            near = _open_to(m, slice(None), percent)
            own = near.any(1)
            if np.count_nonzero(near) <= 2 * FEW * np.count_nonzero(own):
                a, b = np.nonzero(near)
                a, b = a[m["cls"][a] < m["cls"][b]], b[m["cls"][a] < m["cls"][b]]
                out[0].append([m["cls"][a], m["cls"][b], m["n"][a], m["n"][b]])
                size += len(a)
            else:
                n = int(own.sum())
                out[1].append([*(np.full(n, k) for k in key), *(m[c][own] for c in MEMBER)])
                size += n
            if size > 1 << 15:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _unsettled(percent: int):
    """Open pairs of each run (group, pair of blocks and band) that outlines do not rule out. Members whose own band is the
    one before meet members of this band alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, m, bits in _runs(batches, ("gid", "i", "j", "band"), (*MEMBER, "own")):
            bits = np.stack(bits)
            kinds, count = np.unique(m["comp"], return_counts=True)
            out = [np.zeros((0, 2), np.int64)]
            for k in np.flatnonzero(m["comp"] != kinds[count.argmax()]).tolist():  # pairs within the largest component are settled
                near = _open_to(m, k, percent)
                if not m["own"][k]:
                    near &= m["own"]
                at = np.flatnonzero(near)
                if len(at):
                    found = at[apart(bits[at], bits[k]) <= (m["n"][at] + m["n"][k]) * (100 - percent) // (100 + percent)]
                    out.append(np.sort(np.stack([m["cls"][found], np.full(len(found), m["cls"][k])], 1), axis=1))
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()


def _texts(docs: DataFrame, chosen: DataFrame, under: str) -> DataFrame:
    """The rows of docs with a doc_id of chosen."""
    ids = stored(chosen.select("doc_id").distinct(), "chosen", under)
    few = ids.count() <= 500_000  # 8 bytes each; beyond that both sides are shuffled
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, under: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    pairs = stored(pairs, "alike", under)
    sets = stored(_texts(docs, classes.join(_ends(pairs), "cls"), under).mapInArrow(_sets, "cls long, set binary").dropDuplicates(["cls"]), "sets", under)
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_verified(percent), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    return rows_of(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, found: DataFrame, under: str) -> DataFrame:
    spark = docs.sparkSession
    # at most HEAVY rows come to the driver, whatever the input
    heavy = found.where("sig is not null").groupBy("sig").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "sig").limit(HEAVY).toArrow()
    sig, hits = (heavy[c].to_numpy() for c in ("sig", "hits"))
    order = np.argsort(sig.astype(np.int64).view(np.uint64)) if len(sig) else np.zeros(0, np.int64)
    known = spark.sparkContext.broadcast((sig.astype(np.int64).view(np.uint64)[order].tobytes(), hits[order].astype(np.int64).tobytes()))
    elements = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), elements // 4_000_000)
    packed = docs.mapInArrow(_signer(known, parts), "bucket int, hot boolean, n int, payload binary")
    return stored(packed.repartitionById(parts, "bucket").mapInArrow(_groups, GROUPS_DDL), "groups", under)


def _candidates(groups: DataFrame, under: str) -> tuple[DataFrame, DataFrame]:
    """Members (gid, cls, slack) whose slacks meet another's, and pairs (a, b): groups of two, and members with their hubs.
    Groups of one hub are taken as one from here on (gid is the hub): they share most members."""
    members = stored(groups.where("gid is not null").groupBy("gid", F.col("a").alias("cls")).agg(F.max("slack").cast("int").alias("slack")), "members", under)
    # the hub of a group is the member of most groups: an original shares more with each copy than two copies do
    weights = members.groupBy("cls").agg(F.count("*").alias("w"))
    hubs = members.join(weights, "cls").groupBy("gid").agg(F.max(F.struct("w", "cls")).alias("hub"), F.max(F.struct("slack", "cls")).alias("top"))
    placed = members.join(hubs, "gid").where("cls = top.cls or slack + top.slack >= 0").groupBy(F.col("hub.cls").alias("gid"), "cls").agg(F.max("slack").alias("slack"))
    placed = stored(placed, "placed", under)
    stars = placed.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    pairs = groups.where("gid is null").select("a", "b").unionByName(stars)
    return placed, stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs", under)


def _open(members: DataFrame, comp: DataFrame, classes: DataFrame, under: str) -> DataFrame:
    """gid, cls, slack, comp, n and g (the group's open members) of members whose slack meets that of a member of
    another component."""
    placed = members.join(comp, F.col("cls") == F.col("v"), "left").select("gid", "cls", "slack", F.coalesce("comp", "cls").alias("comp"))
    placed = stored(placed.join(classes.select("cls", "n"), "cls"), "placed", under)
    each = placed.groupBy("gid", "comp").agg(F.max("slack").alias("s"))
    top = each.groupBy("gid").agg(F.max(F.struct("s", "comp")).alias("t"), F.count("*").alias("comps")).where("comps > 1")
    next_ = each.join(top, "gid").where("comp <> t.comp").groupBy("gid", "t").agg(F.max("s").alias("u"))
    out = stored(placed.join(next_, "gid").where("slack + if(comp = t.comp, u, t.s) >= 0").select(placed.columns), "open", under)
    return out.join(out.groupBy("gid").agg(F.count("*").alias("g")), "gid")


def _alike_pairs(sized: DataFrame, outlines: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that their outlines do not rule out."""
    side = lambda x: outlines.select(F.col("cls").alias(x), "band", F.col("bits").alias(f"bits_{x}"))
    banded = sized.withColumn("band", F.floor(F.log2(F.greatest("n_a", "n_b").cast("double"))).cast("long"))
    return banded.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"]).select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_alike(PERCENT), "a long, b long")


def _rest(members: DataFrame, comp: DataFrame, classes: DataFrame, outlines: DataFrame, pairs: DataFrame, under: str) -> DataFrame:
    """Pairs of groups that hold several components yet, without those that were compared before. Each two blocks of a
    group meet once, in a run of rows of their own."""
    parts = int(comp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = _open(members, comp, classes, under)
    open_ = open_.withColumn("blocks", F.ceil(F.col("g") / BLOCK)).withColumn("at", F.pmod(F.xxhash64("cls", "gid"), "blocks"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other"), "side": F.col("at") > F.col("other")})
    key = ["gid", "i", "j"]
    runs = open_.withColumn("hub", F.col("gid")).select(*key, *MEMBER).repartition(parts, *key).sortWithinPartitions(*key)
    narrow = stored(runs.mapInArrow(_narrowed(PERCENT), NARROW_DDL), "narrow", under)
    few = narrow.where("a is not null").select("a", "b", "n_a", "n_b").distinct().join(pairs, ["a", "b"], "left_anti")
    key = [*key, "band"]
    rows = narrow.where("a is null").select(*MEMBER, *key[:3]).join(outlines.withColumnRenamed("cls", "_cls").drop("n"), F.col("cls") == F.col("_cls")).withColumn("own", F.col("band") == F.floor(F.log2(F.col("n").cast("double"))))
    runs = rows.select(*key, *MEMBER, "own", "bits").repartition(parts, *key).sortWithinPartitions(*key)
    many = runs.mapInArrow(_unsettled(PERCENT), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    return _alike_pairs(few, outlines).unionByName(many).distinct()


def _links(docs: DataFrame, found: DataFrame, under: str) -> DataFrame:
    """(v, comp) of the classes that have links."""
    members, pairs = _candidates(_grouped(docs, found, under), under)
    classes = stored(found.where("n > 0").join(_ends(pairs), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "candidates", under)
    side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    outlines = stored(_texts(docs, classes, under).mapInArrow(_outlines, "cls long, band long, bits binary").dropDuplicates(["cls", "band"]), "outlines", under)
    comp = stored(components(_verify(_alike_pairs(sized, outlines), classes, docs, under), under=under), "components", under)
    more = stored(_rest(members, comp, classes, outlines, pairs, under), "more", under)
    if more.isEmpty():
        return comp
    links = _verify(more, classes, docs, under)
    of = lambda x: comp.select(F.col("v").alias(x), F.col("comp").alias(f"comp_{x}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    last = stored(components(joined, under=under).select(F.col("v").alias("old"), F.col("comp").alias("new")), "components", under)
    all_ = comp.unionByName(last.select(F.col("old").alias("v"), F.col("old").alias("comp")).join(comp, "v", "left_anti"))
    return all_.join(last, F.col("comp") == F.col("old"), "left").select("v", F.coalesce("new", "comp").alias("comp"))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, comp, component_id of every row of docs: the class of its text, the component's least class (null
    where the text has no shingle) and the least doc_id. A table of these stays in the shared folder; all others of the
    run are dropped."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark) as under:
        found = stored(docs.mapInArrow(_scan, SCAN_DDL), "classes", under)
        inner = f"{under}/links"
        comp = stored(_links(docs, found, inner), "components", under)
        dropped(spark, inner)
        rows = found.where("sig is null").select("doc_id", "n", "cls")
        in_class = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(comp, F.col("cls") == F.col("v"), "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "least")
        least = in_class.groupBy("comp").agg(F.min("least").alias("component_id"))
        of = in_class.join(least, "comp").select(F.col("cls").alias("c"), "comp", "component_id")
        return stored(rows.join(of, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left").select("doc_id", "n", "cls", "comp", F.coalesce("component_id", "doc_id").alias("component_id")), "components-of")
