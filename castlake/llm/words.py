"""Words and word hashes of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A block is a run of rows whose texts are taken together: data (their bytes, A-Z lower-cased) and offs (where each row
begins and ends). A word's hash is a polynomial over its bytes modulo 2^64, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LIMIT = 1 << 19

#: ASCII white space: x20 and x09 to x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
#: Letters, digits and all bytes of other scripts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, LIMIT + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = []
        for b in (_BASE, inverse):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _POWERS.append(np.multiply.accumulate(a))
    return _POWERS[0][:n], _POWERS[1][:n]


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = LIMIT, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offs) of blocks of limit bytes, or of one longer text. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    offs = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        part = data[offs[i] : offs[j]]
        yield i, j, LOWER[part] if lower else part, offs[i : j + 1] - offs[i]
        i = j


def spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes that are true in word), and where each row's words begin and end."""
    b = word[data]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = b[:-1]
    before[edge] = False
    starts = np.flatnonzero(b & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = b[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(b & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any range of data is taken."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(len(data))[0], out=out[1:])
    return out


def hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges starts..ends; equal bytes have equal hashes, in any block."""
    h = (total[ends] - total[starts]) * _powers(len(total))[1][starts]
    return mixed(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n successive word hashes (len(h) - n + 1 of them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = 1
    for i in range(n):
        factor = factor * 0xA24BAED4963EE407 % (1 << 64)
        out += h[i : i + m] * U(factor)
    return mixed(out)


def one_hash(h: np.ndarray) -> int:
    """A hash of a whole sequence of word hashes, whatever its length."""
    return int(grams(h, len(h))[0]) if len(h) else 0
