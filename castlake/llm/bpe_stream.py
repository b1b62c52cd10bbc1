"""BPE as a bounded-lookahead streaming transducer, and decoding by an incremental byte-to-text state machine.

A text is normalised (NFC, lower case) and cut into pieces: contractions, runs of letters, single numbers, runs of other
signs. A piece is a string of byte symbols, the last of which carries the word's end. Merges go by rank, the leftmost
first.

Lookahead. What follows a symbol can change its token only through a chain of merges: a merge (u, v) takes u away from
a later merge (x, u), which then frees x for a still later merge (y, x), and so on to the left, each of higher rank.
The longest such chain in the merge list, found in one pass over the list from its end, times the longest token, bounds
how far a change can reach. The transducer therefore keeps a window of symbols, encodes it, and emits the tokens that
end at least that many symbols before the window's end: they are stable. Encoding goes on from there, since what BPE
gives for a text that begins at a token's border is the rest of what it gives for the whole. A piece of any length is
encoded in constant memory, and ids are hashed and decoded CHUNK at a time as they appear; pieces that fit a window are encoded at once and remembered in a table of bounded size.

Decoding feeds ids one after another: a token's bytes go through a UTF-8 automaton that holds at most three pending
bytes and gives U+FFFD for what is not UTF-8. As the vocabulary file names no decoder, the text is the tokens' names
with a space between two (mode "names"); mode "text" turns them back into bytes and word ends into spaces.

Defined results: null is the empty text, with no ids and an empty decoded text; the names of special tokens in a text
are those tokens; repeated rows and ties have no influence; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ready

#: The white space of the vocabulary's pattern, and its contractions.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
#: Letters and numbers that Unicode 16 added (first and last of each range), for older tables.
LETTERS_16 = "1c89 1c8a a7cb a7cd a7da a7dc 105c0 105f3 10d4a 10d65 10d6f 10d85 10ec2 10ec4 11380 11389 1138b 1138b 1138e 1138e 11390 113b5 113b7 113b7 113d1 113d1 113d3 113d3 11bc0 11be0 13460 143fa 16100 1611d 16d40 16d6c 18cff 18cff 1e5d0 1e5ed 1e5f0 1e5f0"
NUMBERS_16 = "10d40 10d49 116d0 116e3 11bf0 11bf9 16130 16139 16d70 16d79 1ccf0 1ccf9 1e5f1 1e5fa"
#: Lower case that Unicode 16 and 17 added: first, last, distance to the lower-case letter.
LOWER_NEW = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
REMEMBERED = 250_000  # pieces of a generation of the table; two are held
CHUNK = 1 << 16


def _class(first: str, more: str) -> str:
    """The code points whose category begins with this letter, and more, as ranges of a character class."""
    ends = more.split()
    out, begin = [f"\\U{a:0>8}-\\U{b:0>8}" for a, b in zip(ends[::2], ends[1::2])], None
    for c in range(sys.maxunicode + 2):
        own = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == first
        if own and begin is None:
            begin = c
        elif not own and begin is not None:
            out.append(f"\\U{begin:08x}-\\U{c - 1:08x}")
            begin = None
    return "".join(out)


@lru_cache(1)
def pattern() -> re.Pattern:
    letters, numbers = _class("L", LETTERS_16), _class("N", NUMBERS_16)
    return re.compile(f"[{letters}]+|[{numbers}]|{CONTRACTIONS}|[^{WHITE}{letters}{numbers}]+")


ASCII = re.compile(f"[a-z]+|[0-9]|{CONTRACTIONS}|[^\t-\r a-z0-9]+")
NEW_CASE = {c: c + by for a, b, by in LOWER_NEW for c in range(a, b + 1)}
RARE = re.compile("[\u03a3" + "".join(map(chr, NEW_CASE)) + "]")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: itself if it is printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def normalised(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    if RARE.search(text):  # a capital sigma has the same lower case at a word's end
        return "".join(c.lower() for c in text.translate(NEW_CASE))
    return text.lower()


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        end = file["model"]["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        signs = byte_signs()
        self.end = end
        self.inner = [vocab[signs[b]] for b in range(256)]
        self.last = [vocab[signs[b] + end] for b in range(256)]
        self.merge = {(vocab[a] << 20 | vocab[b]): (rank << 20 | vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for name, i in [*vocab.items(), *self.special.items()]:
            names[i] = name
        self.names = names
        self.longest = max(len(x.removesuffix(end)) for x in vocab)
        self.length = [len(x.removesuffix(end)) for x in names]
        self.chain = self._chain([(vocab[a], vocab[b]) for a, b in merges])
        self.lookahead = (self.chain + 1) * self.longest
        self.window = 4 * self.lookahead
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _chain(merges: list[tuple[int, int]]) -> int:
        """The most merges, each later than the one before, of which each takes what the one before has as its left."""
        longest: dict[int, int] = {}
        most = 0
        for left, right in reversed(merges):
            n = 1 + longest.get(left, 0)
            longest[right] = max(longest.get(right, 0), n)
            most = max(most, n)
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a window, by rank, the leftmost first."""
        get = self.merge.get
        none = 1 << 62
        if len(ids) > 48:
            return self._merged_long(ids)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list."""
        from heapq import heapify, heappop, heappush

        get, n = self.merge.get, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m >> 20, i, ids[i], ids[i + 1], m & 0xFFFFF) for i in range(n - 1) if (m := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := get(ids[x] << 20 | ids[y])) is not None:
                    heappush(heap, (m >> 20, x, ids[x], ids[y], m & 0xFFFFF))
        return [x for x in ids if x >= 0]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of a piece's symbols (the last one carries the end), each as soon as it is stable."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.window:
                stable, done = len(held) - self.lookahead, 0
                for token in self.merged(held[:]):
                    if done + self.length[token] > stable:
                        break
                    done += self.length[token]
                    yield token
                del held[:done]
        yield from self.merged(held)

    def piece(self, text: str) -> bytes:
        """Ids of a piece that fits a window, as little-endian 32-bit integers."""
        found = self.old.get(text)
        if found is None:
            raw = text.encode()
            ids = [self.inner[b] for b in raw]
            ids[-1] = self.last[raw[-1]]
            found = b"".join([i.to_bytes(4, "little") for i in self.merged(ids)])
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[text] = found
        return found

    def _long(self, text: str) -> Iterator[bytes]:
        """The same of a longer piece, by the transducer, CHUNK ids at a time."""
        raw = text.encode()
        last = len(raw) - 1
        ids = self.stream(self.inner[b] if i < last else self.last[b] for i, b in enumerate(raw))
        while part := list(islice(ids, CHUNK)):
            yield np.array(part, "<u4").tobytes()

    def chunks(self, text: str) -> Iterator[bytes]:
        """A text's ids, some CHUNK at a time, as they become stable."""
        for x in self.cut.split(text) if "<|" in text else (text,):
            if x in self.special:
                yield self.special[x].to_bytes(4, "little")
            elif x:
                yield from self._plain(x)

    def encode(self, text: str) -> bytes:
        return b"".join(self.chunks(text))

    def _plain(self, text: str) -> Iterator[bytes]:
        text = normalised(text)
        cut = ASCII if text.isascii() else pattern()
        out, size = [], 0
        get = self.young.get
        for w in cut.findall(text) if len(text) <= CHUNK else (m.group() for m in cut.finditer(text)):
            ids = get(w)
            if ids is None:
                if len(w) * 4 >= self.window and len(w.encode()) >= self.window:
                    yield b"".join(out)
                    out, size = [], 0
                    yield from self._long(w)
                    continue
                ids = self.piece(w)
                get = self.young.get
            out.append(ids)
            size += len(ids)
            if size >= 4 * CHUNK:
                yield b"".join(out)
                out, size = [], 0
        yield b"".join(out)


class Decoder:
    """Ids to text, piece by piece; the state is a pending space and at most three pending bytes."""

    def __init__(self, transducer: Transducer, mode: str = "names"):
        self.mode = mode
        back = {sign: b for b, sign in byte_signs().items()}
        if mode == "names":
            self.table = [x.encode() for x in transducer.names]
        else:
            end = transducer.end
            special = set(transducer.special)
            self.table = [x.encode() if x in special else bytes(back[c] for c in x.removesuffix(end)) + b" " * x.endswith(end) for x in transducer.names]
        self.reset()

    def reset(self) -> None:
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int], last: bool = False) -> str:
        between = b" " if self.mode == "names" else b""
        raw = between.join(map(self.table.__getitem__, ids))
        if self.begun and ids:
            raw = between + raw
        self.begun = self.begun or bool(ids)
        return self.utf8.decode(raw, last)


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


@lru_cache(2)
def decoder(path: str, mode: str = "names") -> Decoder:
    return Decoder(transducer(path), mode)


def round_trip(text: str, path: str, mode: str = "names") -> tuple[np.ndarray, str]:
    """A text's ids, and what they decode to."""
    ids = np.frombuffer(transducer(path).encode(text), "<u4")
    d = decoder(path, mode)
    d.reset()
    return ids, d.feed(ids.tolist(), True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs; path: the vocabulary file, on every worker."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = transducer(path), decoder(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n, sha, back = [], [], []
                for text in part["text"].to_pylist():
                    size, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                    dec.reset()
                    for raw in enc.chunks(text or ""):
                        size += len(raw) // 4
                        ids.update(raw)
                        decoded.update(dec.feed(np.frombuffer(raw, "<u4").tolist()).encode())
                    decoded.update(dec.feed([], True).encode())
                    n.append(size)
                    sha.append(ids.hexdigest())
                    back.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
