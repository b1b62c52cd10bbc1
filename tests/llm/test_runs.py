"""Periodic runs beside a brute-force search, and on odd tables."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from castlake.llm import queries, runs
from castlake.llm.words import blocks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, shortest=12):
    """start, length, period: every stretch for every period, the least period of each."""
    least = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(shortest, 2 * p):
                least.setdefault((s, i + p), p)
            i += i == s
    return sorted((s, e - s, p) for (s, e), p in least.items())


def collapsed(w, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_blocks(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(60):
        n, letters = rnd.choice([0, 1, 5, 30, 150]), "abcdefghijklmnopqrstuvwxyz"[: rnd.choice([1, 2, 3, 20])]
        w = [rnd.choice(letters) for _ in range(n)]
        if n > 20 and rnd.random() < 0.5:
            p, s = rnd.randint(1, n // 3), rnd.randint(0, n - 1)
            w = [w[s + (i - s) % p] if i >= s and s + (i - s) % p < n else w[i] for i in range(n)]
        texts.append(w)
    done = 0
    for i, j, data, offs in blocks(pa.array(["  ".join(w) for w in texts]), limit=2000, lower=False):
        for shortest in (2, 12):
            counts, found, _, out = runs._block(data, offs, shortest)
            for k, w in enumerate(texts[i:j]):
                expected = brute(w, shortest)
                assert [tuple(map(int, x[1:])) for x in found if x[0] == k] == expected
                assert (int(counts[k]), out[k].as_py()) == (len(w), collapsed(w, expected))
        done += j - i
    assert done == len(texts)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert set(got) == set(texts)
    with_runs = 0
    for i, t in texts.items():
        w = planted(i, WORD.findall(t or ""))
        if len(w) > 2500:  # the brute force is quadratic; test_odd has long texts
            continue
        found = brute(w)
        with_runs += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
    assert with_runs > 10


def test_odd(spark):
    line = "the of and to in is that for on was as with"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, f"{line} {line}"), (5, f"{line} {line}"), (None, f"{line}\n{line}"), (6, f"{line} {line.upper()}"), (7, "ß " * 12), (8, "x" * 200_000), (9, "so " * 100_000), (10, ("é " * 3 + "y ") * 30_000)]
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, n_words int, runs long, collapsed string")
    got = runs.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    of = lambda i: [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got if r.doc_id == i]
    assert of(1) == of(2) == of(3) == [(0, [], "")]
    assert of(4) == [(1, [], "a")]
    assert of(5) == [(24, [(0, 24, 12)], line)] * 2 and of(None) == [(24, [(0, 24, 12)], line)]
    assert of(6) == [(24, [], f"{line} {line.upper()}")]
    assert of(7) == [(12, [(0, 12, 1)], "ß")]
    assert of(8) == [(1, [], "x" * 200_000)]
    assert of(9) == [(100_000, [(0, 100_000, 1)], "so")]
    assert of(10) == [(120_000, [(0, 120_000, 4)], "é é é y")]
    assert runs.digests(runs.periodic_runs(docs.limit(0))).count() == 0
    assert spark.createDataFrame([(1, f"{line} {line}", 3)], "doc_id int, body string, text int").transform(lambda d: runs.periodic_runs(d, "body")).first().n_words == 24


def test_short_runs_can_be_asked_for(spark):
    docs = spark.createDataFrame([(1, "no no yes yes yes a b a b")], "doc_id long, text string")
    assert [tuple(r) for r in runs.periodic_runs(docs, shortest=2).first().runs] == [(0, 2, 1), (2, 3, 1), (5, 4, 2)]
