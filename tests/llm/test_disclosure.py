"""Sanitisation of personal data beside a brute-force version, and on odd tables."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from castlake.llm import disclosure, queries

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def good(kind, t):
    digits = [int(c) for c in t if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [2 * d - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return True


def base(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(t) if good(k, m.group())]


def words(t):
    return [w for w in letters(low(t)) if 4 <= len(w) <= 40]


def letters(t):
    return re.findall(r"[^\W\d_]+", t)


def keys(ws):
    return set(ws) | {w[:3] + "*" for w in ws}


def beside(t, kind, start, end):
    """Terms beside a mention, within the gap to the next match (valid or not) of its kind and to the 200th character."""
    edges = [(m.start(), m.end()) for m in PLAIN[kind].finditer(t)]
    k = edges.index((start, end))
    before, behind = t[edges[k - 1][1] if k else 0 : start][-200:], t[end : edges[k + 1][0] if k + 1 < len(edges) else len(t)][:200]
    if len(before) == 200:
        before = re.sub(r"^[^\W\d_]+", "", before)
    if len(behind) == 200:
        behind = re.sub(r"[^\W\d_]+$", "", behind)
    return keys(words(before)[-5:] + words(behind)[:5])


def brute(texts):
    """Base spans and term spans of each text."""
    n_pair, seen, n_entity, n_key = defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(int)
    for t in texts:
        found = defaultdict(set)
        for kind, a, b in base(t):
            v = t[a:b] if kind == "ip" else low(t[a:b]) if kind == "email" else re.sub(r"[^0-9]", "", t[a:b])
            found[kind, v] |= beside(t, kind, a, b)
        for c, ks in found.items():
            n_entity[c] += 1
            for k in ks:
                n_pair[c, k] += 1
                seen[c, k].add(t)
        for k in keys(words(t)):
            n_key[k] += 1
    n, told = len(texts), set()
    for (c, k), x in n_pair.items():
        if len(seen[c, k]) >= 3 and n_entity[c] < n and math.log(x * n / (n_entity[c] * n_key[k])) / math.log(n / n_entity[c]) >= 0.9:
            told.add(k)
    out = []
    for t in texts:
        b, spans = base(t), []
        for m in re.finditer(r"[^\W\d_]+", t):
            w = low(m.group())
            if w in told and not any(x < m.end() and m.start() < y for _, x, y in b):
                spans.append((m.start(), m.end(), "" if w[:3] + "*" in told else w[:3] + "*"))
        out.append((b, spans))
    return out


def cut(t, b, spans):
    merged = []
    for s, e, put in sorted([(x, y, f"<{k}>") for k, x, y in b] + spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, put])
    out, at = "", 0
    for s, e, put in merged:
        out, at = out + t[at:s] + put, e
    return out + t[at:]


def found(df):
    return sorted(((r.doc_id, [tuple(x) for x in r.base], [tuple(x) for x in r.terms], r.sanitised) for r in disclosure.sanitised(df).collect()), key=repr)


def expected(rows):
    out = brute([t or "" for _, t in rows])
    return sorted(((i, b, s, cut(t or "", b, s)) for (i, t), (b, s) in zip(rows, out)), key=repr)


def mentions():
    """Neighbours that stand with one entity alone, with it and elsewhere, and with several."""
    rows = [(i, f"filler text number {i} with walking talking and Elsewhere words ä{i}") for i in range(60)]
    for i in range(100, 106):
        rows.append((i, f"Dear Quasimodo Belltower wrote from bob.x@mail.example.com today, walking {i} 😀 ends"))
    rows += [(i, f"call +1 (234) 555-01{i - 100} of Zanzibar walking {i} and 4111-1111 1111-1111") for i in range(110, 115)]
    rows += [(i, f"on {i} zanzibar came, with zandu and 10.0.0.{i - 115} or 10.0.0.256 by zante") for i in range(116, 120)]
    rows += [(120, "QUASIMODO without address"), (121, "Quasi modo"), (122, rows[61][1]), (122, rows[61][1])]
    rows += [(i, f"Zephyrine {i} 192.168.7.7 zephyrine Zephyrus") for i in range(130, 134)] + [(140, "zephyranthes zephyrines"), (141, "zephxx")]
    return rows


def test_terms(spark):
    df = spark.createDataFrame(mentions(), "doc_id long, text string").repartition(4)
    got, want = found(df), expected(mentions())
    assert got == want
    texts = {i: t for i, _, _, t in got}
    assert texts[120] == " without address" or texts[120].startswith("qua*")
    assert any(s for _, _, s, _ in got) and any(r == "" for _, _, s, _ in got for _, _, r in s) and any(r for _, _, s, _ in got for _, _, r in s)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (b, s) for (i, _), (b, s) in zip(rows, brute([t or "" for _, t in rows]))}
    got = queries.op13_disclosure(spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
    for r in got:
        b, s = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PLAIN]
        line = ",".join(f"{k}:{x}:{y}" for k, x, y in b)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert r.spans == ",".join([line] * bool(line) + [f"term:{x}:{y}" for x, y, _ in s])


def test_patterns(spark):
    """Matches that touch, that are cut short, that fail and are not tried again."""
    texts = [
        "a@b", "a@b@c.d", "a@b.c%d@e.f", "x@y.z@w.v.", ".@a.b", "a@b..c", "a@-.-", "é@a.b é.x@a.bé",
        "1.2.3.4.5", "1.2.3.45.6.7.8", "256.1.1.1", "0000255.1.1.1.1", "1.1.1.1.1.1.1.1", "1..2.3.4", "99999999999999999999.1.1.1",
        "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111112", "0000000000000", "00000000000000000000", "7-9 4111111111111111",
        "+1 (234) 555-0123", "+1+1 234 555 0123", "+12345678", "+123456789", "+1 ( ) .", "+1234567890123456", "+1 10.0.0.1 4111111111111111 9", "+4 4111111111111111",
        "😀 a@b.c 😀😀 10.0.0.1", "10.0.0.1\n10.0.0.2\r\n+1 234 555 0123 x@y.z",
    ]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_odd(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a@b.c"), (4, "a@b.c"), (4, "a@b.c")]
    df = spark.createDataFrame([(*r, 1, "x", 2, "z") for r in rows], "doc_id long, text string, copy int, base string, row int, term string")
    assert found(df) == expected(rows)
    assert found(df.limit(0)) == []
    long = [(1, "a" * 300_000), (2, "7" * 300_000), (3, "+" + "1 " * 150_000), (4, "1.1.1.1 " * 20_000), (5, "x@y" + ".z" * 100_000), (6, "a@" * 100_000), (7, "1." * 100_000), (8, "word " * 60_000 + "me@home.org")]
    got = {r.doc_id: r for r in disclosure.digests(disclosure.sanitised(spark.createDataFrame(long, "doc_id int, text string"))).collect()}
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(1, 9)] == [(0, 0, 0, 0)] * 3 + [(0, 20_000, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (0, 25_000, 0, 0), (1, 0, 0, 0)]
    assert got[8].spans == "email:300000:300011"


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_running(spark, n):
    df = spark.createDataFrame([([(k * 7919) % 101 for k in range(n)],)], "a array<long>")
    sums, most = df.select(disclosure.running(F.col("a"), lambda a, b: a + b), disclosure.running(F.col("a"), lambda a, b: F.greatest(a, b))).first()
    a = df.first().a
    assert (sums, most) == ([sum(a[: k + 1]) for k in range(n)], [max(a[: k + 1]) for k in range(n)])


def test_large_lists_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(disclosure, "BROADCAST", -1)
    df = spark.createDataFrame(mentions(), "doc_id long, text string")
    assert found(df) == expected(mentions())
