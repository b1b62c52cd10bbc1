"""Hard negatives beside a brute-force search and SQL, and on odd tables."""

import math
import random

import duckdb
import pytest

from castlake.llm import negatives, oracles, queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def brute(rows, modulus, least=50, most=95, positives=5, negatives=3):
    """rows: (vec_id, label, whole numbers); each is a row of its own."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if i % modulus:
            continue
        scored = sorted((-dot(v, w), j, same == label) for m, (j, same, w) in enumerate(rows) if m != k)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and least * -s <= 100 * -x[0] <= most * -s]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_same_as_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    expected = sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracles.NEGATIVES})").fetchall())
    assert rows_of(queries.op12_hard_negatives(spark, f"/root/testdata/{sf}")) == expected and expected


def clustered(seed, n=700, dim=9):
    """Clusters of one label, of copies and of mixed labels; some vectors are short, some negative, some zero."""
    rnd = random.Random(seed)
    middles = [[rnd.randint(-300, 300) for _ in range(dim)] for _ in range(12)]
    out = []
    for i in range(n):
        m = rnd.choice(middles)
        v = [x + rnd.randint(-8, 8) for x in m] if rnd.random() < 0.6 else list(m)
        out.append((i, rnd.choice([0, 1, 1, 7]), v[: rnd.choice([0, 3, dim])] if rnd.random() < 0.1 else v))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_clusters_and_copies(spark, seed):
    """Brackets pass whole blocks and rows over here; the result is that of the brute force. Anchors come in two groups."""
    rows = clustered(seed)
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").repartition(5)
    assert rows_of(negatives.hard_negatives(df, 10)) == brute(rows, 10)
    assert rows_of(negatives.hard_negatives(df, 10, group=50)) == brute(rows, 10)
    assert rows_of(negatives.hard_negatives(df, 50, positives=2, negatives=9, least=10, most=100)) == brute(rows, 50, 10, 100, 2, 9)


def test_brackets_hold(spark, tmp_path):
    """Every score lies in its bracket, and clustered rows are passed over."""
    df = spark.createDataFrame(clustered(5, 3000), "vec_id long, label long, v array<long>")
    blocks, table = negatives.indexed(df, f"file://{tmp_path}")
    total = passed = 0
    for batch in blocks.toArrow().to_batches():
        for ids, _, _, v, d in negatives._unpacked(batch):
            q = v[ids % 50 == 0].astype(float)
            dq = table.distances(negatives.np.concatenate([q, negatives.np.zeros((len(q), 1))], axis=1))
            score, square = q @ v.T.astype(float), (q * q).sum(1)[:, None]
            gap, both = abs(dq[:, :, None] - d[:, None]).max(0), (dq[:, :, None] + d[:, None]).min(0)
            high, low = (square + table.most - gap**2) / 2, (square + table.most - both**2) / 2
            assert (low - table.slack <= score).all() and (score <= high + table.slack).all()
            total += score.size
            passed += int((high < negatives.np.sort(score, axis=1)[:, -5:-4]).sum())
    assert passed > total / 3


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (3, 2, [0.75, 0.25]), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [nan, 1.0]), (None, 2, [1.0, 1.0]), (8, 2, [1.0, None]), (9, 2, [-inf, 0.0]), (50, 3, []), (100, 4, [0.5]), (11, 4, [-1.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "vec_id int, label int, embedding array<float>, row long, rank int, slot int, anchor string")
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    plain = [(i, y, [math.floor(256 * x) for x in v] + [0] * (2 - len(v))) for i, y, v in rows if i is not None and y is not None and ok(v)]
    got = rows_of(negatives.hard_negatives(negatives.scaled(df, 256), 50))
    assert got == brute(plain, 50)
    assert {r[:4] for r in got} >= {(0, 0, 1, 2), (0, 0, 2, 3), (0, 1, 1, 2)}  # the copy of an anchor is its positive
    assert rows_of(negatives.hard_negatives(negatives.scaled(df.limit(0), 256), 50)) == []
    assert rows_of(negatives.hard_negatives(negatives.scaled(df.where("vec_id in (1, 2)"), 256), 50)) == []
    assert rows_of(negatives.hard_negatives(negatives.scaled(df.where("vec_id = 50"), 256), 50)) == []
    with pytest.raises(ValueError, match="below"):
        negatives.hard_negatives(negatives.scaled(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>"), 256), 50)
