"""A benchmark of many parts gives what one of a single part gives; odd rows of clean()."""

import pytest

from castlake.llm import decontam

SF = "/root/testdata/sf0.001"


def found(docs, benchmark):
    return sorted((tuple(r) for r in decontam.contaminated(docs, benchmark).collect()), key=repr)


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(decontam, "SIEVE_BITS", 20)

    def parts(size):
        monkeypatch.setattr(decontam, "ITEM_BYTES", size)

    return parts


def test_parts(spark, small):
    docs, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, kept = found(docs, benchmark), sorted(r.doc_id for r in decontam.clean(docs, benchmark).collect())
    assert whole
    for size in (3000, 100):  # the second: an item is a part of its own
        small(size)
        assert decontam._parts(decontam._known(benchmark)) > 1
        assert all(len(rows) == 1 or sum(len(t.encode()) for _, t in rows) <= size for rows in decontam._items(decontam._known(benchmark), 5))
        assert found(docs, benchmark) == whole
        out = decontam.clean(docs, benchmark)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == kept


def test_sieve_keeps_all_that_is_found(spark, small):
    """Items of all lengths, with edits, at the ends of rows; short ones go by shorter grams."""
    items = ["ab", "cat dog", "nine sign", "a tenth one", "twenty signs or so it", "thirty signs and some more words", "a long item with many words that goes on and on until it has about a hundred signs or a few more"]
    rows = [(1, "Ab"), (2, "xx cat-dog"), (3, "nine sign"), (4, "here a TENTH one"), (5, "twenty signs or so it. x"), (6, "y thirty signs end some more words"), (7, items[6].replace("many", "mny") + " z"), (8, "nothing of it"), (9, None), (10, ""), (None, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(3, items[3]), (None, "ab"), (9, None), (8, "")], "item_id long, text string")
    whole = found(docs, benchmark)
    assert {(d, i) for d, i, *_ in whole} >= {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6), (None, 0)}
    small(20)
    assert sorted(found(docs, benchmark), key=repr) == sorted(whole, key=repr)


def test_clean_on_odd_rows(spark, small):
    benchmark = spark.createDataFrame([(1, "the whole of this sentence is an item of the benchmark")], "item_id long, text string")
    leak = "so The whole of this, sentence is an item of the benchmark!"
    rows = [(1, leak, 1), (1, leak, 1), (1, "fine", 2), (2, None, 3), (None, leak, 4), (None, "fine", 5), (3, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long")
    want = sorted([r for r in rows if r[1] != leak], key=repr)
    assert sorted((tuple(r) for r in decontam.clean(docs, benchmark).collect()), key=repr) == want
    small(10)
    assert sorted((tuple(r) for r in decontam.clean(docs, benchmark).collect()), key=repr) == want
    assert decontam.clean(docs.limit(0), benchmark).count() == 0 and decontam.clean(docs, benchmark.limit(0)).count() == len(rows)
