"""Every stage of the pipeline on odd tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the of and to in is that for on was as with be by this are or an it at from "
ROWS = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (3, "  \n ", "en", "s", 3), (4, LINE, "en", "s", 1), (4, LINE, "en", "s", 1), (5, LINE + "more", "en", "s", 1), (None, LINE.upper() + " x", "en", "s", 1),
    (6, "1234 !!", "de", "s", 1), (7, "x" * 100_000, "en", "s", 1), (8, " ".join(f"word{k}" for k in range(20_000)), "en", "s", 1), (10, LINE * 2000, "en", "s", 1), (9, "ÀÉ ß 中文 😀", "de", "s", 1), (9, "eine andere Zeile mit Wörtern", "de", "s", 1),
]


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows_pass_all_stages(spark, clash):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    if clash:
        for name in ("score", "cls", "n", "row", "comp", "told", "copy"):
            docs = docs.selectExpr("*", f"'{name}' AS {name}")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        kept = [tuple(r) for r in after.collect()]
        held = [tuple(r) for r in before.collect()]
        assert all(held.count(r) >= kept.count(r) for r in kept), name  # a stage takes rows away and changes none
        before = spark.createDataFrame(kept, docs.schema)
    ids = sorted(str(r[0]) for r in map(tuple, before.collect()))
    assert ids == sorted(["4", "7", "8", "9", "9", "None"])  # texts with letters; 10 has 20 different shingles, 16 of them those of 4
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert sorted(str(r.doc_id) for r in out.collect()) == ids and out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
