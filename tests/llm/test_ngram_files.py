"""The files of the n-gram model: what is missing is an error, many ranges, few maps."""

import os

import numpy as np
import pytest

from castlake.llm import ngram_lm

SF = "/root/testdata/sf0.001"


def scores(docs, model):
    return sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in ngram_lm.score(docs, model).collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("order", [2, 3])
def test_missing_file_is_an_error(spark, docs, order):
    model = ngram_lm.fit(docs, order)
    assert set(model.stored) == ({"tokens", "pairs"} if order == 2 else {"tokens", "pairs", "grams3", "beside2", "beside3"})
    for kind, there in model.stored.items():
        files = {f for f in os.listdir(model.folder) if f.startswith(f"{kind}-") and f.endswith(".key")}
        assert files == {f"{kind}-{k}.key" for k in np.flatnonzero(there)}
    for kind in model.stored:
        k = int(np.flatnonzero(model.stored[kind])[0])
        path = f"{model.folder}/{kind}-{k}.key"
        os.rename(path, f"{path}.away")
        with pytest.raises(Exception, match="No such file"):
            ngram_lm.score(docs, model).collect()
        os.rename(f"{path}.away", path)
    assert len(scores(docs, model)) == docs.count()


def test_many_ranges_and_few_maps(spark, docs, monkeypatch):
    """1500 ranges, most without keys: the same scores; a worker holds as many arrays as MAPS says."""
    some = docs.where("doc_id % 20 = 0 and length(text) < 1500")
    want = scores(some, ngram_lm.fit(some))
    total = sum(len(r.text.encode()) for r in some.collect())
    monkeypatch.setattr(ngram_lm, "RANGE", total / 9_000)
    model = ngram_lm.fit(some)
    assert model.ranges >= 1_490
    assert scores(some, model) == want
    few = ngram_lm.Mapped(model)
    monkeypatch.setattr(ngram_lm, "MAPS", 5)
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    assert few.pairs(keys).sum() == 0 and len(few.files) <= 5
