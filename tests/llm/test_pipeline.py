"""The pipeline on a small fixture, against plain Python where its stages are exact."""

import importlib.util

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline(spark):
    import corpus_pipeline as c
    from test_exact import WORD, brute_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in c.STAGES:
        seen.append(c.materialize(stage(spark, seen[-1], SF), name.replace(" ", "-")))
    for x in seen[1:-1]:
        assert x.columns == docs.columns
    before, after = [r for r in seen[2].orderBy("doc_id").collect()], {r.doc_id for r in seen[3].collect()}
    want = brute_components([r.text for r in before], 5, 80)
    assert after == {before[i].doc_id for i in set(want)}
    words = sum(len(WORD.findall(r.text)) for r in seen[4].collect())
    assert sum(r.n_words for r in seen[5].collect()) == words > 0
    assert c.run(spark, SF).count() == seen[5].count()
