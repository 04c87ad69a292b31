import corpus_pipeline
from edge import documents, empty

from sunmelt.runtime import written_table


def test_stages_follow_each_other(spark):
    docs = documents(spark)
    seen = []
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        columns = docs.columns
        docs = written_table(stage(spark, docs, ""))
        seen.append(docs.count())
        if place < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert seen[:3] == [8, 6, 6] and seen[3] == seen[4] > 0
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_stages_of_an_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = written_table(stage(spark, docs, ""))
        assert docs.count() == 0
