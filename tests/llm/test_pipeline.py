import numpy as np
import pytest

from test_joins_and_mixing import plain_components


def test_stages_on_given_documents(spark, data):
    import corpus_pipeline as P
    from gridlens.llm.common import materialize

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in P.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, data), f"test-{name}")
        kept.append(docs.count())
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            assert docs.join(before, columns, "left_semi").count() == kept[-1]
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {root for _, root in plain_components(rows).values()}
            assert {r.doc_id for r in docs.collect()} == want
    # the mix repeats documents, so rows may grow there; the stages before it only take rows away
    assert kept[:3] == sorted(kept[:3], reverse=True) and kept[4] == kept[3] > 0
    assert all(np.array(r.ids).size == r.n_tokens for r in docs.collect())


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_odd_rows(spark, data, odd_docs, no_docs, kind):
    import corpus_pipeline as P
    from gridlens.llm.common import materialize

    docs = odd_docs if kind == "odd" else no_docs
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, data), f"odd-{name}")
        assert docs.columns == odd_docs.columns
    last = P.STAGES[-1][1](spark, docs, data).collect()
    assert last == [] if kind == "none" else {r.doc_id for r in last} >= {1, 5, 6, 7} and all(r.n_tokens > 0 for r in last)


def test_run_gives_token_ids(spark, data):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0


def test_dropped_ids_and_cleared_files(spark, odd_docs):
    from pathlib import Path

    from gridlens.llm import common

    gone = spark.createDataFrame([(1,), (6,), (77,), (None,)], "doc_id long")
    kept = common.drop_ids(odd_docs, gone, "doc_id")
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd_docs.collect() if r.doc_id not in (1, 6))
    common.materialize(gone, "cleared")
    paths = [Path(p.removeprefix("file://")) for p in common._written]
    assert any(p.exists() for p in paths)
    common.clear_intermediates(spark)
    assert not any(p.exists() for p in paths) and not common._written
