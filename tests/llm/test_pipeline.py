"""The pipeline's stages, one after the other, against the operators' own results."""

import corpus_pipeline
from cropframe.llm import packing
from cropframe.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "line_dedup", "simhash", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality":
            assert sum(labels[d]["quality"] for d in gone if d in labels) <= 0.05 * len(labels)
        if name == "line_dedup":
            assert set(after) == set(before)
            assert any(after[d] != before[d] for d in after)
        elif name != "simhash":
            assert all(after[d] == before[d] for d in after)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == set(before)


def test_run_ends_in_pieces(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [c.split()[0] for c in packing.PIECES.split(", ")]
    assert got.count() > 0


def test_odd_and_no_documents_pass_all_stages(spark, odd_docs, no_docs):
    """Nulls, empty, repeated and very long texts, repeated ids and clashing columns; then an empty table."""
    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        columns, kept = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES:
            before = kept.count()
            kept = staged(stage(spark, kept, sf), "odd-" + name)
            if name != "packing":
                assert kept.columns == columns and kept.count() <= before, name
            if docs is no_docs:
                assert kept.count() == 0, name
            if name == "simhash":
                ids = [r[0] for r in kept.select("doc_id").collect()]
        if docs is odd_docs:
            pieces = kept.collect()
            assert {r["doc_id"] for r in pieces} == set(ids) and len(ids) > 20
            assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)
