"""The pipeline's stages by brute force on a small fixture, and as a whole."""

import collections

import pytest

import corpus_pipeline
from talus.llm import neardup, quality, toxicity
from talus.runtime import table


def test_order_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    columns = docs.columns
    clean = corpus_pipeline.toxicity_stage(spark, docs, sf)
    assert clean.columns == columns
    flagged = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert left == {r.doc_id for r in docs.collect()} - flagged
    good = corpus_pipeline.quality_stage(spark, clean, sf)
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality(clean).where("kept").collect()}
    single = corpus_pipeline.near_dedup_stage(spark, good, sf)
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in neardup.near_duplicates(good).where("kept").collect()}
    mixed = corpus_pipeline.mixing_stage(spark, single, sf)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}


def test_run_packs_whole_documents(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_leaves_no_document_out(spark, sf):
    docs = table(spark, sf, "documents")
    pieces = corpus_pipeline.packing_stage(spark, docs.unionByName(docs), sf).collect()
    ids = [r.doc_id for r in docs.collect()] * 2
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(ids)
    ends = collections.defaultdict(set)
    for r in pieces:
        ends[r.doc_id].add((r.piece, r.start, r.start + r.length))
    for parts in ends.values():
        at = 0
        for n, (piece, start, end) in enumerate(sorted(parts)):
            assert (piece, start) == (n, at)
            at = end


@pytest.mark.parametrize("stage", ["toxicity_stage", "quality_stage", "near_dedup_stage", "mixing_stage", "packing_stage"])
def test_stages_take_odd_rows(spark, docs_of, sf, stage):
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, "x " * 5000, None), (3, "one two three")])
    f = getattr(corpus_pipeline, stage)
    out = f(spark, docs, sf)
    assert out.count() >= 0 and f(spark, docs.where("false"), sf).count() == 0
    if stage != "packing_stage":
        assert out.columns == docs.columns


def test_one_row_of_a_repeated_id_stays(spark, docs_of, sf):
    t = " ".join(f"w{i}" for i in range(80))
    docs = docs_of([(1, t), (1, t), (1, "else " + t), (2, t), (3, "quite another text of a few words"), (None, t), (None, None)])
    out = corpus_pipeline.near_dedup_stage(spark, docs, sf)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None", "None"] and out.columns == docs.columns
