"""The pipeline's stages, each on what the one before it kept."""

import collections

import corpus_pipeline
from sparkcollide.session import cut_lineage, table
from tests.llm.test_operators import shingles


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    held = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf), name)
        held[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
    count = {k: v.count() for k, v in held.items()}
    assert count["documents"] >= count["toxicity"] > count["jaccard_join"] == count["substring_dedup"] == count["secret_scan"]
    before = {r["doc_id"]: shingles(r["text"]) for r in held["toxicity"].collect()}
    left = {r["doc_id"] for r in held["jaccard_join"].collect()}
    for i in set(before) - left:  # every dropped document is near one that is left, or near one that is near it
        assert any(100 * len(before[i] & before[j]) >= 75 * len(before[i] | before[j]) for j in before if j < i)
    places = collections.defaultdict(int)
    for r in held["best_fit_packing"].collect():
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 4096
    assert {r["doc_id"] for r in held["best_fit_packing"].select("doc_id").collect()} == left
    assert corpus_pipeline.ORACLE_SQL is None
