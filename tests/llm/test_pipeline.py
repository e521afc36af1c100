"""The pipeline's stages: what each decides takes effect, and what it should not touch stays."""

import corpus_pipeline as pipeline
from cardwarden.llm.near_dedup import near_duplicates
from cardwarden.llm.words import read_table


def test_stages(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").cache()
    labels = read_table(spark, sf_dir, "labels")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "mixing"]
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = pipeline.materialize(stage(spark, before, sf_dir), f"test-{name}")
        assert after.columns == docs.columns and after.count() <= before.count()
        if name == "near_dedup":
            kept = {r.doc_id for r in near_duplicates(before, size=5).where("kept").collect()}
            assert kept == {r.doc_id for r in after.select("doc_id").collect()}
            assert near_duplicates(after, size=5).where("not kept").count() == 0
        if name == "substring_dedup":
            assert after.count() == before.count()
            assert after.where("n_chars <> length(text)").count() == 0
        if name == "decontamination":
            items = [r.text for r in read_table(spark, sf_dir, "benchmark").collect()]
            texts = [r.text for r in after.select("text").collect()]
            assert not any(i in t for i in items for t in texts)
        before = after
    last = pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert last.count() == before.count() and last.where("rate < 0").count() == 0
    assert labels.count() > 0
