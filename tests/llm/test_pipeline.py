"""The corpus pipeline: shapes of stages, and each stage against a plain version."""

import corpus_pipeline as cp
from runledger.llm import decontaminate, langid, linededup, pieces, simhash


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(cp.STAGES) == 5
    before = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = cp.through_parquet(stage(spark, docs, sf_dir), "t")
        assert out.columns == docs.columns, name
        if name == "language":
            assert out.count() >= 0.99 * before
        elif name == "line dedup":
            assert out.count() == docs.count()
            assert linededup.removed_lines(docs).count() > 0
            assert sum(len(r["text"]) for r in out.collect()) < sum(len(r["text"]) for r in docs.collect())
        elif name.startswith("simhash"):
            groups = {r["component_id"] for r in simhash.contract(docs).collect()}
            assert {r["doc_id"] for r in out.collect()} == groups
        else:
            bench = cp.table(spark, sf_dir, "benchmark")
            bad = {r["doc_id"] for r in decontaminate.contract(docs, bench).where("contaminated").collect()}
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
        docs = out
    last = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(last) == len(texts) and all(r["ids"] == sp.encode(texts[r["doc_id"]]) + [2] for r in last)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert langid.accepted(none, langid.fit_on(none)).count() == 0
