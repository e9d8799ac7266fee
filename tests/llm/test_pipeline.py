from __future__ import annotations

import pytest

import corpus_pipeline
from ledgerweave.llm import packing, pii, toxicity


def test_stages_take_effect_in_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 0").collect()}
        if name == "simhash_near_dedup":
            from .test_near_copies import brute_kept

            assert sorted(r["doc_id"] for r in docs.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in before.collect()])
        if name == "suffix_array_dedup":
            from .test_repeats import brute

            lost = {r[0]: r[2] for r in brute([(r["doc_id"], r["text"]) for r in before.collect()])}
            short = {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}
            full = {r["doc_id"]: len(r["text"].encode()) for r in before.collect()}
            assert all(full[i] - lost[i] - 8 * (lost[i] > 0) <= short[i] <= full[i] - lost[i] for i in full)
        if name == "pii":
            assert not any(pii.base_spans(r["text"]) for r in docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
        seen.append(docs.count())
    assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} and packing.SIZE == 4096
    assert seen[1] <= seen[0] and seen[2] <= seen[1]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_empty_and_odd_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id double, _kd long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, None, None, None, None, 1.0, 2), (1, None, None, None, None, 1.0, 2), (None, "", "en", "s", 0, None, None), (None, "a b c", None, "s", 5, 0.0, 1), (2, "w " * 3000, "en", "s", 6000, 0.0, 1)]
    for name, given in (("odd", rows), ("none", [])):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (3 if name == "odd" else 0)  # null and empty texts are copies


@pytest.fixture(autouse=True)
def _checkpoints(spark, tmp_path):
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
