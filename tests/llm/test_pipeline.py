import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline as cp
from plansight.llm import apportion, decontaminate, knn_quality, near_dup
from plansight.session import BATCH_BYTES

from ..conftest import SMALL


def test_stages_do_what_their_operators_say(spark):
    docs = cp.table(spark, SMALL, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.written(stage(spark, docs, SMALL), cp.run_folder(spark, "stage"))
        assert docs.columns[:len(columns)] == columns
        kept[name] = [r["doc_id"] for r in docs.collect()]
        old = [r["doc_id"] for r in before.collect()]
        assert set(kept[name]) <= set(old)
        if name == "quality classifier":
            scored = knn_quality.report(before, cp.table(spark, SMALL, "labels")).collect()
            assert sorted(kept[name]) == sorted(r["doc_id"] for r in scored if r["predicted"])
        if name == "near duplicates":
            sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if (w := rows[i]["text"].encode().lower().split()) else set() for i in old}
            for i in set(old) - set(kept[name]):  # what goes resembles something
                assert any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for j, s in sets.items() if j != i and s)
            for a, i in enumerate(kept[name]):  # what stays resembles nothing else that stays
                assert not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in kept[name][:a] if sets[j])
        if name == "decontamination":
            hit = {r["doc_id"] for r in decontaminate.report(before, cp.table(spark, SMALL, "benchmark")).collect()}
            assert set(old) - set(kept[name]) == hit
        if name == "mix sources":
            taken = {r["doc_id"]: r["taken"] for r in apportion.mix_report(before).collect()}
            words = {}
            for r in docs.collect():
                words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
            assert words == {k: v for k, v in taken.items() if v}
    for s in range(16):
        slots = sorted(r["slot"] for r in docs.collect() if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_and_empty_documents(spark, docs_of):
    assert cp.run(spark, SMALL).count() > 0
    docs = docs_of([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
    assert near_dup.components(docs_of([]), 5).count() == 0


def test_all_stages_send_texts_in_small_batches(spark, tmp_path, monkeypatch):
    """A stage's Python functions get 30 texts of 1 MB in several batches, not in one."""
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    spark.range(0, 30, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 1000000) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(cp, "STAGES", [("sizes", lambda spark, docs, sf_dir: docs.select(size("text").alias("n")))])
    before = spark.conf.get(BATCH_BYTES)
    assert cp.run(spark, str(tmp_path)).agg(F.max("n")).first()[0] < 2 * cp.GROUP_BYTES
    assert spark.conf.get(BATCH_BYTES) == before
