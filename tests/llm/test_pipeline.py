from collections import Counter

import corpus_pipeline
from strayline.llm import bpe_dp, quality_pu, simhash_bk
from strayline.llm.common import stored
from strayline.llm.queries import TOKENIZER

from .test_dedup import norm


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), name.replace(" ", "-")))
    for t in tables[:-1]:
        assert t.columns == columns
    before, good, exact, near, mix, out = [t.toPandas() for t in tables]
    model = quality_pu.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert set(good["doc_id"]) == {r.doc_id for r in quality_pu.score(docs, model).collect() if r.score >= 0.7}
    keep = good.assign(n=good["text"].map(norm)).groupby("n")["doc_id"].min()
    assert sorted(exact["doc_id"]) == sorted(keep)
    found = simhash_bk.near_duplicates(tables[2]).toPandas()
    assert sorted(near["doc_id"]) == sorted(found["component_id"].unique())
    assert set(mix["doc_id"]) <= set(near["doc_id"]) and max(Counter(mix["doc_id"]).values()) <= 2
    assert len(out) == len(mix) and list(out.columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    again = bpe_dp.digests(tables[4], TOKENIZER).toPandas()
    assert sorted(out["ids_sha256"]) == sorted(again["ids_sha256"])
    assert before["doc_id"].is_unique


def test_run_and_empty_tables(spark, sf_dir, nothing):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.count() == 0


def test_stages_take_odd_rows(spark, sf_dir, edges):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges, sf_dir).count() >= 0
