"""The pipeline's stages, each on its own input."""

import corpus_pipeline
from tabsmith.llm import mixing


def test_stages_on_the_small_tables(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "byte-level BPE encoding and decoding":
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in before}
            assert all(r["n_tokens"] == len(r["ids"]) for r in docs.collect())
            break
        assert docs.columns == names
        after = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if name == "exact dedup":
            best = {}
            for i_, t in before:
                best[t] = max(best.get(t, i_), i_)
            assert sorted(after) == sorted((i_, t) for t, i_ in best.items())
        elif name.startswith("mixing"):
            words = sum(len(t.split()) for _, t in before)
            assert abs(sum(len(t.split()) for _, t in after) - 1.5 * words) <= 0.001 * words + 20
        else:
            assert set(after) <= before and len(after) >= 0.5 * len(before)


def test_pipeline_runs_as_a_query(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0
    assert mixing.BLOCK == 256
