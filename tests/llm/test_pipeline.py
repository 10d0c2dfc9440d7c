"""The pipeline's stages on a small table, one by one and as a whole."""

import corpus_pipeline
from loadlens.llm import registry


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    kept = {r.doc_id for r in registry.QUERIES["op3_quality_rules"](spark, sf_dir).collect() if r.kept}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r.doc_id for r in docs.collect()} == kept
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    assert {"shard", "slot", *columns} <= set(docs.columns)
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda rows: sorted((r.doc_id, r.shard, r.slot) for r in rows)
    assert key(whole.collect()) == key(docs.collect())


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, repeated rows and an empty table go through all stages."""
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = docs.where("doc_id < 60")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (10**6, " \n", None, "s", 3), (10**6 + 1, "one two", "en", "s", None)], docs.schema)
    some.union(some.where("doc_id % 3 = 0")).union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    rows = found.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in some.collect()}
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
