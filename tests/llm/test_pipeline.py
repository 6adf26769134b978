import corpus_pipeline
from lattice.llm import common, jaccard, mixing

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, SF))
        assert docs.columns == columns
        sizes.append(docs.count())
        if stage is corpus_pipeline.distinct_texts:
            texts = [r.text.translate({i: i + 32 for i in range(65, 91)}) for r in docs.collect()]
            assert len(texts) == len(set(texts))
        if stage is corpus_pipeline.distinct_groups:
            assert jaccard.jaccard_join(docs)[1].count() == 0
            whole = sum(r.taken for r in mixing.mix(docs, mixing.quality_weights(spark.read.parquet(f"{SF}/labels.parquet"))).collect())
    assert sum(len(r.text.split()) for r in docs.collect()) == whole
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3]
    packed = corpus_pipeline.packed(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
