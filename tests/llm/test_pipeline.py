import corpus_pipeline
from tessera.llm.queries import QUERIES
from tests_llm_brute import brute_pipeline


def test_each_stage_takes_effect(spark, sf):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    kept = brute_pipeline(spark, sf, docs)
    assert set(got) == set(kept)
    from tokenizers import Tokenizer

    from tessera.llm.queries import TOKENIZER, tokenizer_path

    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    for i, text in kept.items():
        assert got[i].ids == library.encode(text, add_special_tokens=False).ids and got[i].n_chars == len(text)


def test_stages_keep_the_columns(spark, edge, sf):
    docs = edge
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edge.columns
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge.limit(0), sf).collect()


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
