"""Registered queries at the smallest scale, beside their SQL where there is some, and the stages of the pipeline."""

import pytest

import corpus_pipeline
from checks.compare import compare, oracle
from rankwell.llm import decontamination, ngram_join
from rankwell.llm.queries import ORACLES, QUERIES
from rankwell.llm.shared import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert compare(got, oracle(FOLDER).execute(ORACLES[name]).df()) is None
    elif name != "op9_chat_format":
        assert len(got) == table(spark, FOLDER, "embeddings" if name.startswith("op11") else "documents").count()


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "near_duplicates":
            classes = {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_classes(docs, 5, 80).collect()}
            assert kept == {i for i, c in classes.items() if i == c}
        if name == "decontamination":
            hit = {r.doc_id for r in decontamination.contaminated(docs, table(spark, FOLDER, "benchmark")).collect()}
            assert kept == {r.doc_id for r in docs.collect()} - hit
        docs = after
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    out = corpus_pipeline.write_tokens(spark, mixed, FOLDER)
    assert out.count() == mixed.count() and corpus_pipeline.ORACLE_SQL is None
