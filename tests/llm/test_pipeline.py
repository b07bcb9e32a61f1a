import duckdb
import pytest
from fixtures import SF, extended, odd_documents

import corpus_pipeline
from cuemill.llm.queries import QUERIES, SQL


def test_stages_on_odd_documents(spark):
    docs = extended(spark, odd_documents())
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns, name
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and docs.count() > 20
    empty = extended(spark, odd_documents()).limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SF)
        assert empty.count() == 0


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, SF), name)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(docs) == key(corpus_pipeline.run(spark, SF))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    import oracle

    class Q:
        run = staticmethod(QUERIES[name])
        sql = SQL[name]

    assert oracle.compare(spark, oracle.connect(SF), Q, SF) is None


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert duckdb and all(n.startswith("op") for n in QUERIES)
