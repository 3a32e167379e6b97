"""Every registered query of the operators, and the pipeline, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are elsewhere")


def test_one_query_for_each_operator():
    from penumbra.llm import queries

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op8", "op9", "op10", "op13"])
def test_a_row_for_each_document(spark, name):
    from penumbra.llm import queries

    query = next(q for n, q in queries.queries().items() if n.startswith(f"{name}_"))
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    out = query(spark, SF).select("doc_id")
    assert sorted(r[0] for r in out.collect()) == sorted(r[0] for r in documents.select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*documents.columns, "shard", "slot"]
    rows = out.collect()
    assert 0 < len(rows) < documents.count() and len({r["doc_id"] for r in rows}) == len(rows)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from penumbra.llm import queries

    connection = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        out = queries.queries()[name](spark, SF)
        made = connection.execute(sql)
        order = [d[0] for d in made.description]
        assert sorted(order) == sorted(out.columns), name
        assert sorted(tuple(r[c] for c in order) for r in out.collect()) == sorted(made.fetchall()), name
