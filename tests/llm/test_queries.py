"""The registered training-data queries and the pipeline on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_pipeline(spark):
    import corpus_pipeline as p

    out = p.run(spark, SF)
    assert len(p.STAGES) == 5 and out.count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lines = p.line_dedup(spark, kept, SF)
    assert lines.columns == docs.columns and 0 < lines.count() <= kept.count()


@pytest.mark.parametrize("name", ["op4_url_filter"])
def test_sql(spark, name):
    import duckdb

    from parley.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in want.fetchall())
