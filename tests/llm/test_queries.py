import pytest
from compare import connect, difference

from vakanz.llm import queries

FOLDER = "/root/testdata/sf0.001"
ROWS = {"op10": "pages", "op12": "embeddings"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_returns_its_whole_table(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    table = ROWS.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if sql := queries.oracle_sql().get(name):
        same, extra, missing, rows = difference(df, connect(FOLDER), sql)
        assert same and not extra and not missing and rows
