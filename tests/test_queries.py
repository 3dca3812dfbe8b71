"""Every registered query against its SQL on the smallest tables."""

import pytest

from lodestrata.plans import catalogue
from tests.oracle import canonical, connection, differences


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, small, con, name):
    assert differences(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], con) == []


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_do_not_depend_on_partitions(spark, small, name):
    """Queries without SQL: some rows, and the same ones when tables are dealt to other tasks."""
    rows = lambda: sorted(canonical(catalogue.QUERIES[name](spark, small).toPandas()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert first and first == rows()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_categories_ignore_case(spark, tmp_path):
    import duckdb

    texts = [(1, "An Idiot spoke"), (2, "idiot"), (3, "nothing"), (4, None), (5, "IDIOT, Update")]
    spark.createDataFrame([(i, t, "en", "src") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalogue.QUERIES["d08_categories"](spark, str(tmp_path))
    assert differences(found, catalogue.ORACLES["d08_categories"], con) == []
    assert {r.doc_id: r.categories for r in found.collect()} == {1: "error_handling", 2: "error_handling", 3: "", 4: "", 5: "update,error_handling"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
