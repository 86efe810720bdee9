"""Every registered query of the core against its SQL, or that it runs where SQL has none."""

import pytest

from inkquarry.plans import all_registries

from .oracle import DATA, compare, connect

QUERIES = {k: (f, r.sql.get(k)) for r in all_registries() for k, f in r.queries.items()}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    if sql:
        compare(spark, con, query, sql)
    else:
        df = query(spark, DATA)
        assert df.columns and len(df.collect()) >= 0


def test_heading_nesting_of_many_pages(spark, tmp_path):
    """Pages whose square is no 32-bit number; the SQL's engine refuses them."""
    pages = [1, 2, 46340, 46341, 46342, 46345, 2**31 - 2]
    spark.createDataFrame([(7, p) for p in pages + pages[3:]], "doc_id bigint, page int").write.parquet(f"{tmp_path}/pdf_pages.parquet")
    df = QUERIES["heading_nesting"][0](spark, str(tmp_path))
    assert df.schema["level"].dataType.simpleString() == "int"
    levels = [(p, p * p % 4 + 1) for p in pages]
    assert sorted(map(tuple, df.collect())) == [(7, p, x) for (p, x), b in zip(levels, [0] + [x for _, x in levels], strict=False) if x > b + 1]
