import pytest

from treespan.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, against_sql, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        against_sql(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0
