"""Each registered query of the page operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from quirelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    rows = df[sorted(df.columns)].astype(object).values.tolist()
    return sorted((tuple(None if x is None or x != x else round(float(x), 5) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_as_sql(spark, sql, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.oracle_sql():
        want = sql.execute(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
