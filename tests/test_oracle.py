"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from stratavec import queries as q

NAMES = sorted(q.queries())


def canonical(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in ("embeddings", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert sorted(q.oracle_sql()) == NAMES


@pytest.mark.parametrize("name", sorted(q.BUILDERS))
def test_settings_of_high_recall(spark, small, name):
    assert q.high_recall(name)(spark, small).first()["recall_at_n"] >= 0.9


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, con, name):
    ours = canonical(q.queries()[name](spark, small).toPandas())
    sql = canonical(con.sql(q.oracle_sql()[name]).df())
    assert list(ours.columns) == list(sql.columns)
    assert len(ours) == len(sql) > 0
    for c in ours.columns:
        assert ours[c].dtype == sql[c].dtype
        assert ((ours[c] == sql[c]) | (ours[c].isna() & sql[c].isna())).all(), c
