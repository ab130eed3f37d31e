"""Every query with SQL gives the rows that DuckDB gives for it on the same tables."""

import math

import pytest

from tidegraph.plans import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return round(float(x), 6) if type(x).__name__ == "Decimal" else x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=str), sorted(columns)


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_equals_sql(spark, duck, name):
    df = REGISTRY.queries[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(REGISTRY.oracles[name])
    columns = [c[0] for c in result.description]
    assert got == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracles)))
def test_query_without_sql_runs(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0
