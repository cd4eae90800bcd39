"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from mentionloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(round(float(x), 5) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, row)) for row in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(queries.ORACLES[name])
    assert sorted(x[0] for x in want.description) == columns
    order = [[x[0] for x in want.description].index(c) for c in columns]
    assert normal(got.select(*columns).collect()) == normal([tuple(row[i] for i in order) for row in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"iterative_linking", "non_iterative_linking"}))
def test_other_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() >= 0
