"""Every query against its SQL equivalent."""

import duckdb
import pytest

from sparktrail.plans.all_queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name not in ORACLES:
        assert rows
        return
    result = sql.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
