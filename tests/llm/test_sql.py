"""Queries against their SQL on the whole tables."""

import duckdb
import pytest

from framelake.llm.queries import ORACLE_SQL, QUERIES


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, expected = QUERIES[name](spark, sf_dir), c.sql(ORACLE_SQL[name])
    names = sorted(expected.columns)
    assert set(names) <= set(found.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    at = [expected.columns.index(c) for c in names]
    assert a == sorted(tuple(plain(r[k]) for k in at) for r in expected.fetchall())
    assert sorted(found.columns) == names
