"""Every bound query against its SQL on the smallest tables."""

import pytest
from caselake.plans import registry

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def _sorted(rows):
    return sorted((tuple(map(_norm, r)) for r in rows), key=lambda r: tuple(map(repr, r)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    got = df.select(*cols).collect()
    assert list(map(repr, _sorted(got))) == list(map(repr, _sorted(want)))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
